import pytest

#: What a table of documents can hold: nulls, empty and long texts, ties, repeated rows, and further columns.
ODD_TEXTS = [
    None, "", " ", "\n\t ", "word", "Word", "WORD word", "a b c d", "a b c d e", "é ß 日本 🙂", "x" * 5000, "tab\tand\nline " * 400,
    "<|endoftext|> inside", "  leading and trailing  ", "same text twice here", "same text twice here",
]


@pytest.fixture(scope="session")
def odd_documents(spark):
    rows = [(i, t, "en", "src", 0, "text") for i, t in enumerate(ODD_TEXTS)] + [(3, "\n\t ", "en", "src", 0, "text"), (None, "no id", None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string").repartition(3)


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
