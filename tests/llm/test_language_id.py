"""Language identification: held-out accuracy, parts against plain versions, and what it never reads."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecloom.llm import language_id as L
from vecloom.llm.common import text_of
from vecloom.llm.queries import queries


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_held_out_accuracy(spark, sf):
    path = f"/root/testdata/{sf}"
    docs = spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "lang")
    got = queries()["op12_language_id"](spark, path).join(docs, "doc_id").where("lang is not null").toPandas()
    held = got[got.held_out]
    assert set(held.doc_id) == {x for x in got.doc_id if zlib.crc32(str(x).encode()) % 4 == 2}
    assert (held.lang == held.lang_pred).mean() >= 0.98
    assert got.score.between(0, 1).all()


def test_labels_ids_and_sources_are_no_inputs(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = L.fit(docs)
    other = docs.select((-F.col("doc_id")).alias("doc_id"), "text", F.lit("xx").alias("lang"), F.lit(None).cast("string").alias("source"))
    a = L.predict(docs, model).toPandas().set_index("doc_id").sort_index()
    b = L.predict(other, model).toPandas()
    b["doc_id"] = -b["doc_id"]
    b = b.set_index("doc_id").sort_index()
    assert (a.lang_pred == b.lang_pred).all() and np.allclose(a.score, b.score)
    # what is held out is not learned from: other labels there change nothing
    key = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    moved = L.fit(docs.withColumn("lang", F.when(key, "zz").otherwise(F.col("lang"))))
    assert moved.langs == model.langs and np.allclose(moved.like, model.like) and np.allclose(moved.weights, model.weights)


def test_families_come_first(spark, sf_dir):
    model = L.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    assert model.langs == ("de", "en", "es", "fr") and model.pairs.tolist() == [[0, 1], [2, 3]]
    assert L.family_of("de-AT") == L.family_of("EN") == "germanic" and L.family_of("qq") == "qq"
    alone = L.LanguageModel(model.langs, model.family, model.like * 0 + np.array([[1.0, 0.0]]), model.pairs, model.weights, model.bias)
    raw = np.frombuffer("le la les des une été".encode(), np.uint8)
    assert alone.predict(raw, np.array([0, len(raw)]))[0][0] in (0, 1)  # a Romance text stays in the family that was chosen


def test_features_match_plain_ngrams():
    import pyarrow as pa

    texts = ["", "Ab  c1", "ÉÀ×Ж п Я Ω", "x", "  ", "a b"]
    raw, offsets = text_of(pa.array(texts))
    places, at = L.features(raw, offsets)
    seen: dict[bytes, int] = {}
    for k, t in enumerate(["", "ab c ", "éà×ж п я ω", "x", "", "a b"]):
        flat = f" {t.strip()} ".encode() if t else b" "
        own = places[at[k] : at[k + 1]]
        if t == "ab c ":
            flat = b" ab c "
        assert len(own) == len(flat), t
        for i in range(len(flat)):
            for j, size in enumerate(L.SIZES):
                gram = flat[i : i + size]
                if len(gram) < size or gram == b" ":
                    assert own[i, j] == 0
                else:
                    assert own[i, j] > 0 and seen.setdefault(gram, own[i, j]) == own[i, j]


def test_svm_separates_and_is_repeatable():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(1, 1, (150, 6)), rng.normal(-1, 1, (30, 6))]).astype(np.float32)
    x[:, -1] = 1
    y = np.repeat([1.0, -1.0], [150, 30])
    w = L.svm(x, y)
    assert ((x @ w > 0) == (y > 0)).mean() >= 0.95 and np.array_equal(w, L.svm(x, y))
    # a plain gradient descent on the primal ends at no better value
    cost = 10.0 * 180 / 2 / np.where(y > 0, 150, 30)

    def value(w):
        return 0.5 * w @ w + (cost * np.maximum(1 - y * (x @ w), 0) ** 2).sum()

    v, rate = np.zeros(6), 1e-5
    for _ in range(20_000):
        v = v - rate * (v - 2 * ((cost * y * np.maximum(1 - y * (x @ v), 0))[:, None] * x).sum(0))
    assert value(w.astype(float)) <= value(v) * 1.001


def test_odd_documents(spark, sf_dir, odd_documents, no_documents):
    model = L.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    got = L.predict(odd_documents, model)
    rows = got.collect()
    assert got.columns == ["doc_id", "lang_pred", "score"] and len(rows) == odd_documents.count()
    by = {r["doc_id"]: r for r in rows}
    texts = {r["doc_id"]: r["text"] for r in odd_documents.collect()}
    for k, r in by.items():
        none = texts[k] is None or not any(c.isalpha() for c in texts[k])
        assert (r["lang_pred"] == "und") == none and (r["score"] == 0.0 or not none)
    assert L.predict(no_documents, model).count() == 0
    assert L.fit(no_documents) is None
    assert {(r["lang_pred"], r["score"]) for r in L.predict(odd_documents, None).collect()} == {("und", 0.0)}
    one = L.identify(odd_documents)  # all labelled rows are of one language
    assert {r["lang_pred"] for r in one.collect()} == {"en", "und"} and one.count() == odd_documents.count()


def test_long_texts_are_read_in_parts(spark, sf_dir, monkeypatch):
    """Cutting texts before spaces changes next to nothing, and memory does not follow the longest text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = L.fit(docs)
    raw, offsets = text_of(docs.select("text").toArrow().column("text").combine_chunks().fill_null(""))
    lang, score = model.predict(raw, offsets)
    monkeypatch.setattr(L, "STEP_BYTES", 700)
    parts = list(L.parts(raw, offsets))
    assert b"".join(p.tobytes() for p, _, _ in parts) == raw.tobytes() and max(len(p) for p, _, _ in parts) <= 700
    again, other = model.predict(raw, offsets)
    assert (again == lang).all() and np.abs(score - other).max() < 0.2
    flat = np.frombuffer("日本語".encode() * 500, np.uint8)  # no space: cut before a character's first byte
    assert all((p[0] & 0xC0) != 0x80 and len(p) <= 700 for p, _, _ in L.parts(flat, np.array([0, len(flat)])))
