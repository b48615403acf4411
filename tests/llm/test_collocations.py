"""Collocations against counts and scores in plain Python."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from vecloom.llm import collocations as C

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, max_n=3, least=10, explained=50, most=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = [x for x in re.split("[ \t]+", piece) if x]
            n[lang] += len(w)
            for size in range(1, max_n + 1):
                f.update((lang, tuple(w[i : i + size])) for i in range(len(w) - size + 1))
    candidates = {g: a for g, a in f.items() if len(g[1]) > 1 and a >= least}
    out = {}
    for (lang, g), a in candidates.items():
        longer = (b for (x, h), b in candidates.items() if x == lang and len(h) > len(g) and 100 * b >= explained * a and any(h[i : i + len(g)] == g for i in range(len(h) - len(g) + 1)))
        if next(longer, None) is None:
            score, _, left, right = min((1000000 * a * a // (f[lang, g[:k]] * f[lang, g[k:]]), k, f[lang, g[:k]], f[lang, g[k:]]) for k in range(1, len(g)))
            out.setdefault(lang, []).append((-score, -a, " ".join(g).encode(), left, right))
    return sorted((lang, i, p.decode(), -a, left, right, n[lang], -s) for lang, own in out.items() for i, (s, a, p, left, right) in enumerate(sorted(own)[:most], 1))


def some_rows(seed, n=60):
    rng = random.Random(seed)
    words = ["a", "b", "C", "the", "The", "été", "日本", "x y", "don't", "É"]
    rows = []
    for _ in range(n):
        out = []
        for _ in range(rng.randrange(120)):
            out.append(rng.choice(["new york city", "New York", *words]))
            out.append(rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", " ; "]))
        rows.append((rng.choice(["en", "fr", None, "und", "a\tb"]), "".join(out)))
    return [*rows, ("en", None), ("fr", ""), (None, "...,,,"), ("de", "   "), *rows[:3]]


def found(spark, rows, **options):
    docs = spark.createDataFrame([(i, t, x, "s", 1) for i, (x, t) in enumerate(rows)], "doc_id long, text string, lang string, phrase string, n long").repartition(3)
    return sorted(map(tuple, C.collocations(docs, **options).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))


@pytest.mark.parametrize("options", [{}, {"max_n": 4, "least": 3}, {"max_n": 2, "least": 2, "most": 5}, {"least": 1, "explained": 90}])
def test_matches_plain_counts(spark, options):
    rows = some_rows(len(options))
    got = found(spark, rows, **options)
    assert got == plain(rows, **options) and got


def test_small_stretches_and_a_full_filter(spark, monkeypatch):
    """Texts cut at pieces, and a filter that admits almost everything, change nothing."""
    text = ", ".join(["one two three", "two three four"] * 40).encode()
    raw, offsets = np.frombuffer(text, np.uint8), np.array([0, 0, len(text) // 2, len(text), len(text)])
    parts = list(C._stretches(raw, offsets, 50))
    assert [a for a, _ in parts[1:]] == [b for _, b in parts[:-1]] and parts[0][0] == 0 and parts[-1][1] == len(raw)
    assert all(chr(raw[b - 1]) == "," or b in offsets for _, b in parts) and len(parts) > 20
    monkeypatch.setattr(C, "FILTER_BITS", 6)
    monkeypatch.setattr(C, "_passes", lambda h, admitted: np.ones(len(h), bool))
    rows = some_rows(9)
    assert found(spark, rows, least=4) == plain(rows, least=4)


def test_filter_holds_every_frequent_ngram(spark):
    grams = spark.createDataFrame([("en", "the cat"), ("a\tb", "the cat"), ("en", "été 日本")], "lang string, phrase string")
    bits = C._filter(grams, 2).value
    for lang, phrase, inside in (("en", "the cat", True), ("a\tb", "the cat", True), ("en", "été 日本", True), ("fr", "the cat", False), ("en", "cat the", False)):
        raw = np.frombuffer(phrase.encode(), np.uint8)
        g = C._Grams(raw, np.array([0, len(raw)]), np.zeros(1, np.int64), np.array([C._language(lang)], np.uint64))
        g.grow(None)
        assert C._passes(g.h, bits).tolist() == [inside]


def test_exact_beyond_64_bits(spark):
    row = spark.range(1).selectExpr("(cast(3000000007 as decimal(15,0)) * cast(3000000007 as decimal(15,0)) * cast(1000000 as decimal(7,0))) div (cast(3000000011 as decimal(15,0)) * cast(3000000009 as decimal(15,0))) as s").first()
    assert row["s"] == 1000000 * 3000000007**2 // (3000000011 * 3000000009)


def test_odd_and_empty_tables(spark, odd_documents, no_documents):
    rows = [(r["lang"], r["text"]) for r in odd_documents.collect()]
    got = sorted(map(tuple, C.collocations(odd_documents).collect()))
    assert got == plain(rows)
    assert C.collocations(no_documents).count() == 0
    with pytest.raises(ValueError):
        C.collocations(odd_documents, max_n=1)
