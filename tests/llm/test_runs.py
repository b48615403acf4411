"""Periodic runs against a search by brute force, and the planted runs of op13's contract."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecloom.llm import runs
from vecloom.llm.queries import queries


def words_of(text):
    return (text or "").encode().translate(bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")).split(b" ")


def plain_words(text):
    return [w for w in words_of(text) if w]


def plain_runs(w, least=24, times=3):
    """Every (start, length, period) by looking at each period and each word."""
    n, found = len(w), {}
    for p in range(1, n // times + 1):
        i = 0
        while i + p < n:
            if w[i] != w[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and w[j] == w[j + p]:
                j += 1
            if j + p - i >= max(least, times * p):
                found.setdefault((i, j + p), p)
            i = j + 1
    return sorted(((a, b - a, p) for (a, b), p in found.items()), key=lambda r: (r[0], r[2]))


def found_by(texts, least=24, times=3):
    ids = {}
    counts = np.array([len(t) for t in texts], np.int64)
    flat = np.array([ids.setdefault(w, len(ids)) for t in texts for w in t], np.int64)
    text, rows = runs.find_runs(flat, counts, least, times)
    return [[tuple(r) for r in rows[text == t].tolist()] for t in range(len(texts))]


def some_texts(seed):
    rng = random.Random(seed)
    texts = []
    for _ in range(40):
        words = rng.choice(["ab", "abc", "abcdefghijklmnopqrstuvwxyz"])
        t = []
        for _ in range(rng.randrange(6)):
            t += [rng.choice(words) for _ in range(rng.randrange(30))]
            period = [rng.choice(words) for _ in range(rng.randrange(1, 15))]
            t += (period * 12)[: rng.randrange(1, 100)]
        texts.append(t)
    return [[], ["a"], ["a"] * 23, ["a"] * 24, list("ab") * 12, list("ab") * 11, list("abcdefgh") * 3, *texts]


@pytest.mark.parametrize("seed", range(6))
def test_runs_match_brute_force(seed):
    texts = some_texts(seed)
    for least, times in ((24, 3), (2, 3), (5, 4)):
        assert found_by(texts, least, times) == [plain_runs(t, least, times) for t in texts]


def test_words_decide_where_hashes_collide(monkeypatch):
    # of the Thue-Morse words, two halves of 2,048 agree in every polynomial hash modulo 2^64, whatever its base
    t = [0]
    for _ in range(12):
        t += [1 - x for x in t]
    text = [str(x) for x in t[2048:]] + [str(x) for x in t[:2048]] + [str(x) for x in t[2048:]]
    assert found_by([text, ["a"] * 30, text[:3000]]) == [plain_runs(x) for x in (text, ["a"] * 30, text[:3000])]
    monkeypatch.setattr(runs, "mix", lambda x: np.zeros(len(x), np.uint64))  # all words look alike
    texts = some_texts(1)
    assert found_by(texts) == [plain_runs(x) for x in texts]


def plain_row(doc_id, text):
    w = plain_words(text)
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    g, n = h // 10, len(w)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = plain_runs(w)
    drop = {i for s, m, q in found for i in range(s + q, s + m)}
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in found)
    best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None, None, None))
    milli = None if best[0] is None else 1000 * best[1] // best[2]
    kept = b" ".join(x for i, x in enumerate(w) if i not in drop)
    return (doc_id, len(found), *best, milli, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def key(row):
    return [(x is None, x if x is not None else 0) for x in row]


def test_query_matches_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = queries()["op13_periodic_runs"](spark, sf_dir).collect()
    want = [plain_row(r["doc_id"], r["text"]) for r in docs.collect()]
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert sum(r["n_runs"] > 0 for r in got) >= len(want) // 20


def test_odd_documents(spark, odd_documents, no_documents):
    got = runs.digests(odd_documents).collect()
    want = [plain_row(r["doc_id"], r["text"]) for r in odd_documents.collect()]
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert runs.digests(no_documents).count() == 0


def test_collapsed_text_and_spans(spark):
    rows = [(1, "so " + "very very good " * 9 + "it is", "x"), (2, None, "y"), (2, "no runs here", "z")]
    docs = spark.createDataFrame(rows, "doc_id int, text string, runs string")
    got = {(r["doc_id"], r["n_words"]): r for r in runs.collapse_runs(docs).collect()}
    assert [tuple(x) for x in got[1, 30]["runs"]] == [(1, 27, 3)]
    assert got[1, 30]["collapsed"] == "so very very good it is"
    assert got[2, 0]["collapsed"] == "" and got[2, 3]["collapsed"] == "no runs here"
    with pytest.raises(ValueError):
        runs.find_runs(np.zeros(3, np.int64), np.array([3]), times=2)


def test_long_text(spark):
    text = " ".join(f"w{i % 5000}" for i in range(20_000))
    docs = spark.createDataFrame([(7, text + " end")], "doc_id long, text string")
    row = runs.collapse_runs(docs).select(F.col("runs"), F.length("collapsed").alias("n")).first()
    assert [tuple(x) for x in row["runs"]] == [(0, 20_000, 5000)]
