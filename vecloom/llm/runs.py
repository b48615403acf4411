"""Periodic runs: stretches of words that repeat with a period, found on a harmonic grid and collapsed to their first period.

For every period p the grid has the points 0, p, 2p, ...: n / p of them, so n ln n (period, point) pairs in all. A run
of at least three periods holds two equal neighbouring blocks of its grid, which prefix hashes tell for all pairs at
once. From the first such pair of each series, binary searches over prefix hashes give how far the words agree
with those one period on, to the right and to the left, again for all pairs at once. Stretches found by several periods
count once, by the smallest, and their words are compared, so that hashes never decide."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hash_words, mix, numbered, powers, ranges_of, slices, text_of

#: (period, grid point) pairs that one step works on; one period's points stay together.
PAIRS = 1 << 20

_SAME = np.arange(256, dtype=np.uint8)  # capitals stay what they are


def _periods(n: int, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of periods 1..most with about PAIRS grid points each."""
    first = 1
    while first <= most:
        points = np.cumsum(n // np.arange(first, min(first + PAIRS, most + 1)))
        last = first + max(int(np.searchsorted(points, PAIRS, "right")), 1)
        yield first, min(last, most + 1)
        first = last


def _agreement(sums: np.ndarray, base: np.ndarray, at: np.ndarray, period: np.ndarray, low: np.ndarray, high: np.ndarray, left: bool) -> np.ndarray:
    """The greatest length in low..high for which the words from (to the left: up to) `at` agree with those one period on."""
    low, high = low.copy(), high.copy()
    with np.errstate(over="ignore"):
        while (open_ := np.flatnonzero(low < high)).size:
            mid = (low[open_] + high[open_] + 1) // 2
            p = period[open_]
            start = at[open_] - mid if left else at[open_]
            stop = start + mid
            same = (sums[stop] - sums[start]) * base[p] == sums[stop + p] - sums[start + p]
            low[open_] = np.where(same, mid, low[open_])
            high[open_] = np.where(same, high[open_], mid - 1)
    return low


def _by_hash(v: np.ndarray, longest: int, least: int, times: int) -> np.ndarray:
    """(start, end, period) rows of the stretches that prefix hashes give, each by its smallest period, in order of start and end."""
    n, most = len(v), longest // times
    with np.errstate(over="ignore"):
        base = powers(max(n, 1))
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(mix(v.view(np.uint64)) * base[:n], out=sums[1:])
        found = []
        for first, last in _periods(n, most):
            p = np.arange(first, last)
            k = np.maximum(n // p - 1, 0)  # pairs of neighbouring blocks
            period, at = np.repeat(p, k), ranges_of(np.zeros(len(p), np.int64), k)
            at *= period
            block = sums[at + period] - sums[at]
            hit = np.flatnonzero(block * base[period] == sums[at + 2 * period] - sums[at + period])
            period, at = period[hit], at[hit]
            new = np.ones(len(at), bool)
            new[1:] = (period[1:] != period[:-1]) | (at[1:] != at[:-1] + period[:-1])
            period, at = period[new], at[new]
            right = _agreement(sums, base, at, period, period, n - at - period, False)
            left = _agreement(sums, base, at, period, np.zeros_like(at), np.minimum(at, period - 1), True)
            start, end = at - left, at + period + right
            keep = end - start >= np.maximum(least, times * period)
            found.append(np.stack([start[keep], end[keep], period[keep]], axis=1))
    rows = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:, :2] != rows[:-1, :2]).any(1)
    return rows[new]


def _by_words(v: np.ndarray, longest: int, least: int, times: int) -> np.ndarray:
    """The same rows by comparing words for each period: for texts whose hashes agree where their words do not."""
    found: dict[tuple[int, int], int] = {}
    for p in range(1, longest // times + 1):
        same = np.concatenate([[False], v[:-p] == v[p:], [False]])
        turn = np.flatnonzero(same[1:] != same[:-1])
        for start, stop in zip(turn[::2].tolist(), turn[1::2].tolist(), strict=True):
            if stop + p - start >= max(least, times * p):
                found.setdefault((start, stop + p), p)
    return np.array(sorted((a, b, p) for (a, b), p in found.items()), np.int64).reshape(-1, 3)


def find_runs(ids: np.ndarray, counts: np.ndarray, least: int = 24, times: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Text number of each run, and (start, length, period) rows by start, then period; starts are word numbers within the text.

    ids: numbers of the words of all texts, one after another; counts: words of each text. A run is a maximal stretch
    with that smallest period, of `least` words and `times` (three or more) periods at least; each text is alone with its runs."""
    if times < 3:
        raise ValueError("a run has three periods at least")
    texts, longest = len(counts), int(counts.max(initial=0))
    # a mark that occurs once ends each text, so that nothing agrees beyond it
    owner = np.repeat(np.arange(texts), counts)
    v = np.empty(len(ids) + texts, np.int64)
    v[np.arange(len(ids)) + owner] = ids
    ends = np.cumsum(counts + 1) - 1
    v[ends] = -1 - np.arange(texts)
    rows = _by_hash(v, longest, least, times)
    start, end, period = rows.T
    step = max(PAIRS // max(longest, 1), 1)
    wrong = np.zeros(texts, bool)
    for i in range(0, len(rows), step):
        s, size, p = start[i : i + step], (end - period - start)[i : i + step], period[i : i + step]
        at = ranges_of(s, size)
        bad = np.repeat(np.arange(len(s)), size)[v[at] != v[at + np.repeat(p, size)]]
        for b in np.unique(bad) + i:  # every text that such a stretch touches
            wrong[np.searchsorted(ends, start[b]) : np.searchsorted(ends, end[b] - 1) + 1] = True
    text = np.searchsorted(ends, start)
    first = ends - counts
    out = [(text, np.stack([start - first[text], end - start, period], axis=1))]
    if wrong.any():
        sound = ~wrong[text]
        out = [(text[sound], out[0][1][sound])]
        for t in np.flatnonzero(wrong):
            own = _by_words(v[first[t] : ends[t]], int(counts[t]), least, times)
            out.append((np.full(len(own), t), np.stack([own[:, 0], own[:, 1] - own[:, 0], own[:, 2]], axis=1)))
    text, rows = np.concatenate([t for t, _ in out]), np.concatenate([r for _, r in out])
    order = np.lexsort((rows[:, 2], rows[:, 0], text))
    return text[order], rows[order]


def _kept(counts: np.ndarray, text: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Whether each word stays: those that a run contains after its first period go."""
    start = (np.cumsum(counts) - counts)[text] + rows[:, 0]
    cover = np.zeros(int(counts.sum()) + 1, np.int64)
    np.add.at(cover, start + rows[:, 2], 1)
    np.add.at(cover, start + rows[:, 1], -1)
    return np.cumsum(cover[:-1]) == 0


def _joined(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray, keep: np.ndarray, counts: np.ndarray) -> pa.Array:
    """The kept words of each text, joined by one space."""
    owner = np.repeat(np.arange(len(counts)), counts)[keep]
    at = ranges_of(starts[keep], lengths[keep] + 1)
    out = raw[np.minimum(at, len(raw) - 1)]
    stops = np.cumsum(lengths[keep] + 1)
    out[stops - 1] = 0x20
    last = np.ones(len(stops), bool)
    last[:-1] = owner[1:] != owner[:-1]
    out = np.delete(out, stops[last] - 1)
    size = np.bincount(owner, lengths[keep] + 1, len(counts)).astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(np.maximum(size - 1, 0))])
    return pa.LargeStringArray.from_buffers(len(counts), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(out)))


def collapse_runs(documents: DataFrame, least: int = 24, times: int = 3, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep`, n_words, runs (array of (start, length, period)), and collapsed: the text without what runs repeat.

    Words are `[^\\x20\\x09-\\x0D]+`, compared byte by byte; runs are in order of start, then period. A row for each row:
    null texts count as empty, and empty texts have no runs and collapse to nothing; repeated rows are rows of their own; an empty
    table gives no rows; further columns are left out. No shuffle: a text is one task's work, n ln n steps for its n
    words, in memory that grows with the longest text alone."""
    kinds = [documents.schema[c] for c in keep]
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_of(batch.column("__text"))
            for i, j in slices(offsets):
                part = raw[offsets[i] : offsets[j]]
                h, counts, starts, lengths = hash_words(part, offsets[i : j + 1] - offsets[i], _SAME)
                text, rows = find_runs(numbered(h, part, starts, lengths), counts, least, times)
                at = np.searchsorted(text, np.arange(j - i + 1))
                own = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c)) for c in rows.T], fields=list(run)))
                collapsed = _joined(part, starts, lengths, _kept(counts, text, rows), counts).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*(c.slice(i, j - i) for c in batch.columns[:-1]), pa.array(counts), own, collapsed], [*batch.schema.names[:-1], "n_words", "runs", "collapsed"])

    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kinds)
    rows = documents.select(*(F.col(f"`{c}`") for c in keep), F.coalesce("text", F.lit("")).alias("__text"))
    return rows.mapInArrow(work, f"{kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def planted(documents: DataFrame) -> DataFrame:
    """doc_id and text, with runs planted in a tenth of the texts, as op13's contract fixes it: those whose h = crc32(doc_id as text) ends in 0.

    From word a = g % n on (g: h without its last digit, n: words) such a text repeats its next 1 + (n - a) / (3 + g % 8)
    words. A null doc_id counts as the empty string, whose h is 0."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    rows = documents.select("doc_id", "text", h.alias("h"), F.floor(h / 10).alias("g"))
    words = F.filter(F.split("text", "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != "")

    def repeated(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = F.pmod("g", n)
        period = F.floor((n - a) / (F.lit(3) + F.pmod("g", F.lit(8)))) + 1
        source = lambda i: F.when(i < a, i).otherwise(a + F.pmod(i - a, period))
        return F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(words, source(i).cast("int"))), " ")

    hit = (F.pmod("h", F.lit(10)) == 0) & F.col("text").rlike("[^ \\t\\n\\x0B\\f\\r]")
    whole = rows.withColumn("words", F.when(hit, words))
    return whole.select("doc_id", F.when(F.col("words").isNotNull(), repeated(F.col("words"))).otherwise(F.col("text")).alias("text"))


def digests(documents: DataFrame) -> DataFrame:
    """op13's columns: each document's runs after planting, the first of greatest length / period (in order of start, then
    period; compared by products, so exactly), and SHA-256 of all runs and of what is left."""
    found = collapse_runs(planted(documents))
    none = F.lit(None).cast("struct<start:long,length:long,period:long>")
    longer = lambda r, s: r["length"] * s["period"] > s["length"] * r["period"]
    best = F.aggregate("runs", none, lambda s, r: F.when(s.isNull() | longer(r, s), r).otherwise(s))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(F.lit(""))
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return rows.select(
        "doc_id", "n_runs", F.col("b.start").alias("start"), F.col("b.length").alias("length"), F.col("b.period").alias("period"),
        F.expr("1000 * b.length div b.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )
