"""Collocations: phrases whose words stand together far more often than their parts would have them, by language.

All 1..max_n-grams of pieces of texts become rows of a DataFrame, counted by (language, phrase). What is below the least
count is no candidate, and neither is what holds it, so rows of a longer n-gram are made only where both n-grams one
word shorter may reach that count: a filter of fixed size tells, which lets some through that do not, never the reverse.
Each cut of a candidate gets its parts' counts by joins; scores are exact decimals; phrases that a one word longer
phrase explains go by an anti-join; a window ranks what is left."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import HOT, SLICE_BYTES, hash_words, join_dealt, lower_table, materialize, mix, numbered, ranges_of, text_of

#: Bytes that part pieces, and those that part the words of a piece.
PIECES, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
#: Bits of the filter of n-grams that may go on: its size at most, and for each n-gram.
FILTER_BITS, BITS_EACH = 27, 16
#: Ranks are first taken in so many parts of a language.
PARTS = 64

_EDGE = np.isin(np.arange(256), np.frombuffer(PIECES, np.uint8))
_PART = _EDGE | np.isin(np.arange(256), np.frombuffer(BLANKS, np.uint8))
_LOWER = lower_table()
_U = np.uint64


def _stretches(raw: np.ndarray, offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Byte ranges of about `most` bytes that end where a piece or a text does, so that no n-gram is cut."""
    stops = np.union1d(offsets[1:], np.flatnonzero(_EDGE[raw]) + 1)
    first = 0
    while first < len(raw):
        last = int(stops[max(np.searchsorted(stops, first + most, "right") - 1, np.searchsorted(stops, first, "right"))])
        yield first, last
        first = last


def _language(name: str) -> int:
    return int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8).digest(), "little")


def _places(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two bits of a filter of 2^bits for each hash."""
    shift = _U(64 - bits)
    with np.errstate(over="ignore"):
        return (h >> shift).astype(np.int64), (mix(h * _U(0x9E3779B97F4A7C15)) >> shift).astype(np.int64)


def _passes(h: np.ndarray, admitted: np.ndarray) -> np.ndarray:
    a, b = _places(h, int(len(admitted) * 8).bit_length() - 1)
    bit = lambda at: (admitted[at >> 3] >> (at & 7).astype(np.uint8)) & 1
    return (bit(a) & bit(b)).astype(bool)


class _Grams:
    """The n-grams of a stretch of texts, grown word by word: at[k] is the number of the k-th one's first word.

    ids are equal for equal n-grams of one language alone; h are hashes for filters."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, lang: np.ndarray, seeds: np.ndarray):
        """lang: each text's language by its number; seeds: the languages' hashes."""
        self.own, counts, self.starts, self.lengths = hash_words(raw, offsets, _LOWER, _PART)
        self.folded = _LOWER[raw]
        self.owner = np.repeat(np.arange(len(counts)), counts)
        self.lang = lang[self.owner]
        self.piece = np.cumsum(_EDGE[raw])[self.starts] if len(self.starts) else self.starts
        words = numbered(self.own, self.folded, self.starts, self.lengths)
        self.words = pd.factorize(words * len(seeds) + self.lang)[0].astype(np.int64)
        self.size, self.at, self.ids = 1, np.arange(len(words)), self.words
        with np.errstate(over="ignore"):
            self.h = mix(self.own + seeds[self.lang])

    def grow(self, admitted: np.ndarray | None) -> None:
        """From n-grams to those of one word more, within pieces, whose first and last n words the filter admits."""
        ok = np.ones(len(self.at), bool) if admitted is None else _passes(self.h, admitted)
        here = np.full(len(self.words), -1, np.int64)
        here[self.at[ok]] = np.flatnonzero(ok)
        size = self.size
        last = self.at + size
        inside = ok & (last < len(self.words))
        at = np.flatnonzero(inside)
        first, end = self.at[at], last[at]
        good = (here[first + 1] >= 0) & (self.owner[end] == self.owner[first]) & (self.piece[end] == self.piece[first])
        at, first, end = at[good], first[good], end[good]
        ids, _ = pd.factorize(self.ids[at] * (int(self.words.max(initial=0)) + 1) + self.words[end])
        with np.errstate(over="ignore"):
            self.h = mix(self.h[at] * _U(3) + self.own[end])
        self.size, self.at, self.ids = size + 1, first, ids.astype(np.int64)

    def counted(self) -> tuple[np.ndarray, np.ndarray]:
        """The first place of each different n-gram, and how often it occurs."""
        n = np.bincount(self.ids) if len(self.ids) else np.zeros(0, np.int64)
        first = np.zeros(len(n), np.int64)
        first[self.ids[::-1]] = self.at[::-1]
        return first, n

    def phrases(self, first: np.ndarray, langs: list[str]) -> pa.Array:
        """language, tab, and the lowered words joined by one space, of the n-grams that begin at the words `first`."""
        heads = [x.encode() + b"\t" for x in langs]
        head = np.frombuffer(b"".join(heads), np.uint8)
        sizes = np.array([len(x) for x in heads])
        of = self.lang[first]
        # a head, then each word with the byte after it, which becomes a space
        starts = np.concatenate([(np.cumsum(sizes) - sizes)[of][:, None], *((self.starts[first + k] + len(head))[:, None] for k in range(self.size))], axis=1)
        lengths = np.concatenate([sizes[of][:, None], *((self.lengths[first + k] + 1)[:, None] for k in range(self.size))], axis=1)
        source = np.concatenate([head, self.folded, np.zeros(1, np.uint8)])
        out = source[ranges_of(starts.ravel(), lengths.ravel())]
        ends = np.cumsum(lengths.ravel()).reshape(lengths.shape)
        out[ends[:, 1:].ravel() - 1] = 0x20
        keep = np.ones(len(out), bool)
        keep[ends[:, -1] - 1] = False
        offsets = np.concatenate([[0], ends[:, -1] - np.arange(1, len(first) + 1)])
        return pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(out[keep]))).cast(pa.string())


def _each(batches: Iterator[pa.RecordBatch], size: int, filters: list[np.ndarray]) -> Iterator[tuple[_Grams, list[str]]]:
    """The n-grams of `size` words of each stretch, and the names of its languages."""
    for batch in batches:
        raw, offsets = text_of(batch.column("text"))
        coded = batch.column("lang").dictionary_encode()
        langs, lang = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        seeds = np.array([_language(x) for x in langs], _U)
        for first, last in _stretches(raw, offsets):
            i, j = int(np.searchsorted(offsets, first, "right")) - 1, int(np.searchsorted(offsets, last, "left"))
            own = np.clip(offsets[i : j + 1], first, last) - first
            grams = _Grams(raw[first:last], own, lang[i:j], seeds)
            for k in range(size - 1):
                grams.grow(filters[k])
            yield grams, langs


def _counted(rows: DataFrame, size: int, filters: list[Broadcast]) -> DataFrame:
    """key (language, tab, phrase), n: n-grams of `size` words; with words alone also n of the empty phrase, all words of the language.

    Equal n-grams of a stretch are one row, and Spark adds up those of a task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for grams, langs in _each(batches, size, [f.value for f in filters]):
            first, n = grams.counted()
            yield pa.RecordBatch.from_arrays([grams.phrases(first, langs), pa.array(n.astype(np.int64))], ["key", "n"])
            if size == 1:
                every = np.bincount(grams.lang, minlength=len(langs)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([f"{x}\t" for x in langs], pa.string()), pa.array(every)], ["key", "n"])

    return rows.mapInArrow(run, "key string, n long").groupBy("key").agg(F.sum("n").alias("n"))


def _filter(grams: DataFrame, size: int) -> Broadcast:
    """Bits of the hashes of (lang, phrase), of `size` words each: at most 2^FILTER_BITS, whatever the number of rows."""
    bits = min(FILTER_BITS, max(16, int(grams.count() * BITS_EACH).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(1 << bits, bool)
        for grams, _ in _each(batches, size, [None] * size):
            for at in _places(grams.h, bits):
                held[at] = True
        words = np.packbits(held, bitorder="little").view(np.int64)
        at = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(words[at])], ["at", "bits"])

    rows = grams.select("lang", F.col("phrase").alias("text")).mapInArrow(run, "at int, bits long")
    table = rows.groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros((1 << bits) // 64, np.int64)
    out[table.column("at").to_numpy()] = table.column("bits").to_numpy()
    return grams.sparkSession.sparkContext.broadcast(out.view(np.uint8))


def ngram_counts(documents: DataFrame, max_n: int = 3, least: int = 10) -> tuple[DataFrame, DataFrame]:
    """(lang, size, phrase, n) of the 1..max_n-grams that occur `least` times or more in a language, and (lang, n): all its words.

    Written to the shared folder, size by size."""
    rows = documents.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    lang = F.expr("substr(key, 1, length(key) - 1 - length(substring_index(key, '\\t', -1)))")
    parts: list[DataFrame] = []
    filters: list[Broadcast] = []
    for size in range(1, max_n + 1):
        counts = _counted(rows, size, filters).select(lang.alias("lang"), F.substring_index("key", "\t", -1).alias("phrase"), "n")
        parts.append(materialize(counts.where((F.col("n") >= least) | (F.col("phrase") == "")), f"grams{size}"))
        if size < max_n:
            filters.append(_filter(parts[-1].where("phrase <> ''"), size))
    grams = None
    for size, part in enumerate(parts, 1):
        part = part.where("phrase <> ''").select("lang", F.lit(size).alias("size"), "phrase", "n")
        grams = part if grams is None else grams.unionAll(part)
    return grams, parts[0].where("phrase = ''").select("lang", "n")


def _cut(first: bool) -> Column:
    return F.expr("substring_index(phrase, ' ', k)" if first else "substring_index(phrase, ' ', k - size)")


def _with_count(cuts: DataFrame, grams: DataFrame, part: str, name: str) -> DataFrame:
    """cuts with the count of the phrase in column `part` as `name`. Parts that many cuts share are dealt out."""
    crowd = cuts.groupBy("lang", part).count()
    few = crowd.where(F.col("count") > HOT * cuts.count()).select("lang", part)
    own = grams.select("lang", F.col("phrase").alias(part), F.col("n").alias(name))
    return join_dealt(cuts, own, ["lang", part], few)


def collocations(documents: DataFrame, max_n: int = 3, least: int = 10, explained: int = 50, most: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's `most` best phrases of 2 to max_n words.

    a: occurrences of the phrase, `least` or more; l and r: of the two parts at the cut that scores lowest, ties to the first;
    n: all words of the language; score: floor(1000000 a a / (l r)), exact for counts up to 10^15. A phrase goes if a
    longer one that holds it has `explained` percent of its occurrences. (If any such phrase has, then also one of a
    single word more, which occurs no less.) Ranks by score, a (both descending), phrase.

    A-Z count as a-z. Texts part at `[.,;:!?\\x0A-\\x0D]` into pieces, these at spaces and tabs into words; n-grams stay
    within a piece and may overlap. Null languages are `und`, null texts empty; repeated rows count each; an empty table
    gives no rows; further columns are not read. At most `most` rows a language."""
    if max_n < 2:
        raise ValueError("a phrase has two words at least")
    grams, every = ngram_counts(documents, max_n, least)
    candidates = grams.where("size > 1")
    cuts = candidates.select("lang", "phrase", "size", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "size", "a", "k", _cut(True).alias("first"), _cut(False).alias("rest"))
    cuts = _with_count(_with_count(cuts, grams, "first", "l"), grams, "rest", "r")
    whole = lambda c, digits=15: f"cast({c} as decimal({digits},0))"
    score = F.expr(f"({whole('a')} * {whole('a')} * {whole('1000000', 7)}) div ({whole('l')} * {whole('r')})")
    lowest = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("c"))
    longer = candidates.where("size > 2")
    ends = F.explode(F.array(F.expr("substring_index(phrase, ' ', size - 1)"), F.expr("substring_index(phrase, ' ', 1 - size)"))).alias("phrase")
    longer = longer.select("lang", ends, "n").groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    longer = longer.join(candidates.select("lang", "phrase", F.col("n").alias("a")), ["lang", "phrase"]).where(F.lit(100) * F.col("longer") >= F.lit(explained) * F.col("a"))
    kept = lowest.join(longer.select("lang", "phrase"), ["lang", "phrase"], "left_anti")
    kept = kept.select("lang", "phrase", "a", F.col("c.l").alias("l"), F.col("c.r").alias("r"), F.col("c.score").alias("score"))
    order = [F.col("score").desc(), F.col("a").desc(), "phrase"]
    # a part's best are few, so the last window gets at most PARTS * most rows of a language
    kept = kept.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= most)
    kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= most)
    return kept.join(every, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
