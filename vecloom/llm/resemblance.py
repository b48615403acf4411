"""Near copies of whole texts: SimHash fingerprints by anchor covering, and what these miss by bands of minima.

Texts whose sets of five-word shingles have a Jaccard similarity of 0.8 differ in about 10 of 64 fingerprint bits, which
no covering of 4 bits reaches. So beside the links of `simhash.close_links`, texts that share a band (five of 125 minima of
their shingles' hashes) are compared: a pair at 0.8 shares one of the 25 bands with a probability of 0.99995. Of each band's
texts only a maximum spanning forest by the share of equal minima leaves the task, as it holds together what any
threshold would. Its links are taken where nearly all minima agree, and otherwise held against the texts themselves."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASE, HOT, components, hash_words, join_dealt, materialize, mix, ranges_of, slices, text_of
from .simhash import close_links, fingerprints_of

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 25, 5
MINIMA = BANDS * ROWS
#: Of texts at 0.8, one in 200,000 has fewer equal minima than FLOOR, and one in 20,000 has SURE or more by chance.
FLOOR, SURE = 80, 118
#: Texts of a band that are compared in one task; a fuller band is dealt out by pairs of parts of so many.
TILE = 1024

_U = np.uint64
_TURNS = mix(np.arange(1, MINIMA + 1, dtype=_U) * _U(BASE)) | _U(1)


def shingles_of(raw: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of each text's shingles of lowered words, repeats included, and each text's number of them; fewer words are one shingle."""
    h, counts, _, _ = hash_words(raw, offsets)
    upto = np.concatenate([[0], np.cumsum(counts)])
    many = np.where(counts > 0, np.maximum(counts - words + 1, 1), 0)
    at, end = ranges_of(upto[:-1], many), np.repeat(upto[1:], many)
    s = np.zeros(len(at), _U)
    with np.errstate(over="ignore"):
        for j in range(words):
            inside = at + j < end
            s[inside] = s[inside] * _U(BASE) + h[at[inside] + j]
        return mix(s), many


def sketch(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text: 128 bits of its shingles with their counts, a byte of each minimum, and the band keys (none without words: zeros)."""
    n = len(offsets) - 1
    s, many = shingles_of(raw, offsets)
    whole, low = np.zeros((n, 2), _U), np.zeros((n, MINIMA), _U)
    some = np.flatnonzero(many)
    if len(some):
        first = (np.cumsum(many) - many)[some]
        with np.errstate(over="ignore"):
            whole[some, 0] = np.add.reduceat(s, first)
            whole[some, 1] = np.add.reduceat(mix(s * _U(BASE)), first)
            for i in range(MINIMA):
                low[some, i] = np.minimum.reduceat(s * _TURNS[i], first)
    with np.errstate(over="ignore"):
        low = mix(low)
        keys = np.zeros((n, BANDS), _U)
        for j in range(ROWS):
            keys = keys * _U(BASE) + low[:, j::ROWS]
        keys = mix(keys + np.arange(BANDS, dtype=_U))
    keys[many == 0] = 0
    return whole, (low >> _U(56)).astype(np.uint8), keys


def _fixed(column: pa.Array, width: int) -> np.ndarray:
    """The bytes of a binary column whose values all have one width."""
    column = column.cast(pa.binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32, len(column) + 1, column.offset * 4)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]].reshape(-1, width)


def _binary(x: np.ndarray) -> pa.Array:
    x = np.ascontiguousarray(x)
    n, width = len(x), x.dtype.itemsize * x.shape[1]
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), n, [None, pa.py_buffer(x)]).cast(pa.binary())


def sketches(rows: DataFrame) -> DataFrame:
    """own, fp, cls (16 bytes: equal for equal shingles), sig (a byte a minimum) and bands of rows (own, text), whole texts; null texts are empty."""
    texts = rows.select("own", F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_of(batch.column("text"))
            for i, j in slices(offsets):
                part, at = raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                whole, sig, keys = sketch(part, at)
                fp = fingerprints_of(part, at, WORDS, 42).view(np.int64)
                solid = keys.any(axis=1)
                bands = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(solid * BANDS)]), pa.int32()), pa.array(keys[solid].ravel().view(np.int64)))
                columns = [batch.column("own").slice(i, j - i), pa.array(fp), _binary(whole), _binary(sig), bands]
                yield pa.RecordBatch.from_arrays(columns, ["own", "fp", "cls", "sig", "bands"])

    return texts.mapInArrow(run, f"own {rows.schema['own'].dataType.simpleString()}, fp long, cls binary, sig binary, bands array<long>")


def spanning(sig: np.ndarray, floor: int) -> list[tuple[int, int, int]]:
    """(i, j, equal minima): a maximum spanning forest of all pairs with `floor` or more equal minima, grown from point to point."""
    m = len(sig)
    best, near, left = np.full(m, -1), np.zeros(m, np.int64), np.ones(m, bool)
    found, i = [], 0
    for _ in range(m - 1):
        left[i] = False
        equal = (sig == sig[i]).sum(axis=1)
        more = left & (equal > best)
        best[more], near[more] = equal[more], i
        i = int(np.where(left, best, -2).argmax())
        if best[i] >= floor:
            found.append((int(near[i]), i, int(best[i])))
    return found


def band_links(classes: DataFrame) -> DataFrame:
    """(a, b, equal): of the texts (cls, sig, bands) of each band a maximum spanning forest, with a < b and each pair once.

    Band keys of one text alone go before signatures are moved. A band of more than TILE texts is dealt out: each pair of its parts
    is a group of its own."""
    keys = materialize(classes.select("cls", F.explode("bands").alias("key")), "bands")
    counts = materialize(keys.groupBy("key").agg(F.count(F.lit(1)).alias("many")).where("many > 1"), "counts")
    crowd = counts.where(F.col("many") > (keys.count() or 0) * HOT)
    met = join_dealt(keys, counts, ["key"], crowd).withColumn("parts", F.ceil(F.col("many") / TILE))
    met = met.withColumn("part", F.pmod(F.xxhash64("cls"), F.col("parts"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    met = met.select("cls", F.xxhash64("key", F.least("part", "other"), F.greatest("part", "other")).alias("met"))
    met = met.join(classes.select("cls", "sig"), "cls").repartition("met").sortWithinPartitions("met", "cls")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64), np.zeros((0, 16), np.uint8), np.zeros((0, MINIMA), np.uint8)
        held = none  # the group that may go on in the next batch

        def pairs(key: np.ndarray, cls: np.ndarray, sig: np.ndarray) -> Iterator[pa.RecordBatch]:
            if not len(key):
                return
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]])
            size = np.diff(cuts)
            two = cuts[:-1][size == 2]
            equal = (sig[two] == sig[two + 1]).sum(axis=1)
            close = equal >= FLOOR
            i, j, e = [two[close]], [two[close] + 1], [equal[close]]
            for g in np.flatnonzero(size > 2).tolist():
                if got := spanning(sig[cuts[g] : cuts[g + 1]], FLOOR):
                    a, b, c = np.array(got).T
                    i, j, e = [*i, a + cuts[g]], [*j, b + cuts[g]], [*e, c]
            i, j, e = np.concatenate(i), np.concatenate(j), np.concatenate(e)
            i, j = np.minimum(i, j), np.maximum(i, j)  # ordered by cls within a group
            yield pa.RecordBatch.from_arrays([_binary(cls[i]), _binary(cls[j]), pa.array(e, pa.int64())], ["a", "b", "equal"])

        for batch in batches:
            if not batch.num_rows:
                continue
            new = batch.column("met").to_numpy(), _fixed(batch.column("cls"), 16), _fixed(batch.column("sig"), MINIMA)
            key, cls, sig = (np.concatenate(x) for x in zip(held, new, strict=True))
            last = int(np.searchsorted(key, key[-1]))
            held = key[last:], cls[last:], sig[last:]
            yield from pairs(key[:last], cls[:last], sig[:last])
        yield from pairs(*held)

    return met.mapInArrow(compare, "a binary, b binary, equal long").groupBy("a", "b").agg(F.max("equal").alias("equal"))


def similar(pairs: DataFrame, texts: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b) of pairs whose texts (cls, text) have a Jaccard similarity of `similarity` or more between their sets of shingles' 64-bit hashes."""
    one, two = texts.select(F.col("cls").alias("a"), F.col("text").alias("x")), texts.select(F.col("cls").alias("b"), F.col("text").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            sides = [text_of(batch.column(c)) for c in ("x", "y")]
            for r in range(batch.num_rows):
                x, y = (np.unique(shingles_of(raw[at[r] : at[r + 1]], np.array([0, at[r + 1] - at[r]]))[0]) for raw, at in sides)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep[r] = both >= similarity * (len(x) + len(y) - both)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(run, "a binary, b binary")


def keep_one(documents: DataFrame) -> DataFrame:
    """Of each group of near copies one row, with all its columns: that of the smallest doc_id (null last).

    Linked are texts whose SimHash fingerprints of five-word shingles differ in at most 4 bits, and texts whose sets of
    five-word shingles have a Jaccard similarity of 0.8 or more; groups are what chains of links reach. Texts with fewer words are
    one shingle, null texts and those without words are all alike. Groups decide, not doc_ids: rows that repeat a doc_id
    or have none are documents of their own, known by 128 bits of doc_id and text; rows that agree in both are copies, of
    which one stays. Further columns of any name are kept."""
    first, second = F.xxhash64("doc_id", "text"), F.xxhash64(F.lit(BASE >> 1), "doc_id", "text")
    own = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", first.alias("first"), second.alias("second"))
    rows = materialize(sketches(documents.select(own.alias("own"), "text")), "sketches")
    classes = rows.groupBy("cls").agg(F.min("own").alias("least"), *(F.any_value(c).alias(c) for c in ("fp", "sig", "bands")))
    classes = materialize(classes, "classes")
    heads = materialize(classes.groupBy("fp").agg(F.min("cls").alias("head")), "heads")
    close = close_links(heads.select("fp")).join(heads.select(F.col("fp").alias("a"), F.col("head").alias("x")), "a")
    close = close.join(heads.select(F.col("fp").alias("b"), F.col("head").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    alike = classes.join(heads, "fp").where("cls <> head").select(F.col("cls").alias("a"), F.col("head").alias("b"))
    banded = materialize(band_links(classes), "banded")
    links = materialize(close.union(alike).union(banded.where(F.col("equal") >= SURE).select("a", "b")), "sure")
    roots = components(links)
    for side in ("a", "b"):
        banded = banded.join(roots.select(F.col("node").alias(side), F.col("root").alias(f"{side}_root")), side, "left")
    unsure = banded.where((F.col("equal") < SURE) & (F.coalesce("a_root", "a") != F.coalesce("b_root", "b"))).select("a", "b")
    unsure = materialize(unsure, "unsure")
    wanted = classes.join(unsure.select(F.explode(F.array("a", "b")).alias("cls")).distinct(), "cls").select("cls", "least.first", "least.second")
    texts = documents.select(first.alias("first"), second.alias("second"), F.coalesce("text", F.lit("")).alias("text"))
    texts = materialize(texts.join(wanted, ["first", "second"]).select("cls", "text").dropDuplicates(["cls"]), "texts")
    roots = components(links.union(similar(unsure, texts)))
    lowest = classes.join(roots, classes["cls"] == roots["node"], "left").groupBy(F.coalesce("root", "cls")).agg(F.min("least").alias("own"))
    stay = lowest.select("own.first", "own.second")
    named = documents.select(F.struct(*documents.columns).alias("row"), first.alias("first"), second.alias("second"))
    return named.join(stay, ["first", "second"], "left_semi").dropDuplicates(["first", "second"]).select("row.*")
