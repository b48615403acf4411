"""SimHash near-duplicates by anchor-point covering.

Fingerprints of 64 bits are cut into blocks of 22, 21 and 21 bits. Of two fingerprints that differ in at most 4 bits,
some pair of blocks differs in at most 2 bits in all, as the third block takes at least its share. A block, filled up
with zeros to 23 bits, is covered by the 4,096 words of the binary Golay code, whose covering radius is 3. Anchors are
pairs of code words, one for each block of a pair: 3 x 2^24 of them, so that comparisons stay few as tables grow.
Between two fingerprints that differ in at most 2 bits of a pair of blocks lies a point at most 1 bit from either. The
code words next to that point are within 3 + 1 of both in one block, and within 3 in the other, where they are the
fingerprint's own nearest. So each fingerprint is replicated to the anchors within the covering radius plus half of the
pair's threshold (about 29 in all), and an anchor's fingerprints are compared with each other on the full 64 bits."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT, components, forest, join_dealt, lower_table, materialize, slices, space_table, text_of

GENERATOR = 0xC75  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1, of the binary Golay code
BLOCKS = ((0, 22), (22, 21), (43, 21))
PAIRS = ((0, 1), (0, 2), (1, 2))
#: Fingerprints of an anchor that are compared in one task; a fuller anchor is dealt out in tiles of so many by so many.
TILE = 16_384
#: An anchor of more fingerprints than this is compared as a matrix, others all together by their distance in the order of anchors.
FEW = 48
#: Shingles that are hashed at once; longer ones than LONG bytes are hashed one by one.
SHINGLES, LONG = 1 << 17, 2_048

_U = np.uint64
_LOWER, _SPACE = lower_table(), space_table()
#: Fixed by XXH64.
_P = [_U(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x << _U(n)) | (x >> _U(64 - n))


def _round(acc: np.ndarray, x: np.ndarray) -> np.ndarray:
    return _turn(acc + x * _P[1], 31) * _P[0]


def xxh64(raw: np.ndarray, start: np.ndarray, length: np.ndarray, seed: int) -> np.ndarray:
    """XXH64 of raw[start : start + length] for each place; raw goes on for 8 bytes after the last of them."""
    eight = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
    four = np.ndarray((len(raw) - 3,), "<u4", raw, strides=(1,))
    with np.errstate(over="ignore"):
        acc = np.full(len(start), seed, _U) + _P[4]
        stripes = length // 32
        if (long := np.flatnonzero(stripes)).size:
            v = [np.full(len(long), seed, _U) + x for x in (_P[0] + _P[1], _P[1], _U(0), _U(0) - _P[0])]
            for s in range(int(stripes.max())):
                own = np.flatnonzero(stripes[long] > s)
                at = start[long[own]] + 32 * s
                for k in range(4):
                    v[k][own] = _round(v[k][own], eight[at + 8 * k])
            total = _turn(v[0], 1) + _turn(v[1], 7) + _turn(v[2], 12) + _turn(v[3], 18)
            for x in v:
                total = (total ^ _round(np.zeros(len(x), _U), x)) * _P[0] + _P[3]
            acc[long] = total
        acc += length.astype(_U)
        at, rest = start + 32 * stripes, length % 32
        for _ in range(3):
            own = np.flatnonzero(rest >= 8)
            word = _round(np.zeros(len(own), _U), eight[at[own]])
            acc[own] = _turn(acc[own] ^ word, 27) * _P[0] + _P[3]
            at[own] += 8
            rest[own] -= 8
        own = np.flatnonzero(rest >= 4)
        acc[own] = _turn(acc[own] ^ (four[at[own]].astype(_U) * _P[0]), 23) * _P[1] + _P[2]
        at[own] += 4
        rest[own] -= 4
        for _ in range(3):
            own = np.flatnonzero(rest > 0)
            acc[own] = _turn(acc[own] ^ (raw[at[own]].astype(_U) * _P[4]), 11) * _P[0]
            at[own] += 1
            rest[own] -= 1
        acc = (acc ^ (acc >> _U(33))) * _P[1]
        acc = (acc ^ (acc >> _U(29))) * _P[2]
    return acc ^ (acc >> _U(32))


_LANES = _U(0x0101010101010101)


def _count_bits(h: np.ndarray, text: np.ndarray, ones: np.ndarray) -> None:
    """Adds each text's set bits to ones (texts, 64): eight counters of a byte lie in a word, for up to 255 hashes at a time."""
    new = np.diff(text, prepend=-1) != 0
    begin = np.flatnonzero(new)
    place = np.arange(len(text)) - np.repeat(begin, np.diff(begin, append=len(text)))
    cuts = np.flatnonzero(place % 255 == 0)
    for bit in range(8):
        sums = np.add.reduceat((h >> _U(bit)) & _LANES, cuts)
        np.add.at(ones[:, bit::8], text[cuts], sums.view(np.uint8).reshape(-1, 8))


def fingerprints_of(raw: np.ndarray, offsets: np.ndarray, words: int, seed: int) -> np.ndarray:
    """The fingerprint of each text (UTF-8 bytes and offsets): lines of lowered words with one space between them, hashed by shingle."""
    n = len(offsets) - 1
    solid = ~_SPACE[raw]
    head = solid.copy()
    head[1:] &= ~solid[:-1]
    inner = offsets[:-1][(offsets[:-1] > 0) & (offsets[:-1] < len(raw))]
    head[inner] = solid[inner]  # no word crosses from one text to the next
    starts = np.flatnonzero(head)
    if not len(starts):
        return np.zeros(n, _U)
    where = np.flatnonzero(solid)
    first = np.searchsorted(where, starts)
    size = np.diff(first, append=len(where))
    line = np.full(len(where) + len(starts) + 40, 0x20, np.uint8)
    line[np.arange(len(where)) + np.repeat(np.arange(len(starts)), size)] = _LOWER[raw[where]]
    begin = first + np.arange(len(starts))
    end = begin + size
    upto = np.searchsorted(starts, offsets)
    count = np.diff(upto)
    shingles = np.where(count > 0, np.maximum(count - words + 1, 1), 0)
    upto_shingle = np.concatenate([[0], np.cumsum(shingles)])
    ones = np.zeros((n, 64), np.int64)
    for low in range(0, int(upto_shingle[-1]), SHINGLES):
        k = np.arange(low, min(low + SHINGLES, int(upto_shingle[-1])))
        text = np.searchsorted(upto_shingle, k, "right") - 1
        word = upto[text] + k - upto_shingle[text]
        at, length = begin[word], end[np.minimum(word + words, upto[text + 1]) - 1] - begin[word]
        h = np.zeros(len(k), _U)
        usual = length <= LONG
        h[usual] = xxh64(line, at[usual], length[usual], seed)
        for i in np.flatnonzero(~usual).tolist():
            h[i] = xxhash.xxh64_intdigest(line[at[i] : at[i] + length[i]].tobytes(), seed)
        _count_bits(h, text, ones)
    over = ones * 2 > shingles[:, None]
    return np.packbits(over, axis=1, bitorder="little").view(_U).ravel()


def fingerprints(documents: DataFrame, words: int = 4, seed: int = 42) -> DataFrame:
    """doc_id, fp (long) of whole texts.

    A-Z is lowered, words are `[^\\x20\\x09-\\x0D]+`, shingles of `words` words count as often as they occur; a text
    with fewer words is one shingle, one without words (or null) has fingerprint zero. A bit is 1 if it is set in
    over half of the shingles' XXH64."""
    docs = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_of(batch.column("text"))
            found = [fingerprints_of(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], words, seed) for i, j in slices(offsets)]
            out = np.concatenate([np.zeros(0, _U), *found])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out.view(np.int64))], ["doc_id", "fp"])

    return docs.mapInArrow(run, f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, fp long")


@functools.lru_cache(1)
def covering() -> tuple[np.ndarray, np.ndarray]:
    """Syndromes of all 23-bit unit vectors, and for each syndrome the error patterns of weight up to 4, lightest first (-1: none)."""
    unit = np.zeros(23, np.int64)
    for i in range(23):
        r = 1 << i
        for top in range(22, 10, -1):
            if r >> top & 1:
                r ^= GENERATOR << (top - 11)
        unit[i] = r
    patterns, syndromes = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)]
    last = np.full(1, -1)
    for _ in range(4):
        e, s, top = patterns[-1], syndromes[-1], last
        more = [(e[top < i] | (1 << i), s[top < i] ^ unit[i], np.full(int((top < i).sum()), i)) for i in range(23)]
        patterns.append(np.concatenate([m[0] for m in more]))
        syndromes.append(np.concatenate([m[1] for m in more]))
        last = np.concatenate([m[2] for m in more])
    e, s = np.concatenate(patterns), np.concatenate(syndromes)
    order = np.argsort(s, kind="stable")  # weights ascend within a syndrome
    e, s = e[order], s[order]
    place = np.arange(len(s)) - np.searchsorted(s, s)
    table = np.full((2048, int(place.max()) + 1), -1, np.int64)
    table[s, place] = e
    return unit, table


def _code_words(x: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each block's nearest code word, and (row, code word) of all others within 3 + 1 of it."""
    unit, table = covering()
    s = np.zeros(len(x), np.int64)
    for i in range(bits):
        s ^= np.where(x >> i & 1, unit[i], 0)
    e = table[s]
    row, col = np.nonzero(e[:, 1:] >= 0)
    return x ^ e[:, 0], row, x[row] ^ e[row, col + 1]


def anchors(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor) for every anchor that a fingerprint goes to; an anchor is a pair of blocks and a code word for each."""
    near = [_code_words(((fp >> _U(low)) & _U((1 << bits) - 1)).astype(np.int64), bits) for low, bits in BLOCKS]
    rows, keys = [], []
    for p, (i, j) in enumerate(PAIRS):
        (home_i, row_i, word_i), (home_j, row_j, word_j) = near[i], near[j]
        rows += [np.arange(len(fp)), row_i, row_j]
        keys += [(x << 23 | y) | (p << 46) for x, y in ((home_i, home_j), (word_i, home_j[row_i]), (home_i[row_j], word_j))]
    return np.concatenate(rows), np.concatenate(keys)


def _near(x: np.ndarray, y: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Forest links among all pairs of x and y at no more than `threshold` differing bits."""
    a, b = [np.zeros(0, _U)], [np.zeros(0, _U)]
    for p in range(0, len(x), 1024):
        for q in range(0, len(y), 4096):
            r, c = np.nonzero(np.bitwise_count(x[p : p + 1024, None] ^ y[None, q : q + 4096]) <= threshold)
            got = forest(x[p + r], y[q + c])
            a.append(got[0])
            b.append(got[1])
    return forest(np.concatenate(a), np.concatenate(b))


def close_links(prints: DataFrame, threshold: int = 4) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp) at `threshold` or fewer differing bits.

    Of each piece of comparisons only a spanning forest of its links is returned: no link between groups is
    lost, and a dense group does not give its pairs. An anchor that is fuller than a tile is not compared where it is met
    but passed on, and dealt out by tiles. The threshold is at most 4, as the blocks are laid out for it; an empty
    table has no links."""
    if threshold > 4:
        raise ValueError("the blocks cover thresholds up to 4")
    tile, most = TILE, min(FEW, TILE)

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 65_536):
                fp = batch.column("fp").to_numpy()[i : i + 65_536].view(_U)
                row, key = anchors(fp)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[row].view(np.int64))], ["anchor", "fp"])

    def out(a: np.ndarray, b: np.ndarray, anchor: int | None = None, group: int | None = None) -> pa.RecordBatch:
        named = (pa.array([x] * len(a) if x is None else np.full(len(a), x, np.int64), pa.int64()) for x in (anchor, group))
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), *named], ["a", "b", "anchor", "part"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, groups = None, np.zeros(0, _U), 0  # the anchor that may go on in the next batch; tiles of it passed on

        def settled():
            if groups:
                return out(held, held, now, groups)
            return out(*_near(held, held, threshold)) if len(held) > 1 else None

        for batch in batches:
            if not batch.num_rows:
                continue
            key, fp = batch.column("anchor").to_numpy(), batch.column("fp").to_numpy().view(_U)
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]])
            size = np.diff(cuts)
            few = size <= most
            few[[0, -1]] = False  # the first may have begun before, the last may go on
            ai, bi = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            small = np.flatnonzero(np.repeat(few, size))
            step = 1
            while len(small) > step:
                one, two = small[:-step], small[step:]
                same = key[one] == key[two]
                if not same.any():
                    break
                one, two = one[same], two[same]
                close = np.bitwise_count(fp[one] ^ fp[two]) <= threshold
                ai.append(one[close])
                bi.append(two[close])
                step += 1
            ai, bi = np.concatenate(ai), np.concatenate(bi)
            if len(ai):
                yield out(*forest(fp[ai], fp[bi]))
            for g in np.flatnonzero(~few).tolist():
                i, j = cuts[g], cuts[g + 1]
                if key[i] != now:
                    if (last := settled()) is not None:
                        yield last
                    now, held, groups = int(key[i]), np.zeros(0, _U), 0
                held = np.concatenate([held, fp[i:j]])
                while len(held) > tile:
                    yield out(held[:tile], held[:tile], now, groups)
                    held, groups = held[tile:], groups + 1
        if (last := settled()) is not None:
            yield last

    kinds = "a long, b long, anchor long, part long"
    met = prints.mapInArrow(replicate, "anchor long, fp long").repartition("anchor").sortWithinPartitions("anchor")
    met = materialize(met.mapInArrow(compare, kinds), "compared")
    links, passed = met.where("anchor is null").select("a", "b"), met.where("anchor is not null")
    return links.union(_tiled(passed.select("anchor", F.col("part").alias("own"), F.col("a").alias("fp")), threshold))


def _tiled(passed: DataFrame, threshold: int) -> DataFrame:
    """(a, b) among the fingerprints of full anchors (anchor, own, fp): each pair of an anchor's tiles meets in a task of its own."""
    tiles = passed.groupBy("anchor").agg(F.max("own").alias("last"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("last")))
    met = passed.join(tiles, "anchor").withColumn("other", other)
    met = met.select("anchor", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), (F.col("own") > F.col("other")).alias("second"), "fp")

    def run(table: pa.Table) -> pa.Table:
        fp, second = table.column("fp").to_numpy().view(_U), table.column("second").to_numpy()
        a, b = _near(fp[~second], fp[second] if second.any() else fp, threshold)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    return met.groupBy("anchor", "x", "y").applyInArrow(run, "a long, b long")


def near_duplicates(documents: DataFrame, words: int = 4, threshold: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every document.

    component_id is the smallest doc_id that chains of links reach, itself included. Exact copies share a
    fingerprint and are compared once; a fingerprint that very many rows share is dealt out when they get their
    component. Repeated rows are kept, each gets the same result. A null doc_id is grouped like any other, but is never
    a component_id unless its whole component has none. Null and empty texts are linked as fingerprint zero is."""
    prints = materialize(fingerprints(documents, words), "fingerprints")
    classes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("rows")), "classes")
    roots = materialize(components(close_links(classes.select("fp"), threshold)), "components")
    grouped = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    lowest = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    named = grouped.join(lowest, "root").select("fp", "component_id")
    crowd = classes.where(F.col("rows") > (classes.agg(F.sum("rows")).first()[0] or 0) * HOT)
    return join_dealt(prints, named, ["fp"], crowd).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(documents: DataFrame, words: int = 4, threshold: int = 4) -> DataFrame:
    """Of each component of linked fingerprints one row, with all its columns: that of the smallest doc_id (null last).

    Components decide, not doc_ids: rows that repeat a doc_id or have none are documents of their own, known by a
    hash of doc_id and text. Rows that agree in both are copies, of which one stays."""
    rid = F.xxhash64("doc_id", "text")
    own = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", rid.alias("rid"))  # the order within a component
    grouped = near_duplicates(documents.select(own.alias("doc_id"), "text"), words, threshold)
    stay = grouped.where("doc_id = component_id").select(F.col("doc_id.rid").alias("__rid")).distinct()
    return documents.withColumn("__rid", rid).join(stay, "__rid", "left_semi").dropDuplicates(["__rid"]).select(*documents.columns)
