"""Exact removal of repeated passages with a logarithmic family of suffix arrays.

1. Runs. Each window of `length` bytes has a lowest k-gram hash (a minimizer). Consecutive windows that share it form
   a run; equal windows lie in runs of the same minimizer, wherever they are. There is a run for about every
   85 bytes, so this is what is shuffled, not the windows. A run of more windows, as of one phrase repeated, is cut.
2. Keys. A minimizer met once repeats nothing. Where all runs of a minimizer cover the same text, every window
   of them is repeated. Only minimizers with differing texts - where a repeated passage begins or ends - go on.
3. Index family. Documents come in batches. A batch's differing texts, one representative of each, are merge-scanned
   against all levels of the family for matches of the full length: texts and levels meet by minimizer, where their
   suffix arrays (all suffixes that begin a window, in lexicographic order) are compared. Then they become a level
   themselves, a sorted table in the shared folder, and levels of equal rank merge, so that there are logarithmically
   many and a text is rewritten logarithmically often.
   Within a task, too, arrays are kept in levels. A minimizer with more runs or windows than a task should hold is
   settled by an exchange of window hashes instead.
4. The repeated windows go back to their documents, which are rid of the bytes they cover."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BASE_INVERSE, HOT, byte_table, join_dealt, materialize, mix, powers, slices, text_of

#: Bytes of text of one vectorised step.
STEP = 256 << 10
#: A minimizer with more runs than this, or more windows in all its runs, is settled by an exchange.
MOST_RUNS, MOST_WINDOWS = 8_192, 1 << 20
#: Windows of a run at most; a longer run is cut.
RUN_WINDOWS = 16_384
#: Suffixes that are sorted at once.
SUFFIXES = 32_768
#: Batches of documents, of about equal size, that a table comes in.
BATCHES = 4
_MAX = np.uint64(0xFFFFFFFFFFFFFFFF)


def _sliding(x: np.ndarray, w: int, pick) -> np.ndarray:
    """pick (np.minimum or np.maximum) over each w consecutive elements."""
    size = 1
    while size * 2 <= w:
        x = pick(x[:-size], x[size:])
        size *= 2
    return pick(x[: len(x) - (w - size)], x[w - size :]) if w > size else x


def _prefix(raw: np.ndarray) -> np.ndarray:
    out = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(byte_table()[raw] * powers(len(raw)), out=out[1:])
    return out


def _hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Of raw[start:end], wherever it lies."""
    inverse = powers(len(prefix), BASE_INVERSE)
    return mix((prefix[end] - prefix[start]) * inverse[start] + (end - start).astype(np.uint64))


def runs_of(raw: np.ndarray, offsets: np.ndarray, length: int, gram: int, most: int = RUN_WINDOWS):
    """(text, first window, windows, minimizer, hash of the covered bytes, may repeat itself) of every run."""
    n, w = len(raw), length - gram + 1
    if n < length:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, bool),)
    prefix = _prefix(raw)
    inverse = powers(n + 1, BASE_INVERSE)
    h = mix((prefix[gram:] - prefix[:-gram]) * inverse[: n - gram + 1])
    low = _sliding(h, w, np.minimum)
    size = np.diff(offsets)
    left = np.repeat(offsets[1:], size)[: len(low)] - np.arange(len(low))
    valid = left >= length
    change = np.ones(len(low) + 1, bool)
    change[1:-1] = (low[1:] != low[:-1]) | (valid[1:] != valid[:-1])
    cut = np.flatnonzero(change)
    start, end = cut[:-1], cut[1:]
    good = valid[start]
    start, end = start[good], end[good]
    pieces = -(-(end - start) // most)
    first = np.repeat(start, pieces)
    start = first + most * (np.arange(len(first)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    end = np.minimum(start + most, np.repeat(end, pieces))
    key = low[start]
    # a run can repeat itself only if its minimizer's k-gram stands in it twice, at most w apart
    high = _sliding(np.concatenate([np.zeros(w - 1, np.uint64), low, np.zeros(w - 1, np.uint64)]), w, np.maximum)
    at = np.flatnonzero(h == high[: len(h)])
    order = np.lexsort((at, h[at]))
    at = at[order]
    twice = (h[at[1:]] == h[at[:-1]]) & (at[1:] - at[:-1] <= w)
    tie = np.isin(key, h[at[1:][twice]])
    text = np.searchsorted(offsets, start, "right") - 1
    return text, start - offsets[text], end - start, key, _hash(prefix, start, end - 1 + length), tie


def find_runs(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """start, n, key, span, tie of rows with a text, behind the columns that name the row. A text longer than a step is taken by steps that overlap by length - 1 bytes."""
    step, most = STEP, RUN_WINDOWS
    own = [c for c in rows.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*own, "start", "n", "key", "span", "tie"]
        for batch in batches:
            raw, offsets = text_of(batch.column("text"))
            ids = [batch.column(c).to_numpy() for c in own]
            found = []
            for i, j in slices(offsets, step):
                for low in range(offsets[i], offsets[j], step) if j == i + 1 else [offsets[i]]:
                    part = raw[low : min(low + step + length - 1, offsets[j]) if j == i + 1 else offsets[j]]
                    bounds = np.array([0, len(part)]) if j == i + 1 else offsets[i : j + 1] - low
                    text, start, n, key, span, tie = runs_of(part, bounds, length, gram, most)
                    found.append((*(x[i + text] for x in ids), (start + (low - offsets[i])).astype(np.int32), n.astype(np.int32), key.view(np.int64), span.view(np.int64), tie))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], names)

    return rows.mapInArrow(run, ", ".join(f"{c} long" for c in own) + ", start int, n int, key long, span long, tie boolean")


class Levels:
    """Suffix arrays of one minimizer's texts; equal-sized ones merge, as the digits of a binary counter do.

    Of equal windows the levels hold one, which stands for all that were reported. A window is fresh if it is, or equals one, of the batch:
    what only levels of the family share was reported when they were batches."""

    def __init__(self):
        self.arrays: list[list[np.ndarray]] = []  # [sorted windows, owner, offset, whether it was reported, whether it is fresh]

    def scan(self, windows: np.ndarray, owner: np.ndarray, offset: np.ndarray, fresh: np.ndarray):
        """Sorts a batch into a suffix array; (owner, offset) of all its windows that are repeated in it or in a level, and of the levels' that are so for the first time."""
        order = np.argsort(windows, kind="stable")
        windows, owner, offset, fresh = windows[order], owner[order], offset[order], fresh[order]
        same = windows[1:] == windows[:-1]
        hit = np.zeros(len(windows), bool)
        hit[1:] |= same
        hit[:-1] |= same
        if not fresh.all():
            group = np.cumsum(np.append(True, ~same)) - 1
            fresh = (np.bincount(group, fresh) > 0)[group]
            hit &= fresh
        once = np.ones(len(windows), bool)  # the first of equal windows, if no level has it
        once[1:] = ~same
        out = []
        for level in self.arrays:
            if not len(level[0]):
                continue
            at = np.minimum(np.searchsorted(level[0], windows), len(level[0]) - 1)
            met = level[0][at] == windows
            told = met & (fresh | level[4][at])
            hit |= told
            once &= ~met
            new = np.zeros(len(level[0]), bool)
            new[at[told]] = True
            level[4][at[met & fresh]] = True
            new &= ~level[3]
            level[3] |= new
            out.append((level[1][new], level[2][new]))
        out.append((owner[hit], offset[hit]))
        return [windows[once], owner[once], offset[once], hit[once], fresh[once]], tuple(np.concatenate(c) for c in zip(*out, strict=True))

    def add(self, array: list[np.ndarray]) -> None:
        self.arrays.append(array)
        while len(self.arrays) > 1 and len(self.arrays[-2][0]) <= 2 * len(self.arrays[-1][0]):
            b, a = self.arrays.pop(), self.arrays.pop()
            joined = [np.concatenate(c) for c in zip(a, b, strict=True)]
            order = np.argsort(joined[0], kind="stable")  # two sorted runs: a merge
            self.arrays.append([c[order] for c in joined])


def _ranges(owner: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, first offset, count) of maximal runs of offsets."""
    order = np.lexsort((offset, owner))
    owner, offset = owner[order], offset[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (offset[1:] > offset[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(owner)) - 1
    return owner[first], offset[first], offset[last] - offset[first] + 1


def match_texts(texts: DataFrame, levels: list[DataFrame], length: int) -> DataFrame:
    """key, span, at, n: windows of texts (key, span, text; one for each span) that stand twice among their key's texts or
    also in one of the levels, and those of the levels that stand in the texts, too."""

    def windows_of(data: list[bytes], owners: np.ndarray, fresh: np.ndarray):
        raw = np.frombuffer(b"".join(data), np.uint8)
        sizes = np.array([len(x) for x in data], np.int64)
        count = sizes - length + 1
        first = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        offset = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        view = np.ndarray((len(raw) - length + 1,), f"S{length}", raw, strides=(1,))
        return view[np.repeat(first, count) + offset], np.repeat(owners, count), offset, np.repeat(fresh, count)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, levels, kept = None, Levels(), (np.zeros(0, np.int64), np.zeros(0, np.int64))
        for batch in batches:
            keys, spans, fresh = batch.column("key").to_numpy(), batch.column("span").to_numpy(), batch.column("fresh").to_numpy(zero_copy_only=False)
            data = batch.column("text").to_pylist()
            sizes = np.cumsum([len(x) for x in data])
            i = 0
            while i < len(data):
                j = max(int(np.searchsorted(sizes, (sizes[i - 1] if i else 0) + SUFFIXES * 2)), i + 1)
                if keys[i] != now:
                    levels, kept = Levels(), (np.zeros(0, np.int64), np.zeros(0, np.int64))
                base = len(kept[0])
                held = np.concatenate([kept[0], keys[i:j]]), np.concatenate([kept[1], spans[i:j]])
                array, (owner, offset) = levels.scan(*windows_of(data[i:j], np.arange(base, base + j - i), fresh[i:j]))
                if len(owner):
                    owner, first, n = _ranges(owner, offset)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (held[0][owner], held[1][owner], first, n)], ["key", "span", "at", "n"])
                now = keys[j - 1]  # only this minimizer can have more texts
                if keys[i] != now:
                    levels = Levels()
                own = np.flatnonzero(held[0] == now)
                part = np.isin(array[1], own)
                renumbered = np.searchsorted(own, array[1][part])
                for level in levels.arrays:
                    level[1] = np.searchsorted(own, level[1])
                levels.add([array[0][part], renumbered, array[2][part], array[3][part], array[4][part]])
                kept = held[0][own], held[1][own]
                i = j

    columns = ("key", "span", "text")
    stream = texts.select(*columns, F.lit(True).alias("fresh"))
    for level in levels:
        stream = stream.union(level.select(*columns, F.lit(False).alias("fresh")))
    # one exchange: a key's new texts come first, and keys without any are left out
    order = Window.partitionBy("key").orderBy(F.desc("fresh"), "span")
    dealt = stream.withColumn("asked", F.first("fresh").over(order)).where("asked").drop("asked")
    return dealt.mapInArrow(run, "key long, span long, at long, n long")


class IndexFamily:
    """Levels of texts (key, span, text) sorted by minimizer and text, each a table in the shared folder.

    A level's rank is the power of two of batches that it holds; there is at most one of each rank."""

    def __init__(self, length: int):
        self.length = length
        self.levels: list[tuple[int, DataFrame]] = []

    def add(self, texts: DataFrame, last: bool = False) -> DataFrame:
        """match_texts of a new batch against all levels; then the batch becomes a level, unless it is the last there will be."""
        found = materialize(match_texts(texts, [level for _, level in self.levels], self.length), "matches")
        if not last:
            rank, level = 0, texts.select("key", "span", "text")
            while self.levels and self.levels[-1][0] == rank:
                level = self.levels.pop()[1].union(level)
                rank += 1
            level = level.repartition("key").sortWithinPartitions("key", "text")
            self.levels.append((rank, materialize(level, f"level-{rank}")))
        return found


def match_hashes(texts: DataFrame, length: int) -> DataFrame:
    """The same by an exchange of window hashes, for keys with too many windows for a task; hot windows are counted before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, span, text in zip(*(batch.column(c).to_pylist() for c in ("key", "span", "text")), strict=True):
                raw = np.frombuffer(text, np.uint8)
                at = np.arange(len(raw) - length + 1)
                h = _hash(_prefix(raw), at, at + length).view(np.int64)
                h2 = _hash(_prefix(raw), at, at + length // 2).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), key)), pa.array(np.full(len(h), span)), pa.array(at), pa.array(h), pa.array(h2)], ["key", "span", "at", "h", "h2"])

    windows = texts.select("key", "span", "text").mapInArrow(run, "key long, span long, at long, h long, h2 long")
    same = ["key", "h", "h2"]
    often = materialize(windows.groupBy(*same).count().where("count > 1"), "repeated-windows")
    crowd = often.where(F.col("count") > (often.agg(F.sum("count")).first()[0] or 0) * HOT)
    row = F.row_number().over(Window.partitionBy("key", "span").orderBy("at"))  # at most RUN_WINDOWS
    hits = join_dealt(windows, often.select(*same), same, crowd).withColumn("run", F.col("at") - row)
    return hits.groupBy("key", "span", "run").agg(F.min("at").alias("at"), F.count(F.lit(1)).alias("n")).drop("run")


def cut(text: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, list[tuple[int, int]]]:
    """The bytes outside the spans (start, end), and the spans' maximal union."""
    merged: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    kept, at = [], 0
    for a, b in merged:
        kept.append(text[at:a])
        at = b
    kept.append(text[at:])
    return b"".join(kept), merged


def _named() -> list:
    """rid and rid2: 128 bits that tell rows apart that differ in doc_id or text."""
    return [F.xxhash64("doc_id", "text").alias("rid"), F.xxhash64(F.lit(1), "text", "doc_id").alias("rid2")]


def repeated_spans(documents: DataFrame, length: int = 200, gram: int = 32) -> tuple[DataFrame, DataFrame]:
    """Rows (rid, rid2, doc_id, text) and their spans (rid, rid2, spans): array of (start, end) bytes that repeated strings cover.

    rid and rid2 are hashes of doc_id and text: rows that agree in both have the same spans."""
    own = ["rid", "rid2"]
    rows = documents.select(*_named(), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    runs = materialize(find_runs(rows.select(*own, "text"), length, gram), "runs")
    keys = runs.groupBy("key").agg(F.count(F.lit(1)).alias("met"), F.sum("n").alias("windows"), F.min("span").alias("a"), F.max("span").alias("b"), F.max("tie").alias("ties"))
    hot = (F.col("met") > MOST_RUNS) | (F.col("windows") > MOST_WINDOWS)
    keys = materialize(keys.where("met > 1 or ties").select("key", "met", hot.alias("hot"), (F.col("ties") | (F.col("a") != F.col("b"))).alias("open")), "keys")
    crowd = keys.where(F.col("met") > (keys.agg(F.sum("met")).first()[0] or 0) * HOT)
    found = materialize(join_dealt(runs.drop("tie"), keys.drop("met"), ["key"], crowd), "repeated-runs")
    whole = found.where("not open").select(*own, "start", "n")
    differing = found.where("open")
    texts = differing.groupBy("key", "span").agg(F.count(F.lit(1)).alias("copies"), F.max("hot").alias("hot"), F.min(F.struct(*own, "start", "n")).alias("at"))
    texts = materialize(texts, "differing")
    wanted = texts.groupBy("at.rid", "at.rid2").agg(F.collect_list(F.struct("key", "span", "hot", F.col("at.start").alias("start"), F.col("at.n").alias("n"))).alias("parts"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("key", pa.int64()), ("span", pa.int64()), ("hot", pa.bool_()), ("batch", pa.int32()), ("text", pa.binary())])
        for batch in batches:
            out = []
            for text, number, parts in zip(batch.column("text"), batch.column("rid2").to_pylist(), batch.column("parts").to_pylist(), strict=True):
                data = text.as_py().encode()
                out.extend({"key": p["key"], "span": p["span"], "hot": p["hot"], "batch": number % BATCHES, "text": data[p["start"] : p["start"] + p["n"] - 1 + length]} for p in parts)
            yield pa.RecordBatch.from_pylist(out, kinds)

    # doc_id goes along so that both joins read the same exchange of texts
    spans = rows.join(wanted, own).select("doc_id", "rid2", "text", "parts").mapInArrow(extract, "key long, span long, hot boolean, batch int, text binary")
    spans = materialize(spans, "differing-texts")
    family, usual = IndexFamily(length), spans.where("not hot")
    matched = match_hashes(spans.where("hot"), length)
    for b in range(BATCHES):
        matched = matched.union(family.add(usual.where(F.col("batch") == b), b == BATCHES - 1))
    again = texts.where("copies > 1").select("key", "span", F.lit(0).cast("long").alias("at"), F.col("at.n").cast("long").alias("n"))
    covered = matched.union(again).groupBy("key", "span").agg(F.collect_list(F.struct("at", F.col("n").alias("m"))).alias("hits"))
    crowd = texts.where(F.col("copies") > (texts.agg(F.sum("copies")).first()[0] or 0) * HOT)
    partly = join_dealt(differing.select("key", "span", *own, "start"), covered, ["key", "span"], crowd).select(*own, "start", F.explode("hits").alias("hit"))
    partly = partly.select(*own, (F.col("start") + F.col("hit.at")).alias("start"), F.col("hit.m").alias("n"))
    ends = whole.union(partly).select(*own, F.col("start").cast("long").alias("start"), (F.col("start") + F.col("n") - 1 + length).alias("end"))
    return rows, ends.groupBy(*own).agg(F.collect_set(F.struct("start", "end")).alias("spans"))


def remove_repeats(documents: DataFrame, length: int = 200, gram: int = 32) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (binary), for every document.

    Removed is each byte of a string of `length` bytes that also starts anywhere else, in the same document or
    another; strings are judged on the input. Null and empty texts, and texts shorter than `length`, lose
    nothing. Rows that repeat doc_id and text count as documents of their own. Only doc_id is carried."""
    if not 1 <= gram <= length:
        raise ValueError("gram must be in 1..length")
    rows, spans = repeated_spans(documents, length, gram)
    joined = rows.join(spans, ["rid", "rid2"], "left").select("doc_id", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans in zip(batch.column("text"), batch.column("spans").to_pylist(), strict=True):
                data = text.as_py().encode()
                kept, merged = cut(data, [(s["start"], s["end"]) for s in spans or []])
                out.append((len(data), len(data) - len(kept), len(merged), hashlib.sha256(kept).hexdigest(), kept))
            columns = zip(*out, strict=True) if out else [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
            )

    kind = documents.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def strip_repeats(documents: DataFrame, length: int = 200, gram: int = 32) -> DataFrame:
    """The documents with all their columns, text without its repeated bytes; n_chars, if there, counts the rest.

    A character of which only some bytes are repeated goes as a whole; a null text stays null."""
    _, spans = repeated_spans(documents, length, gram)
    spans = spans.select(F.col("rid").alias("__rid"), F.col("rid2").alias("__rid2"), F.col("spans").alias("__spans"))
    rid, rid2 = _named()
    joined = documents.withColumns({"__rid": rid, "__rid2": rid2}).join(spans, ["__rid", "__rid2"], "left").drop("__rid", "__rid2")
    names = documents.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("__spans").to_pylist(), strict=True):
                if spans:
                    text = cut(text.encode(), [(s["start"], s["end"]) for s in spans])[0].decode("utf-8", "ignore")
                texts.append(text)
            columns = {c: batch.column(c) for c in names}
            columns["text"] = pa.array(texts, pa.string())
            if "n_chars" in columns:
                columns["n_chars"] = pa.array([None if t is None else len(t) for t in texts], columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names)

    return joined.mapInArrow(run, documents.schema)
