"""Interpolated modified Kneser-Ney bigram model, counted in Spark, kept as sorted hash arrays that workers map into memory.

Counting. A first pass finds the frequent words, whose bigrams are dealt out to many ranges of keys. Tasks turn texts into 64-bit word hashes and send, for each range of keys, one sorted run of counted
bigrams (context, word, count) - pre-aggregated blobs, so a frequent bigram is one entry of each run. A task per
range merges its runs, writes the range's sorted arrays to the shared folder, and passes on what words and
contexts need: how often a word occurs and after how many contexts, and how many words follow a context once,
twice or more often. A second exchange merges these by word. Only a dozen sums reach the driver.

Scoring. A worker maps the arrays with numpy and looks a slice's bigrams up by binary search, in key order.

The order is two: at order three the synthetic corpora have 0.8 distinct trigrams for each token, so counts of one."""

from __future__ import annotations

import functools
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filesystem, hash_words, materialize, mix, put_file, shared_path, slices, text_of

_U = np.uint64
#: Hashes of the marks before and after a text; the end counts as a token.
BEGIN, END = _U(0x5A17_B0A4_0F00_0001), _U(0x5A17_B0A4_0F00_0002)
#: Counts from this on stand in a file of their own.
LARGE = 0xFFFFFFFF
#: A task keeps at most about so many distinct bigrams before it sends their runs on.
RUN_BIGRAMS = 3_000_000
_WORD = np.dtype([("key", "<u8"), ("count", "<i8"), ("after", "<i8"), ("total", "<i8"), ("once", "<i4"), ("twice", "<i4"), ("more", "<i4")])


def bigram_key(context: np.ndarray, word: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """The top 16 bits are the context's, so that a context's bigrams lie in one range of keys; those of hot contexts (sorted) are spread over 256 places."""
    with np.errstate(over="ignore"):
        inner = mix(context * _U(3) + mix(word))
    top = context >> _U(48)
    spread = hot[np.minimum(np.searchsorted(hot, context), len(hot) - 1)] == context
    top = np.where(spread, (top + ((inner & _U(0xFF)) << _U(8))) & _U(0xFFFF), top)
    return (top << _U(48)) | (inner >> _U(16))


def range_of(key: np.ndarray, ranges: int) -> np.ndarray:
    return ((key >> _U(48)) * _U(ranges) >> _U(16)).astype(np.int64)


def tokens_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words and ends of texts in order, each token's context, and the offsets of each text's tokens."""
    h, counts, _, _ = hash_words(raw, offsets)
    at = np.concatenate([[0], np.cumsum(counts + 1)])
    word = np.empty(at[-1], _U)
    last = np.zeros(len(word), bool)
    last[at[1:] - 1] = True
    word[last], word[~last] = END, h
    context = np.empty_like(word)
    context[1:] = word[:-1]
    context[at[:-1]] = BEGIN
    return word, context, at


def _sum_runs(context: np.ndarray, word: np.ndarray, count: np.ndarray):
    """Distinct (context, word), sorted, with summed counts."""
    order = np.lexsort((word, context))
    context, word, count = context[order], word[order], count[order]
    new = np.ones(len(word), bool)
    new[1:] = (context[1:] != context[:-1]) | (word[1:] != word[:-1])
    first = np.flatnonzero(new)
    return context[first], word[first], np.add.reduceat(count, first) if len(first) else count


def _pack(*columns: np.ndarray) -> bytes:
    """Columns of hashes (uint64) and counts, in 32 bits where all of them fit: then the number of columns is positive, else negative."""
    wide = any(c.dtype != _U and len(c) and c.max() > 0xFFFFFFFF for c in columns)
    head = np.array([-len(columns) if wide else len(columns), *(len(c) for c in columns)], "<i8")
    return b"".join([head.tobytes(), *(np.ascontiguousarray(c, "<u8" if wide or c.dtype == _U else "<u4").tobytes() for c in columns)])


def _unpack(data: bytes, wide: int) -> list[np.ndarray]:
    """The columns of a run; the first `wide` are 64-bit hashes, the rest counts."""
    n = int(np.frombuffer(data, "<i8", 1)[0])
    n, wide = abs(n), -n if n < 0 else wide
    sizes, at, out = np.frombuffer(data, "<i8", n, 8), 8 + 8 * n, []
    for i, size in enumerate(sizes.tolist()):
        kind = "<u8" if i < wide else "<u4"
        out.append(np.frombuffer(data, kind, size, at))
        at += size * np.dtype(kind).itemsize
    return out


def _split(keys: np.ndarray, ranges: int) -> np.ndarray:
    """Where each range begins in sorted keys."""
    return np.searchsorted(range_of(keys, ranges), np.arange(ranges + 1))


@dataclass(frozen=True)
class Model:
    """Arrays under `path`, in `ranges` files each for bigrams and words; sums over the training texts."""

    path: str
    ranges: int
    tokens: int
    words: int
    bigrams: int
    discounts: tuple[float, float, float]
    lower: tuple[float, float, float]
    lower_mass: float
    hot: np.ndarray

    def logs(self, word: np.ndarray, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 of the model's probability of each token in its context, and each token's training count."""
        unique, back = np.unique(np.concatenate([word, context]), return_inverse=True)
        row = self._words(unique)
        w, c = back[: len(word)], back[len(word) :]
        d = np.array([0.0, *self.lower])
        if self.bigrams:
            after = row["after"].astype(float)
            p = (after - d[np.minimum(row["after"], 3)]) / self.bigrams
            base = p + self.lower_mass / (self.words + 1)
        else:
            base = np.full(len(unique), 1 / (self.words + 1))
        total = np.maximum(row["total"], 1).astype(float)
        d = np.array([0.0, *self.discounts])
        mass = np.where(row["total"] > 0, (d[1] * row["once"] + d[2] * row["twice"] + d[3] * row["more"]) / total, 1.0)
        n = self._bigrams(bigram_key(context, word, self.hot))
        own = np.where(n > 0, (n - d[np.minimum(n, 3)]) / total[c], 0.0)
        return np.log10(own + mass[c] * base[w]), row["count"][w]

    def _words(self, sorted_keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(sorted_keys), _WORD)
        at = _split(sorted_keys, self.ranges)
        for r in np.flatnonzero(np.diff(at)).tolist():
            table = _mapped(self.path, "words", r, _WORD)
            if len(table):
                own = sorted_keys[at[r] : at[r + 1]]
                j = np.minimum(np.searchsorted(table["key"], own), len(table) - 1)
                found = table[j]
                out[at[r] : at[r + 1]] = np.where(found["key"] == own, found, np.zeros(1, _WORD))
        return out

    def _bigrams(self, keys: np.ndarray) -> np.ndarray:
        unique, back = np.unique(keys, return_inverse=True)
        out = np.zeros(len(unique), np.int64)
        at = _split(unique, self.ranges)
        for r in np.flatnonzero(np.diff(at)).tolist():
            key, count = _mapped(self.path, "bigram-keys", r, "<u8"), _mapped(self.path, "bigram-counts", r, "<u4")
            if len(key):
                own = unique[at[r] : at[r + 1]]
                j = np.minimum(np.searchsorted(key, own), len(key) - 1)
                n = np.where(key[j] == own, count[j], 0).astype(np.int64)
                if (n == LARGE).any():
                    large = _mapped(self.path, "bigram-large", r, "<u8").reshape(-1, 2)
                    n[n == LARGE] = large[np.searchsorted(large[:, 0], own[n == LARGE]), 1]
                out[at[r] : at[r + 1]] = n
        return out[back]


@functools.lru_cache(4096)
def _mapped(path: str, name: str, part: int, kind) -> np.ndarray:
    """An array of the model, mapped into memory; from a store that is not a local folder it is fetched once for each executor,
    to its scratch folder, which Spark removes with the application."""
    store, file = filesystem(f"{path}/{name}-{part:05d}.bin")
    if not isinstance(store, pa.fs.LocalFileSystem):
        local = os.path.join(SparkFiles.getRootDirectory(), f"{os.path.basename(path)}-{os.path.basename(file)}")
        if not os.path.exists(local):
            part = f"{local}.{uuid.uuid4().hex}"
            with store.open_input_stream(file) as source, open(part, "wb") as out:
                while block := source.read(1 << 20):
                    out.write(block)
            os.replace(part, local)  # another worker may have been faster: the files are the same
        file = local
    return np.memmap(file, kind, "r") if os.path.getsize(file) else np.zeros(0, kind)


def _discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Chen and Goodman's estimates, held to [0, count]; 0.5, 1, 1.5 where there are no counts to estimate from."""
    if not n1 or not n2:
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    out = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5)
    return tuple(float(min(max(x, 0.01), k - 0.01)) for x, k in zip(out, (1, 2, 3), strict=True))


def frequent_words(texts: DataFrame, share: float) -> np.ndarray:
    """Sorted hashes of the contexts that are at least `share` of all tokens, at most 1 / share of them; the mark before texts is always one.

    A word of that share is at least half of it in some partition, so each partition names at most 2 / share words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_h, held_n, total = [], [], 0

        def merge():
            u, back = np.unique(np.concatenate(held_h), return_inverse=True)
            held_n[:] = [np.bincount(back, np.concatenate(held_n)).astype(np.int64)]
            held_h[:] = [u]

        for batch in batches:
            raw, offsets = text_of(batch.column("text"))
            for i, j in slices(offsets):
                u, n = np.unique(hash_words(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])[0], return_counts=True)
                held_h.append(u)
                held_n.append(n)
                total += int(n.sum())
                if sum(map(len, held_h)) > RUN_BIGRAMS:
                    merge()
        if held_h:
            merge()
            keep = held_n[0] >= share / 2 * total
            yield pa.RecordBatch.from_arrays([pa.array(held_h[0][keep].view(np.int64)), pa.array(held_n[0][keep]), pa.array(np.zeros(keep.sum(), np.int64))], ["h", "n", "total"])
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.array([0], pa.int64()), pa.array([total], pa.int64())], ["h", "n", "total"])

    counts = texts.select("text").mapInArrow(run, "h long, n long, total long").groupBy("h").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    counts = materialize(counts, "frequent-words")  # at most 2 / share rows for each partition
    whole = counts.agg(F.sum("total").alias("t")).first()["t"] or 0
    rows = counts.where((F.col("n") > 0) & (F.col("n") >= whole * share)).select("h").collect()
    return np.unique(np.concatenate([np.array([r["h"] for r in rows], np.int64).view(_U), [BEGIN]]))


def fit(texts: DataFrame, ranges: int | None = None) -> Model:
    """Count the texts (column text, no nulls) and write the model's arrays to the shared folder."""
    spark = texts.sparkSession
    path = shared_path(spark, "kneser-ney")
    texts = texts.select("text")
    r_count = min(ranges or max(8, 4 * texts.rdd.getNumPartitions()), 65_536)

    hot = frequent_words(texts, 1 / (4 * r_count))

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []

        def flush():
            c, w, n = _sum_runs(*(np.concatenate(x) for x in zip(*held, strict=True)))
            held.clear()
            part = range_of(bigram_key(c, w, hot), r_count)
            order = np.argsort(part, kind="stable")
            c, w, n = c[order], w[order], n[order]
            at = np.searchsorted(part[order], np.arange(r_count + 1))
            for r in np.flatnonzero(np.diff(at)).tolist():
                own = c[at[r] : at[r + 1]]
                first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
                data = _pack(own[first], w[at[r] : at[r + 1]], np.diff(first, append=len(own)), n[at[r] : at[r + 1]])
                yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([data], pa.binary())], ["part", "data"])

        for batch in batches:
            raw, offsets = text_of(batch.column("text"))
            for i, j in slices(offsets):
                w, c, _ = tokens_of(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                held.append(_sum_runs(c, w, np.ones(len(w), np.int64)))
                if sum(len(x[0]) for x in held) > RUN_BIGRAMS:
                    yield from flush()
        if held:
            yield from flush()

    def merge_bigrams(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        got = [_unpack(x.as_py(), 2) for x in table.column("data")]
        context = np.concatenate([np.repeat(h, k) for h, _, k, _ in got])
        context, word, count = _sum_runs(context, np.concatenate([g[1] for g in got]), np.concatenate([g[3] for g in got]).astype(np.int64))
        key = bigram_key(context, word, hot)
        order = np.argsort(key)
        put_file(f"{path}/bigram-keys-{part:05d}.bin", [key[order].astype("<u8").tobytes()])
        put_file(f"{path}/bigram-counts-{part:05d}.bin", [np.minimum(count[order], LARGE).astype("<u4").tobytes()])
        large = order[count[order] >= LARGE]
        put_file(f"{path}/bigram-large-{part:05d}.bin", [np.column_stack([key[large], count[large].astype(_U)]).astype("<u8").tobytes()])
        parts, data = [part], [np.array([-1, *((count == k).sum() for k in (1, 2, 3, 4)), len(count)], "<i8").tobytes()]
        if not len(count):
            return pa.table({"part": pa.array(parts, pa.int32()), "data": pa.array(data, pa.binary())})
        first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
        kinds = [np.add.reduceat((count == 1).astype(np.int64), first), np.add.reduceat((count == 2).astype(np.int64), first), np.add.reduceat((count > 2).astype(np.int64), first)]
        u, back = np.unique(word, return_inverse=True)
        follows = np.bincount(back), np.bincount(back, count).astype(np.int64)
        for keys, columns in ((context[first], [np.add.reduceat(count, first), *kinds]), (u, follows)):
            at = _split(keys, r_count)
            for r in np.flatnonzero(np.diff(at)).tolist():
                parts.append(r)
                data.append(_pack(keys[at[r] : at[r + 1]], *(x[at[r] : at[r + 1]] for x in columns)))
        return pa.table({"part": pa.array(parts, pa.int32()), "data": pa.array(data, pa.binary())})

    def merge_words(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        got: dict[int, list] = {2: [], 4: []}
        sums = np.zeros(5, np.int64)
        for x in table.column("data"):
            data = x.as_py()
            if data[:8] == b"\xff" * 8:
                sums += np.frombuffer(data, "<i8", 5, 8)
            else:
                columns = _unpack(data, 1)
                got[len(columns) - 1].append(columns)
        follows, contexts = ([np.concatenate(c) for c in zip(*got[k], strict=True)] if got[k] else [np.zeros(0, _U)] + [np.zeros(0, np.uint32)] * k for k in (2, 4))
        keys, back = np.unique(np.concatenate([follows[0], contexts[0]]), return_inverse=True)
        out = np.zeros(len(keys), _WORD)
        out["key"] = keys
        n = len(follows[0])
        out["after"] = np.bincount(back[:n], follows[1], len(keys))
        out["count"] = np.bincount(back[:n], follows[2], len(keys))
        for name, column in zip(("total", "once", "twice", "more"), contexts[1:], strict=True):
            out[name] = np.bincount(back[n:], column, len(keys))
        put_file(f"{path}/words-{part:05d}.bin", [out.tobytes()])
        own = [out["count"].sum(), (out["count"] > 0).sum(), out["after"].sum(), *((out["after"] == k).sum() for k in (1, 2, 3, 4))]
        return pa.table({"sums": pa.array([[*sums.tolist(), *map(int, own)]], pa.list_(pa.int64()))})

    blob = "part int, data binary"
    # every range gets an empty run, so that each has its files even if no key falls into it
    empty = spark.range(r_count).select(F.col("id").cast("int").alias("part"), F.lit(np.array([4, 0, 0, 0, 0], "<i8").tobytes()).alias("data"))
    bigrams = texts.select("text").mapInArrow(runs, blob).union(empty).groupBy("part").applyInArrow(lambda t: merge_bigrams(t), blob)
    bare = spark.range(r_count).select(F.col("id").cast("int").alias("part"), F.lit(np.array([3, 0, 0, 0], "<i8").tobytes()).alias("data"))
    summed = bigrams.union(bare).groupBy("part").applyInArrow(lambda t: merge_words(t), "sums array<long>")
    total = summed.agg(*(F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(12))).first()
    n1, n2, n3, n4, bigram_count, tokens, words, pairs, m1, m2, m3, m4 = (int(x or 0) for x in total)
    lower = _discounts(m1, m2, m3, m4)
    mass = (lower[0] * m1 + lower[1] * m2 + lower[2] * (words - m1 - m2)) / pairs if pairs else 1.0
    return Model(path, r_count, tokens, words, pairs, _discounts(n1, n2, n3, n4), lower, mass, hot)


def score(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score (log10) of every whole text; null texts count as empty.

    No shuffle; an empty text has one token, its end. Repeated rows are kept; only doc_id is carried."""
    docs = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_of(batch.column("text"))
            out = []
            for i, j in slices(offsets):
                w, c, at = tokens_of(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                logs, count = model.logs(w, c)
                base = np.log10((count + 1) / (model.tokens + model.words + 1))
                out.append((np.diff(at), *(np.add.reduceat(x, at[:-1]) for x in ((count > 0).astype(np.int64), base, logs))))
            n, known, base, own = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 2 + (np.zeros(0),) * 2
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n), pa.array(known), pa.array(np.full(len(n), model.tokens)), pa.array(base), pa.array(own)],
                ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    kind = documents.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def perplexity(scored: DataFrame) -> DataFrame:
    """Adds perplexity: 10 to the power of the mean negative log10 probability of a token."""
    return scored.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def train_and_score(documents: DataFrame, folds: int = 7, held: int = 2) -> DataFrame:
    """Learn from the documents whose crc32(doc_id as text) modulo `folds` is not `held`, then score all of them."""
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % folds == held
    model = fit(documents.where(~held_out).select(F.coalesce("text", F.lit("")).alias("text")))
    scored = score(documents, model)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
