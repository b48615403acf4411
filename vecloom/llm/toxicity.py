"""Toxic passages: maximum-scoring segments of token log-odds, judged by extreme-value statistics.

Log-odds. Tokens of labelled texts are counted, by class, at three nodes each: the word's first 4 bytes, its first 6,
and the word. A node's share of toxic occurrences is the posterior mean under a Dirichlet prior whose mean is the share
of the node above it (for the first, that of all tokens), so a rare or unseen form leans on its stem. Counts are
kept by hashed node in tables of fixed size: no token is cut off, and the model does not grow with the sample.
Segments. A token scores its log-odds, less the drift; a text's maximal scoring segments are its passages.
Calibration. Each half of the labelled texts is judged by the counts of the other half. Karlin-Altschul statistics of
clean texts say how rare a passage's score is, a logistic regression, with both classes weighing the same, turns a text's
rarities into its score, and the cut is moved up to where false alarms and misses cost least. The counts of both halves score."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_table, hash_words, lower_table, materialize, mix, powers, slices, text_of

#: The classifier is fitted on at most so many labelled rows, those whose ids hash lowest.
SAMPLE_ROWS = 30_000
#: Bits of a node's place in the tables of counts, which take 8 bytes a place.
PLACE_BITS = 21
#: Bytes of a word that its upper nodes stand for.
STEMS = (4, 6)
#: Bins of 0.01 for the scores of clean tokens, from -20.48 on; scores beyond count in the outermost.
BINS, BIN = 4_096, 0.01
EULER = 0.5772156649015329

_WORDS = np.arange(256, dtype=np.uint8)  # ASCII punctuation and digits part words, too
_WORDS[[b for b in range(128) if not chr(b).isalpha()]] = 0x20
_FOLD = lower_table()


def nodes_of(raw: np.ndarray, offsets: np.ndarray):
    """Places of each word's nodes, from stem to word, (nodes, words); words of each text; byte starts and lengths."""
    raw = _WORDS[raw]
    h, counts, starts, lengths = hash_words(raw, offsets)
    shift = np.uint64(64 - PLACE_BITS)
    places, stem = [], np.zeros(len(starts), np.uint64)
    for i in range(max(STEMS)):
        at = _FOLD[raw[np.minimum(starts + i, len(raw) - 1)]]
        stem += np.where(lengths > i, byte_table()[at] * powers(i + 1)[i], np.uint64(0))
        if i + 1 in STEMS:
            places.append(mix(stem + np.uint64(i + 1)) >> shift)
    places.append(mix(h) >> shift)
    return np.array(places).astype(np.int64), counts, starts, lengths


@dataclass(frozen=True)
class ToxicityModel:
    """toxic and all: occurrences by place of a node; share: toxic ones among all tokens; strength: of the prior, in occurrences.

    rate and size are the Karlin-Altschul lambda and K of clean text; beta weighs the three statistics of a text."""

    toxic: np.ndarray
    all: np.ndarray
    share: float
    strength: float
    drift: float
    rate: float
    size: float
    centre: np.ndarray
    spread: np.ndarray
    beta: np.ndarray

    def token_scores(self, places: np.ndarray) -> np.ndarray:
        q = np.full(places.shape[1], self.share)
        for at in places:
            q = (self.toxic[at] + self.strength * q) / (self.all[at] + self.strength)
        return np.log(q / (1 - q)) - math.log(self.share / (1 - self.share)) - self.drift

    def probability(self, stats: np.ndarray) -> np.ndarray:
        z = self.beta[0] + ((stats - self.centre) / self.spread) @ self.beta[1:]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def maximal_segments(before: list[float], after: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (Ruzzo and Tompa 1999) in linear time: (first, last, score).

    before and after are the running sums of all scores just before and after each positive token."""
    left, right, first, last, link = [], [], [], [], []
    for k, (lo, hi) in enumerate(zip(before, after, strict=True)):
        start = k
        while True:
            j = len(left) - 1
            while j >= 0 and left[j] >= lo:
                j = link[j]
            if j < 0 or right[j] >= hi:
                break
            lo, start = left[j], first[j]
            for column in (left, right, first, last, link):
                del column[j:]
        for column, value in ((left, lo), (right, hi), (first, start), (last, k), (link, j)):
            column.append(value)
    return [(a, b, r - lo) for a, b, lo, r in zip(first, last, left, right, strict=True)]


def passages(model: ToxicityModel, raw: np.ndarray, offsets: np.ndarray):
    """For each text: its number of tokens and its maximal segments (byte start, byte end, score)."""
    places, counts, starts, lengths = nodes_of(raw, offsets)
    yield from _segments(model.token_scores(places), counts, starts, lengths, offsets)


def _segments(s: np.ndarray, counts: np.ndarray, starts: np.ndarray, lengths: np.ndarray, offsets: np.ndarray):
    total = np.cumsum(s)
    up = np.flatnonzero(s > 0)
    owner = np.searchsorted(np.cumsum(counts), up, "right")
    at = np.searchsorted(owner, np.arange(len(counts) + 1))
    for k, m in enumerate(counts.tolist()):
        own = up[at[k] : at[k + 1]]
        found = maximal_segments((total[own] - s[own]).tolist(), total[own].tolist()) if len(own) else []
        yield m, [(int(starts[own[a]] - offsets[k]), int(starts[own[b]] + lengths[own[b]] - offsets[k]), x) for a, b, x in found]


def statistics(model: ToxicityModel, m: int, found: list) -> tuple[float, float, float]:
    """The best segment's and all segments' -ln of the expected number of such segments in m clean tokens, and their share of the text."""
    if not found:
        return 0.0, 0.0, 0.0
    rarity = [model.rate * x - math.log(model.size * max(m, 1)) for _, _, x in found]
    return max(max(rarity), 0.0), sum(max(r, 0.0) for r in rarity), math.log1p(100 * sum(x for _, _, x in found) / max(m, 1))


def _labelled(documents: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """text, toxic, half of at most `sample` labelled documents outside the held-out fifth, one of each group of equal texts.

    The sample's size is the bound that lets its ids be broadcast; its texts are written once."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    few = (
        labels.select("doc_id", "toxic").where("doc_id is not null and toxic is not null")
        .where(F.crc32(key) % 5 != 0).groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )
    named = documents.where("text is not null").select("doc_id", "text").join(F.broadcast(few), "doc_id")
    few = named.groupBy(F.xxhash64("text").alias("copy")).agg(F.min_by(F.struct("doc_id", "text", "toxic"), "doc_id").alias("row")).select("row.*")
    half = F.xxhash64(F.lit(7), "doc_id").bitwiseAND(1).cast("int")
    return materialize(few.select("text", "toxic", half.alias("half")), "labelled")


def _logistic(x: np.ndarray, y: np.ndarray, steps: int = 50, ridge: float = 1e-2) -> np.ndarray:
    """Newton steps; a column of ones stands first, and each class weighs half of all rows, however rare it is."""
    x = np.column_stack([np.ones(len(x)), x])
    weight = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    beta = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (weight * (p - y)) + ridge * beta
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(beta))
        step = np.linalg.solve(hess, grad)
        beta = beta - step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def _counted(rows: DataFrame) -> np.ndarray:
    """Occurrences of every node in rows (text, toxic, half), by half and place: in toxic texts, and in all; (2, 2, places).

    A task shuffles at most 2^(PLACE_BITS + 1) rows, and no more reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((4, 1 << PLACE_BITS), np.int64)
        for batch in batches:
            raw, offsets = text_of(batch.column("text"))
            kind = 2 * batch.column("half").to_numpy() + batch.column("toxic").to_numpy()
            for i, j in slices(offsets):
                places, counts, _, _ = nodes_of(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                owner = np.repeat(kind[i:j], counts)
                for own in places:
                    for k in range(4):
                        held[k] += np.bincount(own[owner == k], minlength=held.shape[1])
        for half in (0, 1):
            clean, toxic = held[2 * half : 2 * half + 2]
            at = np.flatnonzero(clean + toxic)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), half, np.int32)), pa.array(at.astype(np.int32)), pa.array(toxic[at]), pa.array(clean[at])], ["half", "place", "toxic", "clean"])

    table = rows.select("text", "toxic", "half").mapInArrow(run, "half int, place int, toxic long, clean long").groupBy("half", "place")
    table = table.agg(F.sum("toxic").cast("float").alias("toxic"), F.sum(F.col("toxic") + F.col("clean")).cast("float").alias("all")).toArrow()
    out = np.zeros((2, 2, 1 << PLACE_BITS), np.float32)
    half, place = table.column("half").to_numpy(), table.column("place").to_numpy()
    out[half, 0, place], out[half, 1, place] = table.column("toxic").to_numpy(), table.column("all").to_numpy()
    return out


def _cut(p: np.ndarray, y: np.ndarray, cost: float = 5.0) -> float:
    """The score, one half or more, above which a text counts as toxic: where the share of toxic texts above, less `cost` times the share of clean ones, is greatest; of equals the least.

    Few labels make chance words look toxic, and this is where clean texts that hold such words move the cut."""
    at = np.unique(np.append(p, [0.0, 1.0]))
    cuts = np.append(0.5, (at[1:] + at[:-1])[at[1:] + at[:-1] > 1] / 2)
    above = lambda own: 1 - np.searchsorted(np.sort(own), cuts, "left") / len(own)
    gain = above(p[y == 1]) - cost * above(p[y == 0])
    return float(cuts[gain >= gain.max() - 1e-12].min())


def fit(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE_ROWS, drift: float = 0.5, strength: float = 8.0) -> ToxicityModel:
    """Token log-odds under Dirichlet priors from the labelled sample, calibrated on each half by the counts of the other.

    Rows with null ids, labels or texts take no part; of repeated labels of an id the higher counts. Without labels
    of both classes in each half the model is a constant: 1 where all labels of the first half are toxic, else 0.
    Of the texts, the driver sees three numbers each."""
    spark = documents.sparkSession
    few = _labelled(documents, labels, sample)
    classes = {(r["half"], r["toxic"]) for r in few.select("half", "toxic").distinct().collect()}
    zero = np.zeros(3)
    if len(classes) < 4:
        sure = {t for h, t in classes if h == 0} == {1}
        flat = np.zeros(1 << PLACE_BITS, np.float32)
        return ToxicityModel(flat, flat, 0.5, strength, drift, 1.0, 1.0, zero, zero + 1, np.array([30.0 if sure else -30.0, 0, 0, 0]))

    def counted(toxic: np.ndarray, every: np.ndarray) -> ToxicityModel:
        share = min(max(float(toxic.sum(dtype=np.float64) / max(every.sum(dtype=np.float64), 1)), 1e-6), 1 - 1e-6)
        return ToxicityModel(toxic, every, share, strength, drift, 1.0, 1.0, zero, zero + 1, np.zeros(4))

    halves = _counted(few)
    model = counted(*(halves[0] + halves[1]))
    # what judges a half was counted in the other
    shared = spark.sparkContext.broadcast((counted(*halves[1]), counted(*halves[0])))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_of(batch.column("text"))
            label, half = batch.column("toxic").to_numpy(), batch.column("half").to_numpy()
            ms, tops, bins = np.zeros(len(label), np.int64), np.zeros(len(label)), np.zeros(BINS, np.int64)
            for i, j in slices(offsets):
                own = offsets[i : j + 1] - offsets[i]
                places, counts, starts, lengths = nodes_of(raw[offsets[i] : offsets[j]], own)
                for h, model in enumerate(shared.value):
                    s = model.token_scores(places)
                    mine = half[i:j] == h
                    clean = s[np.repeat(mine & (label[i:j] == 0), counts)]
                    bins += np.bincount(np.clip(np.round(clean / BIN).astype(np.int64) + BINS // 2, 0, BINS - 1), minlength=BINS)
                    for k, (m, found) in enumerate(_segments(s, counts, starts, lengths, own)):
                        if mine[k]:
                            ms[i + k], tops[i + k] = m, max((x for _, _, x in found), default=0.0)
            # the bins of a batch go with its first text
            yield pa.RecordBatch.from_arrays([pa.array(ms), pa.array(tops), batch.column("toxic"), pa.array([bins.tolist()] + [[]] * (len(ms) - 1) if len(ms) else [], pa.list_(pa.int64()))], ["m", "top", "toxic", "bins"])

    rest = few.select("text", "toxic", "half")
    seen = materialize(rest.mapInArrow(best, "m long, top double, toxic int, bins array<long>"), "segments")
    bins = np.zeros(BINS, np.int64)
    for r in seen.where(F.size("bins") > 0).select(F.posexplode("bins").alias("i", "n")).groupBy("i").agg(F.sum("n").alias("n")).collect():
        bins[r["i"]] = r["n"]
    rate = _rate((np.arange(BINS) - BINS // 2) * BIN, bins / max(bins.sum(), 1))
    # the mean of a Gumbel variable with location ln(K m) / rate is (ln(K m) + Euler's constant) / rate
    excess = F.lit(rate) * F.col("top") - F.log(F.greatest(F.col("m"), F.lit(1)).cast("double"))
    mean = seen.where("toxic = 0 and top > 0").agg(F.avg(excess).alias("mean")).first()["mean"]
    model = replace(model, rate=rate, size=1.0 if mean is None else math.exp(mean - EULER))
    rate, size = model.rate, model.size

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = [replace(m, rate=rate, size=size) for m in shared.value]
        for batch in batches:
            half = batch.column("half").to_numpy()
            for h, own in enumerate(models):
                rows = batch.filter(pa.array(half == h))
                x = _statistics(own, *text_of(rows.column("text")))
                yield pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1]), pa.array(x[:, 2]), rows.column("toxic")], ["a", "b", "c", "toxic"])

    table = rest.mapInArrow(measure, "a double, b double, c double, toxic int").toArrow()
    x = np.column_stack([table.column(c).to_numpy() for c in "abc"])
    y = table.column("toxic").to_numpy().astype(float)
    order = np.lexsort((y, *x.T))  # sums do not depend on which task came first
    x, y = x[order], y[order]
    centre, spread = x.mean(0), x.std(0) + 1e-9
    model = replace(model, centre=centre, spread=spread, beta=_logistic((x - centre) / spread, y))
    cut = min(max(_cut(model.probability(x), y), 1e-6), 1 - 1e-6)
    beta = model.beta.copy()
    beta[0] -= math.log(cut / (1 - cut))  # scores of one half lie at the cut
    return replace(model, beta=beta)


def _rate(scores: np.ndarray, share: np.ndarray) -> float:
    """The positive root of sum share exp(rate score) = 1 over clean tokens; 1 where there is none."""
    if not share[scores > 0].any():
        return 1.0
    f = lambda r: float((share * np.exp(np.minimum(r * scores, 500))).sum() - 1)
    lo, hi = 1e-4, 1e-4
    while f(hi) <= 0 and hi < 64:
        lo, hi = hi, hi * 2
    if hi >= 64 or f(1e-4) > 0:
        return 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if f(mid) > 0 else (mid, hi)
    return (lo + hi) / 2


def _statistics(model: ToxicityModel, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Each text's statistics, n x 3."""
    found = [statistics(model, m, own) for i, j in slices(offsets) for m, own in passages(model, raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])]
    return np.array(found, float).reshape(-1, 3)


def score(documents: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, score, n_passages, passages (byte start, byte end, score) for every document; whole texts, no shuffle.

    Null and empty texts have no passage and get the score of such a text. Repeated rows are kept; only doc_id
    is carried. The broadcast model is 2^PLACE_BITS places."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    docs = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            raw, offsets = text_of(batch.column("text"))
            stats, spans = [], []
            for i, j in slices(offsets):
                for m, found in passages(model, raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]):
                    stats.append(statistics(model, m, found))
                    floor = math.log(model.size * max(m, 1)) / model.rate
                    spans.append([{"start": a, "end": b, "score": x} for a, b, x in found if x > floor])
            p = model.probability(np.array(stats).reshape(-1, 3))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p), pa.array(spans, span)], ["doc_id", "score", "passages"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, score double, passages array<struct<start:long,end:long,score:double>>")


def judge(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted, passages: fit on labelled rows outside the held-out fifth, then score all.

    Null and empty texts are scored as texts without a passage; null ids are never labelled, and held out as the empty
    string is; repeated rows are scored each; empty tables give no rows."""
    scored = score(documents, fit(documents, labels, sample))
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "passages")


def reject(documents: DataFrame, model: ToxicityModel, threshold: float = 0.5) -> DataFrame:
    """The rows, with all their columns, that score below the threshold. No shuffle; null texts are scored as empty ones."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            raw, offsets = text_of(batch.column("text").fill_null(""))
            yield batch.filter(pa.array(model.probability(_statistics(model, raw, offsets)) < threshold))

    return documents.mapInArrow(run, documents.schema)
