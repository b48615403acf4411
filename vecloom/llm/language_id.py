"""Language identification in two steps: the family of a text's language first, then one against one within the family.

Features. Of the letters of a text, A-Z and the capitals of Latin, Greek and Cyrillic two-byte letters lowered,
everything else as spaces: all byte n-grams of 1 to 4, hashed to places in a table of fixed size.
Family. Multinomial log-likelihoods per n-gram, from counts over all texts that may be learned from; a family's
distribution is the mean of its languages'.
Language. For each pair of languages of a family a linear support vector machine on the shares of n-grams, trained by
dual coordinate descent in a Spark task of its own, on a bounded sample of each language. The language that wins
most of its pairs is the prediction."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import byte_table, materialize, mix, powers, slices, text_of

#: Bits of a feature's place; lengths of n-grams, in bytes.
PLACE_BITS, SIZES = 13, (1, 2, 3, 4)
#: Bytes of text that one step works on; its n-grams and their weights take some 150 times that.
STEP_BYTES = 1 << 18
#: Different texts of a language that its support vector machines learn from, at most: those whose hashes are lowest.
SAMPLE_TEXTS = 1_000

#: ISO 639-1 codes by language family (branches of Indo-European, and others). Another code is a family of its own.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi",
    "romance": "ca co es fr gl it la oc pt rm ro sc wa",
    "slavic": "be bg bs cs hr mk pl ru sh sk sl sr uk",
    "baltic": "lt lv",
    "celtic": "br cy ga gd gv kw",
    "hellenic": "el",
    "indo-aryan": "as bn gu hi mr ne or pa sa sd si ur",
    "iranian": "fa ku ps tg",
    "uralic": "et fi hu se",
    "turkic": "az ba kk ky tk tr tt ug uz",
    "semitic": "am ar he mt ti",
    "dravidian": "kn ml ta te",
    "austronesian": "id jv mg mi ms su tl",
    "sinitic": "zh",
    "japonic": "ja",
    "koreanic": "ko",
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}


def family_of(lang: str) -> str:
    """The family of a code such as de, DE, de-AT or de_AT; of others, the code itself."""
    return _FAMILY.get(lang.lower().replace("_", "-").split("-")[0], lang)


_LETTERS = np.arange(256, dtype=np.uint8)
_LETTERS[[b for b in range(128) if not chr(b).isalpha()]] = 0x20
_LETTERS[65:91] += 32


def _lowered(raw: np.ndarray) -> np.ndarray:
    """Letters in lower case, all other ASCII as spaces; of two-byte letters Latin-1, basic Greek and Cyrillic capitals are lowered."""
    out = _LETTERS[raw]
    lead, tail = raw[:-1], out[1:]  # a view: changes of tail are changes of out
    tail[(lead == 0xC3) & (tail >= 0x80) & (tail <= 0x9E) & (tail != 0x97)] += 0x20
    tail[(lead == 0xD0) & (tail >= 0x90) & (tail <= 0x9F)] += 0x20  # the second half of the Cyrillic capitals changes its lead, too
    second = np.flatnonzero((lead == 0xD0) & (tail >= 0xA0) & (tail <= 0xAF))
    out[second + 1] -= 0x20
    out[second] = 0xD1
    tail[(lead == 0xCE) & (tail >= 0x91) & (tail <= 0x9F)] += 0x20
    return out


def features(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all n-grams, (positions, sizes), one row for each byte kept, and where each text's rows begin and end.

    Runs of spaces count as one, and one space stands before and after each text; an n-gram that would reach beyond
    its text, or is one or more spaces alone, gets place 0, which no weight is ever given to."""
    n = len(offsets) - 1
    low = np.full(len(raw) + 2 * n, 0x20, np.uint8)
    owner = np.repeat(np.arange(n), np.diff(offsets))
    low[np.arange(len(raw)) + 2 * owner + 1] = _lowered(raw)
    edge = offsets + 2 * np.arange(n + 1)
    space = low == 0x20
    keep = np.ones(len(low), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    keep[edge[:-1]] = True
    at = np.concatenate([[0], np.cumsum(keep)])[edge]
    low = low[keep]
    left = np.repeat(at[1:], np.diff(at)) - np.arange(len(low))  # bytes from here to the text's end
    places = np.zeros((len(low), len(SIZES)), np.int32)
    h = np.zeros(len(low), np.uint64)
    with np.errstate(over="ignore"):
        for size in range(1, max(SIZES) + 1):
            h[: len(low) - size + 1] += byte_table()[low[size - 1 :]] * powers(size)[size - 1]
            if size in SIZES:
                place = (mix(h + np.uint64(size)) >> np.uint64(64 - PLACE_BITS)).astype(np.int32)
                places[:, SIZES.index(size)] = np.where(left >= size, np.maximum(place, 1), 0)
    places[low == 0x20, 0] = 0
    return places, at


def parts(raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Bytes, offsets and text numbers of parts of texts, in steps of about STEP_BYTES; only a text longer than that is cut, before spaces, so that it takes no more memory than others.

    N-grams across such a cut are not met; a part without a space for STEP_BYTES bytes is cut before a character's first byte."""
    for i, j in slices(offsets, STEP_BYTES):
        if j - i > 1 or offsets[j] - offsets[i] <= STEP_BYTES:
            yield raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], np.arange(i, j)
            continue
        first, last = int(offsets[i]), int(offsets[j])
        while first < last:
            stop = min(first + STEP_BYTES, last)
            if stop < last:
                own = raw[first + 1 : stop + 1]
                at = np.flatnonzero(own == 0x20)
                at = at if len(at) else np.flatnonzero((own & 0xC0) != 0x80)
                stop = first + 1 + int(at[-1]) if len(at) else stop
            yield raw[first:stop], np.array([0, stop - first]), np.array([i])
            first = stop


def _letters(text: Column) -> Column:
    """Whether there is a letter, of any script."""
    return text.isNotNull() & text.rlike("\\p{L}")


def _learnable(documents: DataFrame) -> DataFrame:
    """lang, text of the documents outside the held-out quarter that have both and a letter."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return documents.where((F.crc32(key) % 4 != 2) & F.col("lang").isNotNull() & _letters(F.col("text"))).select("lang", "text")


def _counted(rows: DataFrame) -> DataFrame:
    """lang, place, n over all rows. A task sends a row for each language and place at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            raw, offsets = text_of(batch.column("text"))
            langs = batch.column("lang").to_pylist()
            for part, edge, text in parts(raw, offsets):
                places, at = features(part, edge)
                names = sorted({langs[t] for t in text.tolist()})
                owner = np.repeat([names.index(langs[t]) for t in text.tolist()], np.diff(at))
                for k, name in enumerate(names):
                    own = held.setdefault(name, np.zeros(1 << PLACE_BITS, np.int64))
                    own += np.bincount(places[owner == k].ravel(), minlength=len(own))
        for name, own in held.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(own[at])], ["lang", "place", "n"])

    return rows.mapInArrow(run, "lang string, place int, n long").groupBy("lang", "place").agg(F.sum("n").alias("n"))


def _sampled(rows: DataFrame, most: int) -> DataFrame:
    """lang, text: of each language the `most` different texts whose hashes are lowest, or all. Only hashes are shuffled to find them."""
    h = F.xxhash64("text").alias("h")
    hashes = rows.select("lang", h).distinct().withColumn("part", F.pmod("h", F.lit(64)))
    for key in (["lang", "part"], ["lang"]):  # a language's last window gets 64 * most rows at most
        rank = F.row_number().over(Window.partitionBy(*key).orderBy("h"))
        hashes = hashes.withColumn("r", rank).where(F.col("r") <= most)
    last = hashes.groupBy("lang").agg(F.max("h").alias("last"))
    few = rows.select("lang", "text", h).join(F.broadcast(last), "lang").where("h <= last")
    return few.groupBy("lang", "h").agg(F.min("text").alias("text")).select("lang", "h", "text")


def svm(x: np.ndarray, y: np.ndarray, cost: float = 10.0, rounds: int = 60, room: float = 1e-3) -> np.ndarray:
    """Weights of a linear support vector machine with squared hinge loss, by dual coordinate descent (Hsieh et al. 2008).

    x: rows, the last column a constant; y: 1 or -1. Each class costs as much as the other, however many rows it has."""
    n, d = x.shape
    w, alpha = np.zeros(d, np.float32), np.zeros(n)
    share = np.where(y > 0, (y > 0).sum(), (y < 0).sum()) * 2 / n
    slack = share / (2 * cost)
    norm = np.einsum("ij,ij->i", x, x).astype(float) + slack
    rng = np.random.default_rng(0)
    for _ in range(rounds):
        worst = 0.0
        for i in rng.permutation(n):
            grad = y[i] * float(x[i] @ w) - 1 + slack[i] * alpha[i]
            new = max(alpha[i] - grad / norm[i], 0.0)
            if new != alpha[i]:
                w += np.float32((new - alpha[i]) * y[i]) * x[i]
                worst = max(worst, abs(new - alpha[i]) * norm[i])
                alpha[i] = new
        if worst < room:
            break
    return w


@dataclass(frozen=True)
class LanguageModel:
    """langs in order; family of each, by its number; like: (places, families) log-likelihoods less their mean.

    pairs: (a, b) numbers of languages of one family; weights: (places, pairs), positive for a; bias and slope: of each pair."""

    langs: tuple[str, ...]
    family: np.ndarray
    like: np.ndarray
    pairs: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def predict(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the predicted languages, and how sure: the share of the family times the mean share in the language's pairs."""
        table = np.concatenate([self.like, self.weights], axis=1)  # few columns: families and pairs
        total, count = np.zeros((len(offsets) - 1, table.shape[1])), np.zeros(len(offsets) - 1)
        for part, edge, text in parts(raw, offsets):
            places, at = features(part, edge)
            for column in places.T:
                for i in range(0, len(text), 4096):  # a part has a byte at least
                    first = at[i : min(i + 4096, len(text)) + 1]
                    np.add.at(total, text[i : i + 4096], np.add.reduceat(table[column[first[0] : first[-1]]], first[:-1] - first[0], axis=0))
            np.add.at(count, text, np.add.reduceat((places > 0).sum(1), at[:-1]))
        count = np.maximum(count, 1)
        rows = count
        families = self.like.shape[1]
        like = total[:, :families]
        like = np.exp(np.clip(like - like.max(1, keepdims=True), -700, 0))
        like /= like.sum(1, keepdims=True)
        best = like.argmax(1)
        margin = total[:, families:] / count[:, None] + self.bias
        wins = np.zeros((len(rows), len(self.langs)))
        share = np.zeros_like(wins)
        rivals = np.zeros(len(self.langs))
        for k, (a, b) in enumerate(self.pairs):
            p = 1 / (1 + np.exp(-np.clip(2 * margin[:, k], -30, 30)))
            for lang, own in ((a, p), (b, 1 - p)):
                wins[:, lang] += own >= 0.5 if lang == a else own > 0.5
                share[:, lang] += own
                rivals[lang] += 1
        share = np.where(rivals > 0, share / np.maximum(rivals, 1), 1.0)
        # most wins first, then the greater share, then the first in order
        rating = np.where(self.family[None, :] == best[:, None], wins + share / 2, -1)
        lang = rating.argmax(1)
        row = np.arange(len(rows))
        return lang, np.clip(like[row, best] * share[row, lang], 0, 1)


def fit(documents: DataFrame, most: int = SAMPLE_TEXTS) -> LanguageModel | None:
    """The model of doc_id, text, lang; None where there is nothing to learn from.

    Counts cover all texts that may be learned from; the pairs' machines learn from `most` different texts of each
    language. Broadcast and collected: tables of 2^PLACE_BITS places for each family and each pair of a family."""
    rows = _learnable(documents)
    counts = _counted(rows).toArrow()
    langs = sorted(set(counts.column("lang").to_pylist()))
    if not langs:
        return None
    table = np.zeros((1 << PLACE_BITS, len(langs)))
    order = {lang: i for i, lang in enumerate(langs)}
    table[counts.column("place").to_numpy(), [order[x] for x in counts.column("lang").to_pylist()]] = counts.column("n").to_numpy()
    table[0] = 0
    shares = (table + 0.5) / (table + 0.5).sum(0)
    names = sorted({family_of(x) for x in langs})
    family = np.array([names.index(family_of(x)) for x in langs])
    like = np.log(np.stack([shares[:, family == f].mean(1) for f in range(len(names))], axis=1))
    like -= like.mean(1, keepdims=True)
    like[0] = 0
    pairs = np.array([(a, b) for a in range(len(langs)) for b in range(a + 1, len(langs)) if family[a] == family[b]], np.int64).reshape(-1, 2)
    weights, bias = np.zeros((1 << PLACE_BITS, len(pairs))), np.zeros(len(pairs))
    if len(pairs):
        # shares of n-grams are scaled by their usual size, so that frequent ones do not outweigh all others
        scale = 1 / np.sqrt(shares.mean(1))
        scale[0] = 0
        for k, w, b in _machines(rows, langs, pairs, scale, most):
            weights[:, k], bias[k] = w, b
    return LanguageModel(tuple(langs), family, like, pairs, weights, bias)


def _machines(rows: DataFrame, langs: list[str], pairs: np.ndarray, scale: np.ndarray, most: int) -> list[tuple[int, np.ndarray, float]]:
    """(pair, weights, bias) of every pair: the sample's features go once to each pair of their language, a pair is one task's group of at most 2 * most rows."""
    spark = rows.sparkSession

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(i, 256) for whole in batches for i in range(0, whole.num_rows, 256)):
            raw, offsets = text_of(batch.column("text"))
            counts = np.zeros((batch.num_rows, 1 << PLACE_BITS), np.int32)
            for part, edge, text in parts(raw, offsets):
                places, own = features(part, edge)
                for t, a, b in zip(text.tolist(), own[:-1], own[1:], strict=True):
                    counts[t] += np.bincount(places[a:b].ravel(), minlength=1 << PLACE_BITS).astype(np.int32)
            counts[:, 0] = 0
            at, share = [], []
            for n in counts:
                own = np.flatnonzero(n)
                at.append(own.astype(np.int32))
                share.append((n[own] / max(n.sum(), 1) * scale[own]).astype(np.float32))
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("h"), pa.array(at, pa.list_(pa.int32())), pa.array(share, pa.list_(pa.float32()))], ["lang", "h", "at", "share"])

    known = materialize(_sampled(rows, most).mapInArrow(measured, "lang string, h long, at array<int>, share array<float>"), "languages")
    sides = [(k, langs[lang], side) for k, (a, b) in enumerate(pairs.tolist()) for lang, side in ((a, 1), (b, -1))]
    sides = spark.createDataFrame(sides, "pair int, lang string, side int")

    def learn(table: pa.Table) -> pa.Table:
        table = table.sort_by([("side", "ascending"), ("h", "ascending")]).combine_chunks()
        y = table.column("side").to_numpy().astype(float)
        x = np.zeros((len(y), 1 << PLACE_BITS), np.float32)
        lists = table.column("at").chunk(0) if len(y) else table.column("at")
        owner = np.repeat(np.arange(len(y)), lists.value_lengths().to_numpy())
        x[owner, lists.flatten().to_numpy()] = table.column("share").chunk(0).flatten().to_numpy()
        x[:, 0] = 1.0  # place 0 has no n-gram: the bias
        w = svm(x, y)
        bias = float(w[0])
        w = np.where(scale > 0, w, 0) * scale
        return pa.table({"pair": table.column("pair").slice(0, 1), "weights": pa.array([w.tolist()]), "bias": [bias]})

    grouped = known.join(F.broadcast(sides), "lang").select("pair", "side", "h", "at", "share").groupBy("pair")
    found = grouped.applyInArrow(learn, "pair int, weights array<double>, bias double").collect()
    return [(r["pair"], np.array(r["weights"]), r["bias"]) for r in found]


def predict(documents: DataFrame, model: LanguageModel | None) -> DataFrame:
    """doc_id, lang_pred, score for every row; whole texts, no shuffle.

    Null texts, and texts without a letter, are `und` with score 0, and so are all where there is no model. A model of one
    language gives it to every text that has a letter. Repeated rows are rows of their own; an empty table gives no rows; only
    doc_id and text are read. Texts of over STEP_BYTES bytes are read in parts."""
    asked = documents.select("doc_id", F.when(_letters(F.col("text")), F.col("text")).alias("text"))
    if model is None:
        return asked.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = np.array(model.langs, object)
        for batch in batches:
            text = batch.column("text")
            raw, offsets = text_of(text.fill_null(""))
            lang, score = model.predict(raw, offsets)
            none = text.is_null().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.where(none, "und", names[lang]), pa.string()), pa.array(np.where(none, 0.0, score))], ["doc_id", "lang_pred", "score"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return asked.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def identify(documents: DataFrame, most: int = SAMPLE_TEXTS) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learned outside the held-out quarter (crc32(doc_id as text) mod 4 is 2), then predicted for all.

    A null doc_id counts as the empty string, which is not held out."""
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4 == 2
    return predict(documents, fit(documents, most)).select("doc_id", held.alias("held_out"), "lang_pred", "score")
