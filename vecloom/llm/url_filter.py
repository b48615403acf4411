"""URL verdicts: rules for hosts and paths first, then logistic regression on hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_table, mix, powers, slices, text_of

#: The rules that op7's contract fixes: (verdict, host and path).
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))

#: Words of hosts and paths that blocklists and site directories commonly file under unwanted and under ordinary sites.
UNWANTED = (
    "casino", "poker", "jackpot", "slots", "roulette", "betting", "bets", "gamble", "viagra", "pills", "pharmacy", "meds", "steroids", "escort",
    "adult", "porn", "xxx", "cams", "payday", "loans", "replica", "warez", "crack", "keygen", "torrent", "spam", "backlinks", "linkfarm", "cheap", "bonus",
)
ORDINARY = (
    "news", "weather", "library", "museum", "university", "school", "history", "science", "garden", "cooking", "recipes", "travel", "music", "theatre",
    "gallery", "hospital", "council", "parliament", "railway", "airport", "forest", "river", "village", "harbour", "football", "chess", "physics", "chemistry",
    "biology", "grammar", "dictionary", "archive", "journal", "magazine", "radio", "bakery", "bicycle", "camera", "furniture", "astronomy",
)
#: Where a pair of words (w, p) and a number stand in a url, and further shapes for ordinary sites, which are most sites.
SHAPES = ("http://{w}-{p}.com/", "https://www.{w}{p}.org/{n}.html", "http://{p}.{w}.net/{p}/{n}", "https://{w}.info/index?page={n}")
COMMON = (
    "https://blog.{w}.com/en/{n}", "http://m.{p}.org/de/{n}/", "https://www.the{w}.net/fr/{n}.html", "http://{w}and{p}.com/about",
    "https://en.{p}.org/wiki/{w}", "http://{w}.city.gov/contact", "https://docs.{p}.io/{w}/", "http://www.{w}.co/es/{n}?page=2",
)


def labelled_urls() -> list[tuple[str, int]]:
    """(url, 1 for block): each word in each shape, beside other words of its list; what the classifier learns from where the caller has no table."""
    out = []
    for words, shapes, label in ((UNWANTED, SHAPES, 1), (ORDINARY, SHAPES + COMMON, 0)):
        for i, w in enumerate(words):
            out += [(shape.format(w=w, p=words[(i + 7 * k + 1) % len(words)], n=31 * i + k), label) for k, shape in enumerate(shapes)]
    return out


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first `://` up to `/`, `?`, `#` or the end, A-Z lowered; path: from there up to `?` or `#`.

    Both are empty for null and for a url without `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + F.lit(3), F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(
        F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    )
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest rule (ties: first in order of text) whose host is the url's or a parent of it and whose path begins the url's."""
    found = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


@dataclass(frozen=True)
class UrlClassifier:
    """Weights of logistic regression over hashed n-grams of 3 to 5 bytes of host + path."""

    weights: np.ndarray
    bias: float
    sizes: tuple[int, ...] = (3, 4, 5)

    def features(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, bucket) of every n-gram that lies in one text."""
        rows, buckets = [], []
        value = byte_table()[raw]
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        end = np.repeat(offsets[1:], np.diff(offsets))
        with np.errstate(over="ignore"):
            for n in self.sizes:
                m = len(raw) - n + 1
                if m <= 0:
                    continue
                h = sum(value[i : i + m] * powers(n)[i] for i in range(n))
                fits = np.arange(m) + n <= end[:m]
                rows.append(row[:m][fits])
                buckets.append((mix(h + np.uint64(n))[fits] % np.uint64(len(self.weights))).astype(np.int64))
        if not rows:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(rows), np.concatenate(buckets)

    def probability(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Of block, for each text. A text counts each n-gram once per occurrence, scaled to unit length."""
        n = len(offsets) - 1
        row, bucket = self.features(raw, offsets)
        total = np.bincount(row, self.weights[bucket], n)
        z = total / np.sqrt(np.maximum(np.bincount(row, minlength=n), 1)) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(labelled: Sequence[tuple[str, int]] | None = None, buckets: int = 1 << 16, epochs: int = 300, rate: float = 0.5, l2: float = 1e-4) -> UrlClassifier:
    """Batch gradient descent on a small labelled table of (host + path or url, label), labelled_urls() if none is given.

    Null and empty urls take no part; one class only or no rows give a constant verdict."""
    texts = [(u.split("://", 1)[-1].split("?")[0].split("#")[0].lower(), int(y)) for u, y in (labelled_urls() if labelled is None else labelled) if u]
    y = np.array([y for _, y in texts], float)
    model = UrlClassifier(np.zeros(buckets), 0.0)
    if not len(y) or y.min() == y.max():
        return UrlClassifier(model.weights, 8.0 if len(y) and y[0] else -8.0)
    data = [t.encode() for t, _ in texts]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in data])])
    row, bucket = model.features(np.frombuffer(b"".join(data), np.uint8), offsets)
    scale = 1 / np.sqrt(np.maximum(np.bincount(row, minlength=len(y)), 1))
    w, b = model.weights, 0.0
    for _ in range(epochs):
        p = 1 / (1 + np.exp(-(np.bincount(row, w[bucket], len(y)) * scale + b)))
        error = p - y
        w = w - rate * (np.bincount(bucket, (error * scale)[row], buckets) + l2 * w)
        b -= rate * error.mean()
    return UrlClassifier(w, float(b))


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, model: UrlClassifier | None = None, threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict, probability for every row of pages (page_id, url).

    Rules are settled by SQL expressions; the classifier scores every row in Arrow batches (no shuffle, and
    its weights are a fixed 2^16 doubles). Null, empty and malformed urls have an empty host and path and get
    the classifier's verdict on the empty text. Repeated rows are kept, other columns are not carried."""
    spark = pages.sparkSession
    weights = spark.sparkContext.broadcast(model or fit())
    host, path = host_and_path(F.col("url"))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"))
    schema = f"page_id {pages.schema['page_id'].dataType.simpleString()}, host string, path string, probability double"

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            joined = pa.compute.binary_join_element_wise(batch.column("host").cast(pa.string()), batch.column("path").cast(pa.string()), "")
            raw, offsets = text_of(joined)
            p = [np.zeros(0)]
            for i, j in slices(offsets, 1 << 18):
                p.append(weights.value.probability(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(p))], ["page_id", "host", "path", "probability"])

    scored = parsed.mapInArrow(score, schema)
    rule = matching_rule(F.col("host"), F.col("path"), rules)
    scored = scored.withColumn("rule", rule)
    verdict = F.when(F.col("probability") >= threshold, "block").otherwise("allow")
    for kind, text in rules:
        verdict = F.when(F.col("rule") == text, kind).otherwise(verdict)
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "probability")
