"""The queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import ann_forest, bpe, collocations, exact_topk, kneser_ney, language_id, packing, runs, simhash, suffix_dedup, toxicity, url_filter, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hundredth vector against all others by integer inner products; all vectors, ten rows a query."""
    return exact_topk.top_k_embeddings(_table(spark, sf_dir, "embeddings"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4,096 tokens; a row for each piece."""
    return packing.pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_ann_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every twentieth vector against all others through the forest; twenty rows a query."""
    return ann_forest.search_embeddings(_table(spark, sf_dir, "embeddings"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC records, indexed, and read back by look-up; a row for each page."""
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored by a model of those outside the held-out seventh."""
    return kneser_ney.train_and_score(_table(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their fingerprints and the components of these at 4 or fewer differing bits."""
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages judged by the fixed rules, else by the classifier."""
    return url_filter.judge_urls(_table(spark, sf_dir, "pages"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded; counts and digests."""
    return bpe.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored by a model of the labelled rows outside the held-out fifth."""
    judged = toxicity.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "held_out", "score", "predicted")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the bytes that repeated strings of 200 bytes cover; counts and digests."""
    return suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents")).drop("kept")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' phrases of two and three words, the 2,000 best of each language."""
    return collocations.collocations(_table(spark, sf_dir, "documents"))


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' languages, by a model of those outside the held-out quarter."""
    return language_id.identify(_table(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, runs planted in a tenth of them, with their periodic runs and the digest of what is left without these."""
    return runs.digests(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_exact_topk": op1_exact_topk,
        "op2_packing": op2_packing,
        "op3_ann_forest": op3_ann_forest,
        "op4_warc": op4_warc,
        "op5_lm_scoring": op5_lm_scoring,
        "op6_simhash": op6_simhash,
        "op7_url_filter": op7_url_filter,
        "op8_bpe": op8_bpe,
        "op9_toxicity": op9_toxicity,
        "op10_suffix_dedup": op10_suffix_dedup,
        "op11_collocations": op11_collocations,
        "op12_language_id": op12_language_id,
        "op13_periodic_runs": op13_periodic_runs,
    }


#: The others are beyond SQL: approximate, iterative, trained, or built on a hash or a tokenizer that SQL lacks.
_SQL = {
    "op1_exact_topk": """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda t: t[1] * t[2]))::BIGINT AS score
FROM e q JOIN e c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM p)
SELECT query_id, n::INTEGER AS rank, vec_id, score FROM r WHERE n <= 10""",
    "op4_warc": """WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h) AS n, sha256(h) AS digest, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN n >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
CASE WHEN n >= 100 AND first <> page_id THEN first END AS refers_to FROM d""",
    "op11_collocations": """WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\\x0A-\\x0D]')) AS p FROM d),
w AS (SELECT lang, list_filter(string_split_regex(p, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM p),
t AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
u AS (SELECT lang, w[i] AS x, w[i + 1] AS y, w[i + 2] AS z FROM t),
c1 AS (SELECT lang, x, count(*)::HUGEINT AS n FROM u GROUP BY lang, x),
c2 AS (SELECT lang, x, y, count(*)::HUGEINT AS n FROM u WHERE y IS NOT NULL GROUP BY lang, x, y HAVING count(*) >= 10),
c3 AS (SELECT lang, x, y, z, count(*)::HUGEINT AS n FROM u WHERE z IS NOT NULL GROUP BY lang, x, y, z HAVING count(*) >= 10),
e AS (SELECT lang, sum(n)::BIGINT AS n FROM c1 GROUP BY lang),
s2 AS (SELECT c2.lang, c2.x || ' ' || c2.y AS phrase, c2.n AS a, f.n AS l, r.n AS r FROM c2 JOIN c1 f ON f.lang = c2.lang AND f.x = c2.x JOIN c1 r ON r.lang = c2.lang AND r.x = c2.y),
k1 AS (SELECT c3.lang, c3.x || ' ' || c3.y || ' ' || c3.z AS phrase, 1 AS k, c3.n AS a, f.n AS l, r.n AS r FROM c3 JOIN c1 f ON f.lang = c3.lang AND f.x = c3.x JOIN c2 r ON r.lang = c3.lang AND r.x = c3.y AND r.y = c3.z),
k2 AS (SELECT c3.lang, c3.x || ' ' || c3.y || ' ' || c3.z AS phrase, 2 AS k, c3.n AS a, f.n AS l, r.n AS r FROM c3 JOIN c2 f ON f.lang = c3.lang AND f.x = c3.x AND f.y = c3.y JOIN c1 r ON r.lang = c3.lang AND r.x = c3.z),
s AS (SELECT *, 1000000 * a * a // (l * r) AS score FROM (SELECT lang, phrase, 1 AS k, a, l, r FROM s2 UNION ALL SELECT * FROM k1 UNION ALL SELECT * FROM k2)),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS o FROM s) WHERE o = 1),
h AS (SELECT lang, phrase, max(n) AS n FROM (SELECT lang, x || ' ' || y AS phrase, n FROM c3 UNION ALL SELECT lang, y || ' ' || z, n FROM c3) GROUP BY lang, phrase),
o AS (SELECT b.* FROM b LEFT JOIN h ON h.lang = b.lang AND h.phrase = b.phrase WHERE h.n IS NULL OR 100 * h.n < 50 * b.a),
q AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM o)
SELECT q.lang, q.rank, q.phrase, q.a::BIGINT AS a, q.l::BIGINT AS l, q.r::BIGINT AS r, e.n, q.score::BIGINT AS score FROM q JOIN e ON e.lang = q.lang WHERE q.rank <= 2000""",
}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
