"""How many pairs of near copies the pipeline's stage leaves in: python -m tests.llm.measure_near_copies SF_DIR

Pairs of distinct sets of five-word shingles with a Jaccard similarity from 0.8 to below 1 are found by prefixes of rare shingles."""

import math
import sys
import tempfile
from collections import Counter, defaultdict

from pyspark.sql import SparkSession

from tests.llm.test_near_copies import plain_shingles
from vecloom.llm import resemblance, simhash
from vecloom.session import ship


def near_pairs(sets):
    """(i, j) of sets, a dict of distinct non-empty sets, that share 0.8 or more of their union."""
    often = Counter(s for x in sets.values() for s in x)
    index, pairs = defaultdict(list), []
    for i, x in sorted(sets.items(), key=lambda z: len(z[1])):
        seen = set()
        for s in sorted(x, key=lambda s: (often[s], s))[: len(x) - math.ceil(4 * len(x) / 5) + 1]:
            for j in index[s]:
                if j not in seen:
                    seen.add(j)
                    both = len(x & sets[j])
                    if 5 * both >= 4 * (len(x) + len(sets[j]) - both):
                        pairs.append((i, j))
            index[s].append(i)
    return pairs


def main() -> None:
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "file://" + tempfile.mkdtemp(prefix="spark-")).getOrCreate()
    )
    docs = ship(spark).read.parquet(f"{sys.argv[1]}/documents.parquet")
    sets: dict[frozenset, int] = {}
    for doc, text in sorted(map(tuple, docs.select("doc_id", "text").collect())):
        sets.setdefault(frozenset(plain_shingles(text)), doc)
    pairs = near_pairs({doc: x for x, doc in sets.items() if x})
    print("distinct sets:", len(sets), "pairs:", len(pairs))
    for name, stage in (("five words, 0.8 or more, or 4 bits", resemblance.keep_one), ("four words, 4 bits alone", simhash.keep_one)):
        kept = {r["doc_id"] for r in stage(docs).select("doc_id").collect()}
        print(f"{name}: kept {len(kept)}, pairs that both stay {sum(i in kept and j in kept for i, j in pairs)}")


if __name__ == "__main__":
    main()
