"""The pipeline against plain versions of its stages, each on its own input."""

import itertools
from collections import Counter

import corpus_pipeline
from tests.llm.test_near_copies import plain_near_groups
from tests.llm.test_text_operators import plain_removal

from vecloom.llm import toxicity
from vecloom.llm.common import materialize


def test_stages_and_run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, {}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash", "suffix_dedup", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        out = materialize(stage(spark, docs, sf_dir), name)
        kept[name] = (docs.collect(), out.collect())
        if name != "packing":
            assert out.columns == columns
            docs = out
    before, after = kept["toxicity"]
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    fine = {r["doc_id"] for r in toxicity.judge(spark.read.parquet(f"{sf_dir}/documents.parquet"), labels).where("predicted = 0").collect()}
    assert Counter(after) == Counter(r for r in before if r["doc_id"] in fine)
    before, after = kept["simhash"]
    groups = plain_near_groups([(r["doc_id"], r["text"]) for r in before])
    assert Counter(after) == Counter(r for r, g in zip(before, groups, strict=True) if r["doc_id"] == g)
    before, after = kept["suffix_dedup"]
    plain = plain_removal([r["text"].encode() for r in before], 200)
    left = {r["doc_id"]: r for r in after}
    assert len(after) == len(before)
    for r, (n, gone, _, _) in zip(before, plain, strict=True):
        own = left[r["doc_id"]]
        assert own["n_chars"] == len(own["text"]) and n - gone - 8 <= len(own["text"].encode()) <= n - gone
    before, after = kept["packing"]
    assert {r["doc_id"] for r in after} == {r["doc_id"] for r in before}
    fields = ("doc_id", "piece", "start", "length", "ids_crc32")
    whole = [tuple(r[f] for f in fields) for r in corpus_pipeline.run(spark, sf_dir).collect()]
    assert Counter(whole) == Counter(tuple(r[f] for f in fields) for r in after)
    bins = Counter(r["sequence_id"] for r in after)
    assert len(bins) == -(-sum(r["length"] for r in after) // 4096)


def test_pipeline_of_odd_and_no_documents(spark, sf_dir, odd_documents, no_documents):
    for docs in (odd_documents.select(*no_documents.columns), no_documents):
        for name, stage in corpus_pipeline.STAGES:
            docs = materialize(stage(spark, docs, sf_dir), name)
        assert docs.columns[-2:] == ["sequence_id", "offset"]
    assert list(itertools.islice(docs.collect(), 1)) == []
