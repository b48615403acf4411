"""Near copies by fingerprints and by resemblance, against all pairs."""

import itertools
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from vecloom.llm import resemblance
from vecloom.llm.common import text_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_shingles(text):
    words = WORD.findall((text or "").translate(LOWER))
    return [" ".join(words[i : i + 5]) for i in range(max(len(words) - 4, 1))] if words else []


def plain_near_groups(rows):
    """rows: (doc_id, text); the smallest reachable doc_id of each row."""
    prints, sets, root = [], [], list(range(len(rows)))
    for _, text in rows:
        shingles = plain_shingles(text)
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
        sets.append(set(shingles))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if (prints[i] ^ prints[j]).bit_count() <= 4 or both and 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
            root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[find(i)] = min(doc, least.get(find(i), doc))
    return [least[find(i)] for i in range(len(rows))]


def edited_texts(seed=3):
    """Families of texts of edited words, so that similarities lie on both sides of 0.8, and texts of no family."""
    rng = random.Random(seed)
    vocabulary = [f"word{i}" for i in range(3000)]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(5, 400))) for _ in range(60)]
    for _ in range(12):
        base = rng.choices(vocabulary, k=300)
        texts.append(" ".join(base))
        for edits in range(1, 13):
            own = list(base)
            for place in rng.sample(range(300), edits):
                own[place] = rng.choice(vocabulary).upper()
            texts.append("  ".join(own))
    rng.shuffle(texts)
    return texts


def test_keeps_one_of_each_group(spark):
    rows = list(enumerate(edited_texts()))
    kept = resemblance.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    groups = plain_near_groups(rows)
    assert 60 < len(set(groups)) < len(rows)
    assert Counter(map(tuple, kept)) == Counter(r for r, g in zip(rows, groups, strict=True) if r[0] == g)


def test_full_bands_are_dealt_out(spark, monkeypatch):
    rows = list(enumerate(edited_texts(4)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    whole = {r["doc_id"] for r in resemblance.keep_one(docs).collect()}
    monkeypatch.setattr(resemblance, "TILE", 3)
    assert {r["doc_id"] for r in resemblance.keep_one(docs).collect()} == whole


def test_odd_and_no_documents(spark, odd_documents, no_documents):
    clash = odd_documents.withColumn("own", F.lit(1)).withColumn("cls", F.lit(2)).withColumn("first", F.lit(3)).withColumn("row", F.lit(4))
    kept = resemblance.keep_one(clash)
    assert kept.columns == clash.columns
    rows = kept.collect()
    assert [r["doc_id"] for r in rows if not (r["text"] or "").strip()] == [0]  # null, empty and blank texts are alike
    assert sum((r["text"] or "").lower() == "word" for r in rows) == 1
    assert sum(r["text"] == "same text twice here" for r in rows) == 1
    assert sum(r["text"] == "no id" for r in rows) == 1
    assert resemblance.keep_one(no_documents).count() == 0


def test_spanning_forest_holds_together_what_any_floor_does():
    rng = np.random.default_rng(1)
    sig = rng.integers(0, 3, (40, resemblance.MINIMA), np.uint8)
    sig[20:] = np.where(rng.random((20, resemblance.MINIMA)) < 0.3, sig[20:], sig[:20])
    equal = (sig[:, None] == sig[None]).sum(axis=2)

    def parts(links):
        label = list(range(40))
        for i, j in links:
            old, new = label[i], label[j]
            label = [new if x == old else x for x in label]
        return Counter(Counter(label).values())

    forest = resemblance.spanning(sig, 40)
    assert all(equal[i, j] == e for i, j, e in forest)
    for floor in (40, 60, 80, 90):
        want = parts([(i, j) for i, j in itertools.combinations(range(40), 2) if equal[i, j] >= floor])
        assert parts([(i, j) for i, j, e in forest if e >= floor]) == want


def test_sketches_follow_the_words_alone():
    whole, sig, keys = resemblance.sketch(*text_of(pa.array(["a b c d e f", " A\tb  C d e\nf ", "a b c d e g", "", "a b", "ab"])))
    assert (whole[0] == whole[1]).all() and (sig[0] == sig[1]).all() and (keys[0] == keys[1]).all()
    assert len({tuple(x) for x in whole.tolist()}) == 5
    assert not keys[3].any() and keys[4].all()
