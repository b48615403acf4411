"""Packing, BPE, language model, SimHash, toxicity and repeats, each against a plain version."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vecloom.llm import bpe, kneser_ney, packing, simhash, suffix_dedup, toxicity
from vecloom.llm.common import components, hash_words

BYTE, WORD = (public_tokenizers.path(f"{n}.json") for n in ("byte_bpe_50k", "word_bpe_49k"))
TOKENS = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def rows_of(df):
    return [r for r in df.select("doc_id", "text").collect()]


# ---- shared helpers ----


def test_hash_words_is_the_split():
    texts = [lower(t) for t in ("One two  THREE", "", "x", " a\tb\nc ", "aa a aaa")]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    h, counts, starts, lengths = hash_words(raw, offsets)
    words = [TOKENS.findall(t) for t in texts]
    assert counts.tolist() == [len(w) for w in words]
    flat = list(itertools.chain(*words))
    assert [bytes(raw[s : s + n]).decode() for s, n in zip(starts, lengths, strict=True)] == flat
    assert len(set(zip(h.tolist(), flat, strict=True))) == len(set(flat)) == len(set(h.tolist()))


def test_components_of_chains_stars_and_nothing(spark):
    links = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 160)] + [(7, 7), (200, 201)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(1, 31)) and all(got[i] == 100 for i in range(101, 160)) and got[201] == 200
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- packing ----


def test_packing_is_whole_and_gapless(spark, sf_dir, odd_documents):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").union(odd_documents.select("doc_id", "text"))
    tokenizer = Tokenizer.from_file(WORD)
    want = Counter()
    for r in rows_of(docs):
        ids = [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        for p, a in enumerate(range(0, len(ids), 4096)):
            own = ids[a : a + 4096]
            want[r["doc_id"], p, a, len(own), zlib.crc32(np.array(own, "<u4").tobytes())] += 1
    got = packing.pack_documents(docs, WORD).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(bins) == -(-sum(r["length"] for r in got) // 4096)


def test_long_documents_are_cut(spark):
    df = spark.createDataFrame([(1, "cat " * 9000), (2, "dog")], "doc_id long, text string")
    got = sorted((r["doc_id"], r["piece"], r["start"], r["length"]) for r in packing.pack_documents(df, WORD).collect())
    assert got == [(1, 0, 0, 4096), (1, 1, 4096, 4096), (1, 2, 8192, 809), (2, 0, 0, 2)]


def optimum(lengths, capacity):
    best = [len(lengths)]

    def place(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(rooms)
            return
        for k, room in enumerate(rooms):
            if room >= lengths[i] and room not in rooms[:k]:
                place(i + 1, rooms[:k] + [room - lengths[i]] + rooms[k + 1 :])
        place(i + 1, [*rooms, capacity - lengths[i]])

    place(0, [])
    return best[0]


@pytest.mark.parametrize("seed", range(12))
def test_bin_completion_finds_the_optimum(seed):
    rng = random.Random(seed)
    lengths = sorted((rng.randint(10, 60) for _ in range(11)), reverse=True)
    plan = packing.bin_completion(dict(Counter(lengths)), 100)
    used = Counter()
    for pattern, times in plan:
        assert sum(f * n for f, n in pattern) <= 100
        for f, n in pattern:
            used[f] += n * times
    assert used == Counter(lengths)
    assert sum(n for _, n in plan) == optimum(lengths, 100)


def test_bin_completion_of_nothing_and_of_equals():
    assert packing.bin_completion({}, 10) == []
    assert sum(n for _, n in packing.bin_completion({4: 1_000_001}, 10)) == 500_001


def test_packing_of_nothing(no_documents):
    assert packing.pack_documents(no_documents, WORD).count() == 0


# ---- BPE ----


def random_texts(n, seed=1):
    rng = random.Random(seed)
    parts = ["a", "b", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "'s", "'ll", "12", "é", "日本", "🙂", "<|endoftext|>", "!", "...", "the ", "ing", "\r\n", "\x00", "Ω", "́"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(n)]


def packed(texts):
    data = [t.encode() for t in texts]
    return np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum([len(d) for d in data])])


def test_encoder_equals_the_library():
    texts = [*random_texts(3000), "a" * 900, "ab" * 500, " " * 60]
    encoder, library = bpe.Encoder(bpe.load(open(BYTE, encoding="utf-8").read())), Tokenizer.from_file(BYTE)
    flat, at = encoder.encode(*packed(texts))
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [flat[a:b].tolist() for a, b in itertools.pairwise(at)] == want
    assert bpe.decode_ids(encoder.v, flat, at) == [library.decode(w, skip_special_tokens=False) for w in want]


def test_packing_tokenizer_equals_the_library():
    texts = random_texts(3000, 2) + ["Σ ΑΣ İ", "ẞ"]
    library = Tokenizer.from_file(WORD)
    flat, at = packing.WordEncoder(open(WORD, encoding="utf-8").read()).encode(*packed(texts))
    assert [flat[a:b].tolist() for a, b in itertools.pairwise(at)] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_round_trip_of_odd_documents(odd_documents, no_documents):
    library = Tokenizer.from_file(BYTE)
    want = Counter()
    for r in rows_of(odd_documents):
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        want[r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()] += 1
    assert Counter(map(tuple, bpe.round_trip(odd_documents, BYTE).collect())) == want
    back = bpe.decode(bpe.encode(odd_documents, BYTE), BYTE).collect()
    assert Counter(r["text"] for r in back) == Counter(r["text"] or "" for r in rows_of(odd_documents))
    assert bpe.round_trip(no_documents, BYTE).count() == 0


# ---- language model ----


def plain_model(texts):
    grams, ends = Counter(), object()
    for t in texts:
        w = ["<s>", *TOKENS.findall(lower(t)), ends]
        grams.update(zip(w[:-1], w[1:], strict=True))

    def discounts(counts):
        n = [sum(c == k for c in counts) for k in (1, 2, 3, 4)]
        return kneser_ney._discounts(*n)

    after, count, total = Counter(), Counter(), Counter()
    kinds = defaultdict(lambda: [0, 0, 0])
    for (h, w), c in grams.items():
        after[w] += 1
        count[w] += c
        total[h] += c
        kinds[h][min(c, 3) - 1] += 1
    d, e = discounts(grams.values()), discounts(after.values())
    pairs, v = len(grams), len(count)
    mass = sum(e[min(c, 3) - 1] for c in after.values()) / pairs if pairs else 1.0

    def p(h, w):
        low = ((after[w] - e[min(after[w], 3) - 1]) / pairs if after[w] else 0) + mass / (v + 1)
        if not total[h]:
            return low
        c = grams[h, w]
        own = (c - d[min(c, 3) - 1]) / total[h] if c else 0
        return own + sum(x * n for x, n in zip(d, kinds[h], strict=True)) / total[h] * low

    return p, count, ends


def test_scores_equal_a_plain_model(spark, sf_dir, odd_documents):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").union(odd_documents.select("doc_id", "text"))
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    rows = rows_of(docs)
    p, count, end = plain_model([r["text"] for r in rows if not held(r["doc_id"])])
    n, v = sum(count.values()), len(count)
    want = defaultdict(list)
    for r in rows:
        w = ["<s>", *TOKENS.findall(lower(r["text"])), end]
        base = sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w[1:])
        score = sum(math.log10(p(a, b)) for a, b in zip(w[:-1], w[1:], strict=True))
        want[r["doc_id"]].append((held(r["doc_id"]), len(w) - 1, sum(count[x] > 0 for x in w[1:]), n, base, score))
    got = defaultdict(list)
    for r in kneser_ney.train_and_score(docs).collect():
        got[r["doc_id"]].append(tuple(r)[1:])
    assert got.keys() == want.keys()
    for i, own in want.items():
        for a, b in zip(sorted(got[i]), sorted(own), strict=True):
            assert a[:4] == b[:4] and a[4] == pytest.approx(b[4], abs=1e-6) and a[5] == pytest.approx(b[5], abs=1e-6)


def test_probabilities_sum_to_one(spark):
    texts = ["a b a c", "b a", "c c c b", ""]
    model = kneser_ney.fit(spark.createDataFrame([(t,) for t in texts], "text string"), 8)
    words = ["a", "b", "c"]
    raw = np.frombuffer(" ".join(words).encode(), np.uint8)
    h = hash_words(raw, np.array([0, len(raw)]))[0]
    every = np.concatenate([h, [kneser_ney.END, np.uint64(12345)]])  # and one unknown word
    for context in (*h, kneser_ney.BEGIN, np.uint64(777)):
        logs, _ = model.logs(every, np.full(len(every), context, np.uint64))
        assert (10**logs).sum() == pytest.approx(1)


def test_large_counts_are_kept(spark, monkeypatch):
    many = np.array([3, 1 << 40], np.int64)
    for columns in ([np.array([1, 2], np.uint64), many], [np.array([1, 2], np.uint64), many[:1]]):
        assert [c.tolist() for c in kneser_ney._unpack(kneser_ney._pack(*columns), 1)] == [c.tolist() for c in columns]
    texts = ["a b a b a b c", "a b", "c a"]
    small = kneser_ney.fit(spark.createDataFrame([(t,) for t in texts], "text string"), 2)
    raw = np.frombuffer(b"a b c", np.uint8)
    h = hash_words(raw, np.array([0, len(raw)]))[0]
    args = np.tile(h, 3), np.repeat(h, 3)
    before = small.logs(*args)[0]
    monkeypatch.setattr(kneser_ney, "LARGE", 2)  # counts of 2 and more are looked for in the file of large counts, which has none
    key = kneser_ney.bigram_key(args[1], args[0], small.hot)
    for r in range(2):
        own = np.unique(key[kneser_ney.range_of(key, 2) == r])
        keys, counts = (np.fromfile(f"{small.path.removeprefix('file://')}/bigram-{n}-{r:05d}.bin", t) for n, t in (("keys", "<u8"), ("counts", "<u4")))
        large = [(k, c) for k, c in zip(keys.tolist(), counts.tolist(), strict=True) if c >= 2]
        np.array(large, "<u8").reshape(-1, 2).tofile(f"{small.path.removeprefix('file://')}/bigram-large-{r:05d}.bin")
        np.minimum(counts, 2).astype("<u4").tofile(f"{small.path.removeprefix('file://')}/bigram-counts-{r:05d}.bin")
        assert len(own)
    kneser_ney._mapped.cache_clear()
    assert small.logs(*args)[0].tolist() == before.tolist()


def test_held_out_text_is_likelier_than_the_base(spark, sf_dir):
    scored = kneser_ney.train_and_score(spark.read.parquet(f"{sf_dir}/documents.parquet")).where("held_out")
    row = scored.agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert row["s"] > row["b"]
    assert kneser_ney.perplexity(scored).where("perplexity < 1").isEmpty()


def test_scoring_nothing(no_documents):
    assert kneser_ney.train_and_score(no_documents).count() == 0


# ---- SimHash ----


def plain_fingerprint(text):
    words = TOKENS.findall(lower(text))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(len(words) - 3, 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(prints):
    """prints: (doc_id, fingerprint); the smallest reachable doc_id of each row."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(prints)), 2):
        if (prints[i][1] ^ prints[j][1]).bit_count() <= 4:
            root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(prints):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return [least.get(find(i)) for i in range(len(prints))]


def test_groups_equal_all_pairs(spark, sf_dir, odd_documents):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").union(odd_documents.select("doc_id", "text"))
    prints = [(r["doc_id"], plain_fingerprint(r["text"])) for r in rows_of(docs)]
    want = Counter((d, f"{f:016x}", c) for (d, f), c in zip(prints, plain_groups(prints), strict=True))
    assert Counter(map(tuple, simhash.near_duplicates(docs).collect())) == want


def test_xxh64_equals_the_library():
    rng = random.Random(3)
    data = [rng.randbytes(n) for n in [*range(100), 255, 256, 1000, 2048]]
    raw = np.frombuffer(b"".join(data) + bytes(8), np.uint8)
    size = np.array([len(x) for x in data])
    for seed in (0, 42):
        assert simhash.xxh64(raw, np.cumsum(size) - size, size, seed).tolist() == [xxhash.xxh64_intdigest(x, seed) for x in data]


def test_fingerprints_of_long_texts_and_words(spark):
    rng = random.Random(11)
    texts = [" ".join(rng.choices(["Road", "sea", "é", "x" * 40, "A"], k=n)) for n in (3, 4, 5, 300, 1023)] + ["w" * 9000 + " b c d e", "a  b\t\tc", None, ""]
    got = {r["doc_id"]: r["fp"] & (1 << 64) - 1 for r in simhash.fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(texts))] == [plain_fingerprint(t) for t in texts]


def test_anchors_cover_and_comparisons_stay_few():
    rng = np.random.default_rng(12)
    fp = rng.integers(0, 1 << 64, 4000, np.uint64)
    other = fp.copy()
    for _ in range(4):
        other ^= np.uint64(1) << rng.integers(0, 64, 4000).astype(np.uint64)  # up to 4 bits apart
    keys = [set(zip(*(x.tolist() for x in simhash.anchors(f)), strict=True)) for f in (fp, other)]
    assert {r for r, _ in keys[0] & keys[1]} == set(range(4000))
    pairs = []
    for n in (50_000, 200_000):
        _, key = simhash.anchors(rng.integers(0, 1 << 64, n, np.uint64))
        _, size = np.unique(key, return_counts=True)
        pairs.append(int((size * (size - 1) // 2).sum()) / n)
    assert pairs[1] < 10  # comparisons for each of 200,000 fingerprints


@pytest.mark.parametrize(("tile", "few"), [(16_384, 48), (16_384, 1), (3, 48)])
def test_links_are_complete(spark, monkeypatch, tile, few):
    monkeypatch.setattr(simhash, "TILE", tile)
    monkeypatch.setattr(simhash, "FEW", few)
    rng = random.Random(4)
    fps = {rng.getrandbits(64) for _ in range(150)}
    for f in list(fps)[:60]:
        for n in (1, 2, 3, 4, 4, 5):
            g = f
            for b in rng.sample(range(64), n):
                g ^= 1 << b
            fps.add(g)
    fps = sorted(fps)
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    roots = {r["node"]: r["root"] for r in components(simhash.close_links(df)).collect()}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    want = plain_groups(list(zip(signed, fps, strict=True)))
    assert [roots.get(s, s) for s in signed] == want


def test_covering_reaches_all():
    unit, table = simhash.covering()
    assert table.shape == (2048, 6) and (table[:, 0] >= 0).all()
    weights = np.array([int(e).bit_count() for e in table[:, 0]])
    assert weights.max() == 3 and (table >= 0).sum() == 1 + 23 + 253 + 1771 + 8855


def test_keep_one_keeps_columns(odd_documents, no_documents):
    kept = simhash.keep_one(odd_documents)
    assert kept.columns == odd_documents.columns
    # the empty, blank and null texts are one group; of a repeated row one stays
    assert kept.where("text is null or trim(text) in ('', '\\n\\t')").count() == 1
    assert kept.where("text = 'same text twice here'").count() == 1
    assert simhash.keep_one(no_documents).count() == 0


def test_keep_one_decides_by_component(spark):
    a, b, c, d = ("alpha beta gamma delta epsilon", "one two three four five six", "the sea is wide and deep", "new roads lead to old towns")
    rows = [(None, a), (None, b), (None, b), (2, a), (3, c), (3, d), (3, d), (1, c)]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert Counter(map(tuple, kept)) == Counter([(None, b), (2, a), (1, c), (3, d)])


# ---- toxicity ----


def test_segments_equal_a_plain_search():
    rng = random.Random(5)
    for _ in range(200):
        s = [rng.choice([-2, -1, -0.5, 0.5, 1, 3]) for _ in range(rng.randint(1, 30))]
        total = list(itertools.accumulate(s, initial=0))
        up = [i for i, x in enumerate(s) if x > 0]
        got = [(up[a], up[b], round(x, 9)) for a, b, x in toxicity.maximal_segments([total[i] for i in up], [total[i + 1] for i in up])]

        def plain(lo, hi):
            best = max(((total[j + 1] - total[i], i, -j) for i in range(lo, hi) for j in range(i, hi)), default=(0, 0, 0))
            if best[0] <= 0:
                return []
            i, j = best[1], -best[2]  # of equals the shortest
            return [*plain(lo, i), (i, j, round(best[0], 9)), *plain(j + 1, hi)]

        assert [g[2] for g in got] == [w[2] for w in plain(0, len(s))]


def test_segments_lie_where_a_plain_search_finds_them():
    rng = random.Random(6)
    for _ in range(200):
        s = [rng.gauss(-0.3, 1) for _ in range(rng.randint(1, 40))]
        total = list(itertools.accumulate(s, initial=0))
        up = [i for i, x in enumerate(s) if x > 0]
        got = [(up[a], up[b]) for a, b, _ in toxicity.maximal_segments([total[i] for i in up], [total[i + 1] for i in up])]

        def plain(lo, hi):
            best = max(((total[j + 1] - total[i], i, j) for i in range(lo, hi) for j in range(i, hi)), default=(0, 0, 0))
            if best[0] <= 0:
                return []
            _, i, j = best
            return [*plain(lo, i), (i, j), *plain(j + 1, hi)]

        assert got == plain(0, len(s))


def plain_toxicity(texts, rows, drift=0.5, strength=8.0):
    """The score of each text, learnt from rows (text, toxic, half): words and stems as bytes, in dictionaries; each half is judged by the other."""
    words = lambda t: [w.lower() for w in re.findall(rb"[A-Za-z\x80-\xff]+", (t or "").encode())]
    nodes = lambda w: [(4, w[:4]), (6, w[:6]), (0, w)]

    def learnt(rows):
        count = {kind: Counter(n for t, y, _ in rows if y == kind for w in words(t) for n in nodes(w)) for kind in (0, 1)}
        share = sum(count[1].values()) / (sum(count[0].values()) + sum(count[1].values()))

        def points(w):
            q = share
            for n in nodes(w):
                q = (count[1][n] + strength * q) / (count[0][n] + count[1][n] + strength)
            return math.log(q / (1 - q)) - math.log(share / (1 - share)) - drift

        return lambda t: [points(w) for w in words(t)]

    halves = [learnt([r for r in rows if r[2] != h]) for h in (0, 1)]

    def segments(s):
        total = list(itertools.accumulate(s, initial=0))
        best = max(((total[j + 1] - total[i], i, j) for i in range(len(s)) for j in range(i, len(s))), default=(0, 0, 0))
        return [] if best[0] <= 1e-12 else [*segments(s[: best[1]]), best[0], *segments(s[best[2] + 1 :])]

    rest = [(halves[h](t), y) for t, y, h in rows]
    bins = Counter(max(min(round(x / 0.01), 2047), -2048) for s, y in rest if y == 0 for x in s)
    excess = lambda r: sum(n * math.exp(r * b * 0.01) for b, n in bins.items()) / sum(bins.values()) - 1
    lo, hi = 1e-4, 64.0
    for _ in range(200):
        lo, hi = (lo, (lo + hi) / 2) if excess((lo + hi) / 2) > 0 else ((lo + hi) / 2, hi)
    tops = [(max(segments(s), default=0), max(len(s), 1)) for s, y in rest if y == 0]
    gumbel = [lo * x - math.log(m) for x, m in tops if x > 0]
    size = math.exp(sum(gumbel) / len(gumbel) - 0.5772156649015329)

    def stats(s):
        found = segments(s)
        rare = [max(lo * x - math.log(size * max(len(s), 1)), 0) for x in found]
        return [max(rare, default=0), sum(rare), math.log1p(100 * sum(found) / max(len(s), 1))]

    x, y = np.array([stats(s) for s, _ in rest]), np.array([y for _, y in rest], float)
    centre, spread = x.mean(0), x.std(0) + 1e-9
    design = np.column_stack([np.ones(len(x)), (x - centre) / spread])
    weight, beta = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean())), np.zeros(4)
    for _ in range(200):
        p = 1 / (1 + np.exp(-design @ beta))
        hess = design.T @ (design * (weight * p * (1 - p))[:, None]) + 0.01 * np.eye(4)
        beta -= np.linalg.solve(hess, design.T @ (weight * (p - y)) + 0.01 * beta)
    p = 1 / (1 + np.exp(-design @ beta))
    edges = sorted({0.0, 1.0, *p.tolist()})
    cuts = [0.5, *((lo + hi) / 2 for lo, hi in itertools.pairwise(edges) if lo + hi > 1)]
    gain = [np.mean(p[y == 1] >= c) - 5 * np.mean(p[y == 0] >= c) for c in cuts]
    cut = min(c for c, g in zip(cuts, gain, strict=True) if g >= max(gain) - 1e-12)
    scored = learnt(rows)
    z = [beta @ [1, *((np.array(stats(scored(t))) - centre) / spread)] - math.log(cut / (1 - cut)) for t in texts]
    return [float(1 / (1 + np.exp(-v))) for v in z]


def test_scores_equal_a_plain_version(spark):
    rng = random.Random(9)
    bad, fine = ["nasty", "nastier", "foolish", "foolery", "trashy", "Große"], ["road", "sea", "wide", "house", "nest", "größer", "fool", "long", "trail", "it's"]
    rows = []
    for i in range(500):
        y = int(rng.random() < 0.3)
        w = rng.choices(fine, k=rng.randint(0, 25)) + rng.choices(bad, k=rng.randint(1, 4) * (y if rng.random() < 0.9 else 1 - y))
        rng.shuffle(w)
        rows.append((i, " ".join(w) if rng.random() < 0.98 else None, y))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    half = {r["doc_id"]: r["h"] for r in docs.select("doc_id", F.xxhash64(F.lit(7), "doc_id").bitwiseAND(1).alias("h")).collect()}
    first = {}
    for i, t, y in rows:
        if t is not None and zlib.crc32(str(i).encode()) % 5:
            first.setdefault(t, (t, y, half[i]))  # of equal texts that of the smallest id
    want = plain_toxicity([t for _, t, _ in rows], list(first.values()))
    got = {r["doc_id"]: r["score"] for r in toxicity.judge(docs, labels).collect()}
    assert max(want) > 0.9 and min(want) < 0.1
    for (i, _, _), w in zip(rows, want, strict=True):
        assert got[i] == pytest.approx(w, abs=1e-4)


@pytest.mark.parametrize("sf,least", [("sf0.001", 0), ("sf0.01", 0.75), ("sf0.1", 0.93)])
def test_both_classes_are_served(spark, sf, least):
    """Few labels must not mean many false alarms: over all labelled rows clean ones are left alone at every size."""
    docs, labels = (spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet") for t in ("documents", "labels"))
    judged = toxicity.judge(docs, labels).join(labels, "doc_id").groupBy("toxic").agg(F.avg("predicted").alias("hit"), F.avg(F.when(F.col("held_out"), F.col("predicted"))).alias("held"))
    hit = {r["toxic"]: r for r in judged.collect()}
    assert hit[0]["hit"] <= 0.03 and hit[1]["hit"] >= least and hit[1]["held"] >= least
    assert sf != "sf0.1" or hit[0]["held"] < 0.015


def test_planted_words_are_caught(spark):
    """Words that toxic texts share are found in new texts, and new texts without them are not."""
    rng = random.Random(4)
    fine, bad = [f"word{i}" for i in range(300)], ["vilest", "scumbag", "loathsome"]
    text = lambda n: " ".join(rng.choices(fine, k=40) + rng.choices(bad, k=n))
    rows = [(i, text(3 * (i % 8 == 0))) for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 8 == 0)) for i in range(150)], "doc_id long, toxic int")
    got = {r["doc_id"]: r["predicted"] for r in toxicity.judge(docs, labels).collect()}
    new = [(got[i], int(i % 8 == 0)) for i in range(150, 1200)]
    assert sum(p for p, y in new if y) >= 0.95 * sum(y for _, y in new) and sum(p for p, y in new if not y) <= 0.02 * len(new)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    judged = toxicity.judge(docs, labels).where("held_out").join(labels, "doc_id").select("score", "predicted", "toxic").toPandas()
    assert (judged.predicted == judged.toxic).mean() > 0.95
    r, n = judged.score.rank(), judged.toxic.sum()
    assert (r[judged.toxic == 1].sum() - n * (n + 1) / 2) / (n * (len(judged) - n)) > 0.9


def test_passages_lie_in_their_text(spark):
    bad, fine = "you stupid awful fool", "the day was long and the road went on"
    rows = [(i, f"{fine} {bad if i % 2 else fine} {fine} {i}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.judge(docs, labels).collect()}
    for i, text in rows:
        assert got[i]["predicted"] == i % 2 and 0 <= got[i]["score"] <= 1
        assert [text[p["start"] : p["end"]] for p in got[i]["passages"]] == ([bad] if i % 2 else [])


def test_toxicity_of_odd_rows(spark, odd_documents, no_documents):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    judged = toxicity.judge(odd_documents, none)
    assert judged.count() == odd_documents.count() and judged.where("score is null or predicted <> 0").isEmpty()
    all_bad = spark.createDataFrame([(i, 1) for i in range(20)] + [(None, 1), (5, None), (5, 1)], "doc_id long, toxic int")
    assert toxicity.judge(odd_documents, all_bad).where("predicted <> 1").isEmpty()
    assert toxicity.judge(no_documents, all_bad).count() == 0
    kept = toxicity.reject(odd_documents, toxicity.fit(odd_documents, none))
    assert kept.columns == odd_documents.columns and kept.count() == odd_documents.count()


# ---- repeats ----


def plain_removal(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("length,gram,most,batch", [(12, 5, 8192, 65_536), (20, 8, 8192, 40), (12, 5, 1, 65_536), (9, 9, 8192, 65_536)])
def test_removal_equals_a_plain_search(spark, monkeypatch, length, gram, most, batch):
    monkeypatch.setattr(suffix_dedup, "MOST_RUNS", most)
    monkeypatch.setattr(suffix_dedup, "SUFFIXES", batch)
    rng = random.Random(6)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 60))) for _ in range(120)]
    texts += ["a" * 100, "ab" * 40, "", None, "é" * 30, *["abcdefghijklmnopqrstuvwxyz0123456789"] * 3]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, kept string").repartition(3)
    got = suffix_dedup.remove_repeats(df, length, gram).orderBy("doc_id").drop("kept", "doc_id").collect()
    assert list(map(tuple, got)) == plain_removal([(t or "").encode() for t in texts], length)


@pytest.mark.parametrize("windows", [1 << 20, 30])
def test_long_runs_are_cut_without_loss(spark, monkeypatch, windows):
    text = "round and round it goes, " * 2000
    rows = spark.createDataFrame([(1, text), (2, "é" * 15_000)], "rid long, text string")
    runs = suffix_dedup.find_runs(rows, 200, 32).groupBy("rid").agg(F.max("n").alias("most"), F.sum("n").alias("n")).orderBy("rid").collect()
    assert [r["n"] for r in runs] == [len(text) - 199, 30_000 - 199] and max(r["most"] for r in runs) <= 16_384
    for name, value in (("STEP", 100), ("RUN_WINDOWS", 7), ("MOST_WINDOWS", windows)):
        monkeypatch.setattr(suffix_dedup, name, value)
    texts = ["ab" * 200, "abc" * 100 + "x", "no copy of anything here", "c" + "ab" * 90 + "abc" * 30, "".join(random.Random(8).choices("ab", k=900))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    got = suffix_dedup.remove_repeats(df, 12, 5).orderBy("doc_id").drop("kept", "doc_id").collect()
    assert list(map(tuple, got)) == plain_removal([t.encode() for t in texts], 12)


def test_family_of_levels_matches_across_batches(spark):
    rng = random.Random(13)
    texts = ["".join(rng.choices("ab", k=rng.randint(8, 30))) for _ in range(40)]
    family, got = suffix_dedup.IndexFamily(8), set()
    for b in range(5):
        rows = [(1, i, bytearray(t.encode())) for i, t in enumerate(texts) if i % 5 == b]
        for r in family.add(spark.createDataFrame(rows, "key long, span long, text binary")).collect():
            got |= {(r["span"], at) for at in range(r["at"], r["at"] + r["n"])}
    assert [rank for rank, _ in family.levels] == [2, 0]  # four batches merged into one level, the fifth alone
    levels = [level.collect() for _, level in family.levels]
    assert sorted(r["span"] for rows in levels for r in rows) == list(range(40))
    seen = Counter(t[i : i + 8] for t in texts for i in range(len(t) - 7))
    assert got == {(k, i) for k, t in enumerate(texts) for i in range(len(t) - 7) if seen[t[i : i + 8]] > 1}


def test_repeated_rows_and_stripping(spark, no_documents):
    line = "one two three four five six seven eight nine ten"
    rows = [(1, f"start {line} end", 7), (1, f"start {line} end", 7), (2, f"other {line} tail", 7), (3, None, None), (4, "short", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    got = sorted(map(tuple, suffix_dedup.strip_repeats(df, 20, 8).collect()), key=str)
    # " two ... ten " is what 1 and 2 share, from the space before "one" on; the rows of 1 repeat each other as a whole
    assert got == sorted([(1, "", 0), (1, "", 0), (2, "othertail", 9), (3, None, None), (4, "short", 5)], key=str)
    assert suffix_dedup.remove_repeats(no_documents).count() == 0
