"""URL verdicts and WARC archives against plain versions."""

import gzip
import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecloom.llm import url_filter, warc


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
    host, rest = rest[:cut], rest[cut:]
    end = min([i for i in map(rest.find, "?#") if i >= 0], default=len(rest))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), rest[:end]


def plain_rule(host, path):
    fits = []
    for kind, rule in url_filter.RULES:
        name, _, rest = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + rest):
            fits.append((len(rule), kind, rule))
    return max(fits)[1:] if fits else (None, None)


URLS = [None, "", "no scheme", "http://", "http://A.EXAMPLE.Net/en/1?x#y", "https://example.net/en", "http://example.net", "http://example.net/", "x://y://example.net/en/",
        "http://notexample.net/en/", "http://a.example.com/de/1", "http://example.com/dex", "http://q.org/fr/9", "http://org/fr/", "http://host.org?q=/fr/", "http://É.net/en/", "http://casino-win.example.org/a#b",
        "http://" + "a" * 20000 + ".com/", "http://a.b/c\nd?e", "http://a.b\tc/d"]


def test_verdicts(spark):
    df = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(URLS)] + [(None, "http://x.net/", "h", "r"), (0, None, "h", "r")], "page_id long, url string, host string, rule string")
    model = url_filter.fit()
    rows = url_filter.judge_urls(df).collect()
    assert len(rows) == len(URLS) + 2
    for r in rows:
        url = "http://x.net/" if r["page_id"] is None else URLS[r["page_id"]]
        host, path = plain_parts(url)
        kind, rule = plain_rule(host, path)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        raw = (host + path).encode()
        p = model.probability(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0]
        assert r["probability"] == pytest.approx(p) and r["verdict"] == (kind or ("block" if p >= 0.5 else "allow"))
    assert url_filter.judge_urls(df.limit(0)).count() == 0


def test_classifier_learns_its_table_and_its_kin():
    model = url_filter.fit()
    def p(text):
        raw = np.frombuffer(text.encode(), np.uint8)
        return model.probability(raw, np.array([0, len(raw)]))[0]

    for url, y in url_filter.labelled_urls():
        assert (p(url.split("://")[1].split("?")[0]) >= 0.5) == bool(y)
    assert p("shop.cheap-pills.example.com/new/1") > 0.5 > p("www.therti.example.org/en/618/")
    assert url_filter.fit([]).bias < 0 < url_filter.fit([("http://a/", 1)]).bias


def test_classifier_equals_a_plain_one_and_holds_on_urls_not_seen():
    rows = url_filter.labelled_urls()
    held = [r for r in rows if zlib.crc32(r[0].encode()) % 4 == 0]
    seen = [r for r in rows if zlib.crc32(r[0].encode()) % 4]
    bare = lambda u: u.split("://")[1].split("?")[0].encode()
    grams = lambda t: [t[i : i + n] for n in (3, 4, 5) for i in range(len(t) - n + 1)]
    few, y = [grams(bare(u)) for u, _ in seen[::12]], [v for _, v in seen[::12]]
    w, bias = Counter(), 0.0
    for _ in range(50):
        error = [1 / (1 + math.exp(-(sum(w[g] for g in t) / math.sqrt(len(t)) + bias))) - v for t, v in zip(few, y, strict=True)]
        step = Counter({g: 1e-4 * x for g, x in w.items()})
        for t, e in zip(few, error, strict=True):
            for g in t:
                step[g] += e / math.sqrt(len(t))
        for g, x in step.items():
            w[g] -= 0.5 * x
        bias -= 0.5 * sum(error) / len(error)

    def of(model, urls):
        raw = [bare(u) for u, _ in urls]
        return model.probability(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))

    plain = [1 / (1 + math.exp(-(sum(w[g] for g in grams(bare(u))) / math.sqrt(len(grams(bare(u)))) + bias))) for u, _ in held]
    assert of(url_filter.fit(seen[::12], buckets=1 << 24, epochs=50), held) == pytest.approx(plain, abs=1e-6)
    hit = (of(url_filter.fit(seen), held) >= 0.5) == np.array([v for _, v in held])
    assert hit.mean() > 0.95


def pages(spark):
    rng = random.Random(7)
    rows = [(i, f"http://h{i % 3}.example.com/p/{i % 40}?q={i % 2}", f"<p>{'text ' * rng.randint(0, 60)}{i % 25}</p>") for i in range(300)]
    rows += [(1000, None, None), (1001, None, ""), (1002, "http://x.org/", "s" * 99), (1003, "http://x.org/", "s" * 99), (1004, "http://x.org/", "é" * 50), (1005, "http://x.org/", "é" * 50)]
    rows += [(1006, "http://e\tvil\r\n.org/a%b", "z" * 200), (1006, "http://e\tvil\r\n.org/a%b", "z" * 200), (None, "http://n.org/", "z" * 200), (1007, "http://big.org/", "日" * 200_000)]
    return rows, spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, key string").repartition(3)


def test_archive_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 7)
    rows, df = pages(spark)
    least = {}
    for page, _, html in rows:
        if page is not None:
            least[html or ""] = min(page, least.get(html or "", page))
    want = []
    for page, _, html in rows:
        data = (html or "").encode()
        first = least[html or ""]
        revisit = len(data) >= 100 and page != first
        want.append((page, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    assert sorted(map(tuple, warc.round_trip(df).collect()), key=str) == sorted(want, key=str)
    assert warc.round_trip(df.limit(0)).count() == 0


def test_look_up_reads_only_what_is_asked_for(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 5)
    rows, df = pages(spark)
    archive = warc.write(df)
    assert warc.open_archive(archive.path) == archive
    keys = spark.createDataFrame([("http://h1.example.com/p/7?q=1",), ("http://x.org/",), ("http://absent.org/",), (None,)], "url string").select(warc.url_key(F.col("url")).alias("key"))
    got = warc.read(warc.look_up(keys, archive), archive).collect()
    want = [r for r in rows if r[1] in ("http://h1.example.com/p/7?q=1", "http://x.org/", None)]
    assert sorted(r["page"] for r in got) == sorted("" if r[0] is None else str(r[0]) for r in want)
    assert all(r["payload"] == dict((str(a), c or "") for a, _, c in rows)[r["page"]] for r in got if r["record_type"] == "response")


def test_records_are_gzip_members_of_warc(spark):
    data = warc.record("5", "http://a/", b"hello", "ab", None, "1970-01-01T00:00:00Z")
    head, http, payload = warc.parse(gzip.decompress(gzip.compress(data)))
    assert payload == b"hello" and head["WARC-Type"] == "response" and http["Content-Length"] == "5"
    assert data.startswith(b"WARC/1.1\r\n") and data.endswith(b"\r\n\r\n")


def test_string_ids_come_back(spark):
    page = "<p>" + "x" * 200
    rows = [("", "http://a/", page), ("b", "http://b/", page), (None, "http://c/", page), ("=", "http://d/", "")]
    got = warc.round_trip(spark.createDataFrame(rows, "page_id string, url string, html string")).select("page_id", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got), key=str) == sorted([("", "response", None), ("b", "revisit", ""), (None, "revisit", ""), ("=", "response", None)], key=str)
