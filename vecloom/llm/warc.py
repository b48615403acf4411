"""WARC archives with a two-level capture index.

Archives: one gzip member for each record, so that a record can be read by its range. Index: captures sorted
by reversed-host URL key are cut into compressed blocks; each index shard has a sparse directory of its blocks'
first keys, and the master directory has the shards' first keys. A look-up finds the shard, then the block, by
binary search, reads the block's range, and then the records' ranges."""

from __future__ import annotations

import bisect
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HOT, filesystem, join_dealt, materialize, put_file, shared_path
from .url_filter import host_and_path

BLOCK_LINES = 3000
FILE_BYTES = 256 << 20
#: Payloads below this size are never revisits.
LEAST_REVISIT = 100


def url_key(url: Column) -> Column:
    """The host's labels reversed, `)`, then path and query; empty for null and for urls without `://`. Control characters are escaped."""
    host, _ = host_and_path(url)
    rest = F.coalesce(F.regexp_extract(url, r"^.*?://[^/?#]*([^#]*)", 1), F.lit(""))
    key = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest)
    for char, code in (("\t", "%09"), ("\n", "%0A"), ("\r", "%0D")):
        key = F.replace(key, F.lit(char), F.lit(code))
    return F.coalesce(key, F.lit(")"))


def _header(lines: list[tuple[str, str]]) -> bytes:
    clean = ((k, v.replace("\r", "%0D").replace("\n", "%0A")) for k, v in lines)
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in clean).encode() + b"\r\n"


def record(page: str, url: str | None, payload: bytes, digest: str, refers_to: str | None, date: str) -> bytes:
    """A response with its payload, or a revisit with the headers only, which keep the payload's length."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:page:{page}>"),
        ("WARC-Date", date),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if url is not None:
        lines.append(("WARC-Target-URI", url))
    if refers_to is not None:
        lines.append(("WARC-Refers-To", f"<urn:page:{refers_to}>"))
        lines.append(("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
    return _header(lines) + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    split = lambda raw: dict(line.split(": ", 1) for line in raw.decode().split("\r\n")[1:])
    warc = split(head)
    http, _, payload = rest[: int(warc["Content-Length"])].partition(b"\r\n\r\n")
    return warc, split(http), payload


@dataclass(frozen=True)
class Archive:
    """Where archives and index lie, and the master directory: each shard's first key, in order."""

    path: str
    first_keys: tuple[str, ...]
    shards: tuple[str, ...]


def plan_records(pages: DataFrame) -> DataFrame:
    """page_id, url, html, digest, refers_to, key: of equal payloads of LEAST_REVISIT bytes or more the smallest page_id's is the response.

    Rows that repeat the response's page_id are responses, too; a null page_id revisits unless its payload has no other.
    Small payloads look for no other; a payload that very many pages share is dealt out."""
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", payload.alias("html"), F.sha2(payload, 256).alias("digest"), F.octet_length(payload).alias("n"))
    shared = rows.where(F.col("n") >= LEAST_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    shared = materialize(shared.withColumnRenamed("digest", "same"), "shared-payloads")
    crowd = shared.where(F.col("copies") > (shared.agg(F.sum("copies")).first()[0] or 0) * HOT)
    alone = F.concat(F.lit("-"), F.xxhash64("page_id", "url").cast("string"))
    rows = rows.withColumn("same", F.when(F.col("n") >= LEAST_REVISIT, F.col("digest")).otherwise(alone))
    joined = join_dealt(rows, shared.select("same", "first"), ["same"], crowd, "left")
    revisits = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    return joined.select("page_id", "url", "html", "digest", F.when(revisits, F.col("first")).alias("refers_to"), url_key(F.col("url")).alias("key"))


def write(pages: DataFrame, path: str | None = None, date: str = "1970-01-01T00:00:00Z", level: int = 4) -> Archive:
    """Write every row of pages (page_id, url, html) as a record, then the index of the captures.

    A task attempt writes files of its own names, so that a repeated attempt leaves the first one's entries valid."""
    spark = pages.sparkSession
    path = path or shared_path(spark, "warc")

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, stream, size = "", None, FILE_BYTES
        try:
            for batch in batches:
                rows = []
                for row in batch.to_pylist():
                    if size >= FILE_BYTES:
                        if stream:
                            stream.close()
                        name = f"{uuid.uuid4().hex}.warc.gz"
                        store, file = filesystem(f"{path}/{name}")
                        store.create_dir(file.rpartition("/")[0], recursive=True)
                        stream, size = store.open_output_stream(file, compression=None), 0
                    gz = zlib.compressobj(level, wbits=31)
                    page = "" if row["page"] is None else row["page"]
                    data = gz.compress(record(page, row["url"], row["html"].encode(), row["digest"], row["refers_to"], date)) + gz.flush()
                    stream.write(data)
                    rows.append({"key": row["key"], "page": page, "file": name, "offset": size, "length": len(data)})
                    size += len(data)
                yield pa.RecordBatch.from_pylist(rows, pa.schema([("key", pa.string()), ("page", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]))
        finally:
            if stream:
                stream.close()

    planned = plan_records(pages)
    text = planned.select(F.col("page_id").cast("string").alias("page"), "url", "html", "digest", F.col("refers_to").cast("string").alias("refers_to"), "key")
    captures = materialize(text.mapInArrow(archive, "key string, page string, file string, offset long, length long"), "captures")

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, first, directory, lines, blocks = uuid.uuid4().hex, None, [], [], []
        size = 0

        def close_block():
            nonlocal size
            data = zlib.compress("\n".join(lines).encode(), 6)
            directory.append(f"{lines[0].split(chr(9), 1)[0]}\t{size}\t{len(data)}")
            size += len(data)
            lines.clear()
            return data

        def chunks():
            nonlocal first
            for batch in batches:
                for r in batch.to_pylist():
                    first = r["key"] if first is None else first
                    lines.append(f"{r['key']}\t{r['page']}\t{r['file']}\t{r['offset']}\t{r['length']}")
                    if len(lines) == BLOCK_LINES:
                        yield close_block()
            if lines:
                yield close_block()

        put_file(f"{path}/{name}.blocks", chunks())
        if first is not None:
            put_file(f"{path}/{name}.directory", [zlib.compress("\n".join(directory).encode(), 6)])
            yield pa.RecordBatch.from_pylist([{"first": first, "shard": name}])

    parts = max(1, min(spark.sparkContext.defaultParallelism * 64, captures.count() // (20 * BLOCK_LINES) + 1))
    ordered = captures.repartitionByRange(parts, "key", "page", "file", "offset").sortWithinPartitions("key", "page", "file", "offset")
    shards = sorted((r["first"].encode(), r["shard"]) for r in ordered.mapInArrow(index, "first string, shard string").collect())  # at most `parts` rows
    return Archive(path, tuple(k.decode() for k, _ in shards), tuple(s for _, s in shards))


def look_up(keys: DataFrame, archive: Archive) -> DataFrame:
    """key, page, file, offset, length of every capture of the wanted keys (column key; repeated ones count once).

    Keys are dealt out by index shard and sorted, so that a task searches one directory at a time and reads a block once."""
    firsts = [k.encode() for k in archive.first_keys]
    path, shards = archive.path, archive.shards

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {"key": [], "shard": []}
            for key in batch.column("key").to_pylist():
                if key is None or not firsts:
                    continue
                raw = key.encode()
                # a key may begin at the end of the shard before the first one that starts with it
                for s in range(max(bisect.bisect_left(firsts, raw) - 1, 0), bisect.bisect_right(firsts, raw)):
                    out["key"].append(key)
                    out["shard"].append(s)
            yield pa.RecordBatch.from_pydict(out, pa.schema([("key", pa.string()), ("shard", pa.int32())]))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, begins, entries, source, held = None, [], [], None, {}
        for batch in batches:
            rows = []
            for key, s in zip(batch.column("key").to_pylist(), batch.column("shard").to_pylist(), strict=True):
                if s != now:
                    store, file = filesystem(f"{path}/{shards[s]}.directory")
                    with store.open_input_stream(file, compression=None) as f:
                        lines = zlib.decompress(f.read()).decode().split("\n")
                    entries = [(k.encode(), int(o), int(n)) for k, o, n in (x.split("\t") for x in lines)]
                    begins = [e[0] for e in entries]
                    store, file = filesystem(f"{path}/{shards[s]}.blocks")
                    source, held, now = store.open_input_file(file), {}, s
                raw = key.encode()
                for b in range(max(bisect.bisect_left(begins, raw) - 1, 0), bisect.bisect_right(begins, raw)):
                    if b not in held:
                        source.seek(entries[b][1])
                        lines = [x.split("\t") for x in zlib.decompress(source.read(entries[b][2])).decode().split("\n")]
                        held = {b: ([x[0].encode() for x in lines], lines)}  # keys come in order: one block at a time
                    names, lines = held[b]
                    for x in lines[bisect.bisect_left(names, raw) : bisect.bisect_right(names, raw)]:
                        rows.append({"key": x[0], "page": x[1], "file": x[2], "offset": int(x[3]), "length": int(x[4])})
                    if len(rows) >= 50_000:
                        yield pa.RecordBatch.from_pylist(rows)
                        rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows)

    wanted = keys.select("key").distinct().mapInArrow(route, "key string, shard int")
    dealt = wanted.repartitionByRange("shard", "key").sortWithinPartitions("shard", "key")
    return dealt.mapInArrow(search, "key string, page string, file string, offset long, length long")


def read(captures: DataFrame, archive: Archive) -> DataFrame:
    """page, url, payload_bytes, payload_digest, record_type, refers_to, payload (null for revisits) of captures, by range reads in file order."""
    path = archive.path

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, source = None, None
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if r["file"] != now:
                    if source:
                        source.close()
                    store, file = filesystem(f"{path}/{r['file']}")
                    now, source = r["file"], store.open_input_file(file)
                source.seek(r["offset"])
                warc, http, payload = parse(zlib.decompress(source.read(r["length"]), wbits=31))
                whole = warc["WARC-Type"] == "response"
                refers = warc.get("WARC-Refers-To")
                rows.append({
                    "page": warc["WARC-Record-ID"][10:-1], "url": warc.get("WARC-Target-URI"),
                    "payload_bytes": len(payload) if whole else int(http["Content-Length"]),
                    "payload_digest": hashlib.sha256(payload).hexdigest() if whole else warc["WARC-Payload-Digest"].removeprefix("sha256:"),
                    "record_type": warc["WARC-Type"], "refers_to": refers[10:-1] if refers else None,
                    "payload": payload.decode("utf-8", "replace") if whole else None,
                })
                if sum(x["payload_bytes"] for x in rows[-64:]) > 4 << 20 or len(rows) >= 2000:
                    yield pa.RecordBatch.from_pylist(rows, _RECORD)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, _RECORD)

    ordered = captures.repartitionByRange("file", "offset").sortWithinPartitions("file", "offset")
    return ordered.mapInArrow(run, "page string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string, payload string")


_RECORD = pa.schema([
    ("page", pa.string()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
    ("record_type", pa.string()), ("refers_to", pa.string()), ("payload", pa.string()),
])


def round_trip(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to for every row of pages: written, looked up by url key, read back.

    Null html is an empty payload, null urls share the empty key; repeated rows have a record each; other columns are
    not carried. A null page_id comes back as null, an empty one as empty."""
    kind = pages.schema["page_id"].dataType
    text = kind.simpleString() == "string"
    archive = write(pages.withColumn("page_id", F.concat(F.lit("="), "page_id")) if text else pages)
    captures = look_up(pages.select(url_key(F.col("url")).alias("key")), archive)
    back = lambda c: F.when(F.col(c) != "", F.substring(c, 2, 1 << 30) if text else F.col(c)).cast(kind)
    return read(captures, archive).select(back("page").alias("page_id"), "payload_bytes", "payload_digest", "record_type", back("refers_to").alias("refers_to"))


def open_archive(path: str) -> Archive:
    """The archive that was written to path; the master directory is read from the shards' directories (one line of each)."""
    from pyarrow import fs

    store, folder = filesystem(path)
    found = []
    for info in store.get_file_info(fs.FileSelector(folder)):
        if info.path.endswith(".directory"):
            with store.open_input_stream(info.path, compression=None) as f:
                found.append((zlib.decompress(f.read()).split(b"\t", 1)[0], info.base_name.removesuffix(".directory")))
    found.sort()
    return Archive(path, tuple(k.decode() for k, _ in found), tuple(s for _, s in found))
