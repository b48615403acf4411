"""Best-fit packing of tokenized documents into sequences, by bin completion on the histogram of lengths.

Only lengths matter to a packing, and there are at most `capacity` of them: the counts are summed in Spark, bin
completion runs on the driver over this bounded histogram, with patterns used many times at once, and the
plan of patterns goes back to the executors, which find each piece's place from its rank among pieces of its length."""

from __future__ import annotations

import bisect
import hashlib
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import PartCache, load, read_spec, splice
from .common import hash_words, materialize, slices, text_of

Pattern = tuple[tuple[int, int], ...]  # (length, copies), longest first

#: How the tokenizer's format splits a text of lower case into words, with Unicode's white space spelled out.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")


def words_of(part: str) -> list[str]:
    """The words of a part of a text: composed, lowered character by character, and split."""
    low = part.lower() if part.isascii() else "".join([c.lower() for c in unicodedata.normalize("NFC", part)])
    return [low] if low.isalpha() else WORDS.findall(low)


class WordEncoder:
    """Encodes texts part by part: the tokenizer drops white space between words and looks at nothing beyond it.

    Texts that hold a special token's name go to the tokenizers library as they are."""

    def __init__(self, spec: str):
        self.spec, self.library = spec, None
        v = load(spec)
        self.cache = PartCache(v, words_of)
        self.names = [s.lower().encode() for s in v.specials]

    def encode_text(self, text: str) -> np.ndarray:
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_str(self.spec)
            self.library.no_truncation()
            self.library.no_padding()
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of texts (UTF-8 bytes and offsets), and the n + 1 offsets of the texts' ids."""
        data = raw.tobytes()
        odd = np.zeros(len(offsets) - 1, bool)
        if b"<|" in data:
            for k in range(len(odd)):
                own = data[offsets[k] : offsets[k + 1]].lower()
                odd[k] = any(name in own for name in self.names)
        h, counts, starts, lengths = hash_words(raw, offsets)
        use = np.repeat(~odd, counts)
        h, starts, lengths = h[use], starts[use], lengths[use]
        flat, size = self.cache.lookup(h, lambda i: data[starts[i] : starts[i] + lengths[i]].decode())
        at = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(np.where(odd, 0, counts))])]
        return splice(flat, at, {int(k): self.encode_text(data[offsets[k] : offsets[k + 1]].decode()) for k in np.flatnonzero(odd)})


_encoders: dict[str, WordEncoder] = {}


def _encoder(spec: str) -> WordEncoder:
    """One encoder for each vocabulary and worker, kept between its tasks."""
    name = hashlib.sha256(spec.encode()).hexdigest()
    if name not in _encoders:
        _encoders[name] = WordEncoder(spec)
    return _encoders[name]


def tokenized_pieces(documents: DataFrame, path: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids and one end_id, cut only where it is longer than capacity."""
    spec = read_spec(documents.sparkSession, path)
    docs = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(spec.value)
        for batch in batches:
            raw, offsets = text_of(batch.column("text"))
            for i, j in slices(offsets):
                flat, at = encoder.encode(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                data, cuts = flat.astype("<u4").tobytes(), at.tolist()
                row, piece, start, length, crc = [], [], [], [], []
                for k in range(j - i):
                    n = cuts[k + 1] - cuts[k] + 1
                    for p, a in enumerate(range(0, n, capacity)):
                        b = min(a + capacity, n)
                        code = zlib.crc32(data[4 * (cuts[k] + a) : 4 * min(cuts[k] + b, cuts[k + 1])])
                        row.append(i + k)
                        piece.append(p)
                        start.append(a)
                        length.append(b - a)
                        crc.append(zlib.crc32(end, code) if b == n else code)
                longs = [pa.array(x, pa.int64()) for x in (start, length, crc)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *longs],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    kind = documents.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Best-fit decreasing on a histogram: patterns and how often each is used. The incumbent of bin completion."""
    open_bins: dict[int, list[tuple[Pattern, int]]] = {}
    rooms: list[int] = []  # sorted keys of open_bins

    def put(room: int, pattern: Pattern, times: int) -> None:
        if not times:
            return
        if room not in open_bins:
            bisect.insort(rooms, room)
            open_bins[room] = []
        open_bins[room].append((pattern, times))

    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                most = capacity // length
                put(capacity - most * length, ((length, most),), n // most)
                if n % most:
                    put(capacity - n % most * length, ((length, n % most),), 1)
                break
            room = rooms[at]
            pattern, times = open_bins[room].pop()
            if not open_bins[room]:
                del open_bins[room], rooms[at]
            each = min(room // length, n)
            used = min(times, n // each)
            put(room, pattern, times - used)
            put(room - each * length, (*pattern, (length, each)), used)
            n -= used * each
    return [x for room in rooms for x in open_bins[room]]


def _fillings(room: int, lengths: list[int], counts: dict[int, int], width: int, nodes: int) -> list[tuple[int, Pattern]]:
    """Undominated fillings of a room as (waste, pattern), least waste first, longest documents first among equals.

    A filling is dominated if one of its documents can be swapped for a longer one that is there and fits, or if
    another fits beside. The search keeps to a number of nodes; its first leaf is always a maximal filling."""
    found: list[tuple[int, Pattern]] = []
    left = nodes

    def descend(room: int, below: int, chosen: list[tuple[int, int]]) -> bool:
        """Whether the search may go on. lengths ascend; `below` bounds the index of the next length."""
        nonlocal left
        left -= 1
        i = bisect.bisect_right(lengths, room, 0, below) - 1
        if i < 0:
            kept = dict(chosen)
            spare = bisect.bisect_right(lengths, room)
            if spare and any(counts[f] > kept.get(f, 0) for f in (lengths[0], lengths[spare - 1])):
                return left > 0
            for f in kept:  # dominated by a swap of one document for a longer one
                k = bisect.bisect_right(lengths, f + room) - 1
                if lengths[k] > f and counts[lengths[k]] > kept.get(lengths[k], 0) and room:
                    return left > 0
            found.append((room, tuple(chosen)))
            return room > 0 and left > 0
        while i >= 0:
            f = lengths[i]
            for copies in range(min(counts[f], room // f), 0, -1):
                if not descend(room - copies * f, i, [*chosen, (f, copies)]):
                    return False
            i -= 1
            if left <= 0:
                return False
        return True

    descend(room, len(lengths), [])
    if not found:
        chosen, rest = [], room
        for f in reversed(lengths):
            if f <= rest:
                chosen.append((f, min(counts[f], rest // f)))
                rest -= f * chosen[-1][1]
        found.append((rest, tuple(chosen)))
    found.sort(key=lambda x: (x[0], tuple(-f for f, _ in x[1])))
    return found[:width]


def least_bins(counts: dict[int, int], capacity: int) -> int:
    """No packing has fewer bins: documents over half a bin stand alone, and all must fit by their sum."""
    large = sum(n for f, n in counts.items() if 2 * f > capacity)
    return max(large, -(-sum(f * n for f, n in counts.items()) // capacity))


def bin_completion(counts: dict[int, int], capacity: int, width: int = 3, nodes: int = 300, decisions: int = 20_000) -> list[tuple[Pattern, int]]:
    """Patterns and how often each is used; every document lies in one bin.

    Branch and bound: the largest document left is completed by undominated fillings, least waste first; a
    branch ends where its waste leaves it no better than the incumbent, which is best-fit decreasing at first
    and then each better packing found. The search stops at the lower bound of bins (least_bins); short of it, it is
    held to `width` fillings of a document, `nodes` steps for these and so many decisions, as bin packing is NP-hard:
    pack reports both numbers, so that what a search left open is seen."""
    counts = {f: n for f, n in counts.items() if n}
    if not counts:
        return []
    total = sum(f * n for f, n in counts.items())
    bound = least_bins(counts, capacity)
    incumbent = best_fit(counts, capacity)
    bins = sum(n for _, n in incumbent)
    lengths = sorted(counts)

    def use(pattern: Pattern, times: int) -> None:
        for f, n in pattern:
            counts[f] -= n * times
            if not counts[f]:
                del counts[f], lengths[bisect.bisect_left(lengths, f)]

    def undo(pattern: Pattern, times: int) -> None:
        for f, n in pattern:
            if f not in counts:
                bisect.insort(lengths, f)
                counts[f] = 0
            counts[f] += n * times

    stack: list[list] = []  # [options left, pattern, times, waste and bins before it]
    waste = used = 0
    forward = True
    while bins > bound and decisions > 0:
        decisions -= 1
        if forward and not lengths:
            if used < bins:
                incumbent, bins = [(s[1], s[2]) for s in stack], used
            forward = False
            continue
        if forward:
            top = lengths[-1]
            counts[top] -= 1
            gone = not counts[top]
            if gone:
                del counts[top]
                lengths.pop()
            options = [(w, _join(top, p)) for w, p in _fillings(capacity - top, lengths, counts, width, nodes)]
            if gone:
                lengths.append(top)
                counts[top] = 0
            counts[top] += 1
            stack.append([options, None, 0, waste, used])
        else:
            if not stack:
                break
            if stack[-1][1] is not None:
                undo(stack[-1][1], stack[-1][2])
                stack[-1][1] = None
        step = stack[-1]
        waste, used = step[3], step[4]
        while step[0]:
            lost, pattern = step[0].pop(0)
            times = min(counts[f] // n for f, n in pattern)
            # a packing of bins - 1 bins wastes (bins - 1) * capacity - total in all
            room = (bins - 1) * capacity - total - waste
            if lost * times > room:
                times = room // lost if lost and room > 0 else 0
            if times < 1:
                continue
            step[1], step[2] = pattern, times
            use(pattern, times)
            waste, used = waste + lost * times, used + times
            break
        forward = step[1] is not None
        if not forward:
            stack.pop()
    return incumbent


def _join(top: int, pattern: Pattern) -> Pattern:
    if pattern and pattern[0][0] == top:
        return ((top, pattern[0][1] + 1), *pattern[1:])
    return ((top, 1), *pattern)


def _plan(patterns: list[tuple[Pattern, int]]) -> dict[str, np.ndarray]:
    """Sorted by length and first rank: where pieces of these ranks go."""
    rank: dict[int, int] = {}
    rows, base = [], 0
    for pattern, times in patterns:
        offset = 0
        for length, copies in pattern:
            r = rank.get(length, 0)
            rows.append((length, r, base, copies, offset))
            rank[length] = r + copies * times
            offset += length * copies
        base += times
    rows.sort()
    columns = np.array(rows, np.int64).reshape(-1, 5).T
    return dict(zip(("length", "rank", "base", "copies", "offset"), columns, strict=True))


def pack(pieces: DataFrame, capacity: int = 4096, rows_per_group: int = 1_000_000) -> DataFrame:
    """Adds sequences, least_sequences, sequence_id and offset to pieces (doc_id, piece, start, length, ...); lengths of 1 to capacity.

    sequences is how many there are in all, least_sequences a bound that no packing is below: where they are equal the packing is the best there is.
    The driver sees the histogram only (at most `capacity` rows). A length that a third of all pieces share is dealt out
    by a salt for ranking. Repeated rows are placed one by one; an empty table gives no rows."""
    spark = pieces.sparkSession
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    patterns = bin_completion(counts, capacity)
    plan = spark.sparkContext.broadcast(_plan(patterns))
    used, least = sum(n for _, n in patterns), least_bins(counts, capacity)
    salts = max(64, sum(counts.values()) // rows_per_group)
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    ahead = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    groups = salted.groupBy("length", "salt").count().select("length", "salt", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = salted.withColumn("own", own).join(groups, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("own") - 1)
    kept = ranked.select(*pieces.columns, "rank")
    names = pieces.columns

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = plan.value
        wide = np.int64(1) << 48
        keys = p["length"] * wide + p["rank"]
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.searchsorted(keys, length * wide + rank, "right") - 1
            k = rank - p["rank"][at]
            sequence = p["base"][at] + k // p["copies"][at]
            offset = p["offset"][at] + k % p["copies"][at] * length
            both = (pa.array(np.full(len(rank), x, np.int64)) for x in (used, least))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *both, pa.array(sequence), pa.array(offset)], [*names, "sequences", "least_sequences", "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequences long, least_sequences long, sequence_id long, offset long"
    return kept.mapInArrow(place, schema)


def pack_documents(documents: DataFrame, path: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every document.

    Null and empty texts are one piece of the end id. The pieces, without their ids, are written once to the
    shared folder, so that texts are tokenized once."""
    return pack(materialize(tokenized_pieces(documents, path, capacity, end_id), "pieces"), capacity)
