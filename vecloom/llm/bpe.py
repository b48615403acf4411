"""Byte-level BPE in batched numpy merge rounds.

The distinct words of a slice of texts lie in one flat array of symbols. A round looks all neighbouring pairs up
by binary search over the sorted pair keys, takes each word's lowest rank, merges that pair at all its places and
drops the words that have no pair left. Words met before come from a bounded cache."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hash_words, slices, text_of

#: The split into words that the byte-level format fixes, with Unicode's white space spelled out.
WORDS = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
_NONE = np.int64(1 << 40)
#: Parts that a worker keeps the ids of; from a full cache go those that were not met again since they came.
CACHE = 800_000


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself, or the next free one from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    free = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(free)) for b in range(256)]


@dataclass(frozen=True)
class Vocabulary:
    """keys: sorted left << 32 | right; rank and merged belong to keys; piece holds each id's bytes.

    single and last are the ids of each byte within and at the end of a word, which differ where the format marks words' ends."""

    keys: np.ndarray
    rank: np.ndarray
    merged: np.ndarray
    single: np.ndarray
    last: np.ndarray
    piece_bytes: np.ndarray
    piece_start: np.ndarray
    specials: dict[str, int]


def load(spec: str) -> Vocabulary:
    """From the text of a tokenizers JSON file of the BPE kind over byte-level characters."""
    data = json.loads(spec)
    vocab = data["model"]["vocab"]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in data["model"]["merges"]]
    key = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
    merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
    order = np.argsort(key, kind="stable")
    alphabet = byte_alphabet()
    back = {c: b for b, c in enumerate(alphabet)}
    suffix = data["model"].get("end_of_word_suffix") or ""
    specials = {t["content"]: t["id"] for t in data["added_tokens"]}
    pieces = [b""] * (max([*vocab.values(), *specials.values()]) + 1)
    for token, i in vocab.items():
        pieces[i] = bytes(back[c] for c in (token.removesuffix(suffix) if suffix else token))
    for token, i in specials.items():
        pieces[i] = token.encode()
    start = np.concatenate([[0], np.cumsum([len(p) for p in pieces])]).astype(np.int64)
    single, last = (np.array([vocab[c + end] for c in alphabet], np.int64) for end in ("", suffix))
    return Vocabulary(key[order], order.astype(np.int64), merged[order], single, last, np.frombuffer(b"".join(pieces), np.uint8), start, specials)


def merge_rounds(v: Vocabulary, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all words (none of them empty), one after the other, and the n + 1 offsets of the words' ids."""
    lengths = np.array([len(w) for w in words], np.int64)
    raw = np.frombuffer(b"".join(words), np.uint8)
    symbol = v.single[raw]
    ends = np.cumsum(lengths) - 1
    symbol[ends] = v.last[raw[ends]]
    word = np.repeat(np.arange(len(words)), lengths)
    rank = np.full(len(symbol), _NONE)  # of the pair that begins at a symbol
    merged = np.zeros(len(symbol), np.int64)
    fresh = np.flatnonzero(word[:-1] == word[1:])  # pairs still to be looked up
    done: list[tuple[np.ndarray, np.ndarray]] = []
    while len(symbol):
        at = np.searchsorted(v.keys, symbol[fresh] << 32 | symbol[fresh + 1])
        at[at == len(v.keys)] = 0
        known = v.keys[at] == (symbol[fresh] << 32 | symbol[fresh + 1])
        rank[fresh] = np.where(known, v.rank[at], _NONE)
        merged[fresh] = v.merged[at]
        starts = np.flatnonzero(np.diff(word, prepend=-1))
        size = np.diff(starts, append=len(word))
        lowest = np.repeat(np.minimum.reduceat(rank, starts), size)
        over = lowest == _NONE
        if over.any():
            done.append((word[over], symbol[over]))
        chosen = (rank == lowest) & ~over
        place = np.flatnonzero(chosen)
        if (np.diff(place) == 1).any():  # as in "aaa": of touching places every second one, from the left
            run = np.flatnonzero(np.diff(place, prepend=-2) != 1)
            nth = np.arange(len(place)) - np.repeat(run, np.diff(run, append=len(place)))
            place = place[nth % 2 == 0]
        symbol[place] = merged[place]
        rank[place] = _NONE
        stale = np.zeros(len(symbol), bool)
        stale[place] = True
        stale[np.maximum(place - 1, 0)] = True
        # the symbol two places on now stands next; a pair that began at the one merged away goes with it
        keep = ~over
        keep[place + 1] = False
        symbol, word, rank, merged, stale = symbol[keep], word[keep], rank[keep], merged[keep], stale[keep]
        if len(symbol):
            rank[stale] = _NONE
            stale[-1] = False
            fresh = np.flatnonzero(stale[:-1] & (word[:-1] == word[1:])) if len(stale) > 1 else np.zeros(0, np.int64)
    if not done:
        return np.zeros(0, np.uint32), np.zeros(len(words) + 1, np.int64)
    word, symbol = (np.concatenate(c) for c in zip(*done, strict=True))
    order = np.argsort(word, kind="stable")
    return symbol[order].astype("<u4"), np.searchsorted(word[order], np.arange(len(words) + 1))


class PartCache:
    """Ids of parts of texts by the parts' hashes: sorted hashes, and where in one flat array each part's ids lie.

    words_of splits a part into the words that BPE merges within. The cache is bounded: from a full one go the parts
    that were not met again, and all if that leaves it over half full."""

    def __init__(self, v: Vocabulary, words_of):
        self.v, self.words_of = v, words_of
        self.keys, self.start = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.size, self.ids = np.zeros(0, np.int64), np.zeros(0, np.uint32)
        self.again = np.zeros(0, bool)

    def shrink(self) -> None:
        keep = self.again if self.again.sum() <= CACHE // 2 else np.zeros(len(self.keys), bool)
        self.ids = gather(self.ids, self.start[keep], self.size[keep])
        self.keys, self.size = self.keys[keep], self.size[keep]
        self.start = np.cumsum(self.size) - self.size
        self.again = np.zeros(len(self.keys), bool)

    def encode_parts(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of parts, and their n + 1 offsets."""
        words: dict[str, int] = {}
        count, order = [], []
        for part in parts:
            own = self.words_of(part)
            count.append(len(own))
            order.extend([words.setdefault(w, len(words)) for w in own])
        if not order:
            return np.zeros(0, np.uint32), np.zeros(len(parts) + 1, np.int64)
        ids, at = merge_rounds(self.v, [w.encode() for w in words])
        order = np.array(order)
        flat = gather(ids, at[order], np.diff(at)[order])
        return flat, np.concatenate([[0], np.cumsum(np.diff(at)[order])])[np.concatenate([[0], np.cumsum(count)])]

    def lookup(self, h: np.ndarray, part_at) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of parts with hashes h in order, and each part's number of ids; part_at(i) is the text of the i-th."""
        if len(self.keys) > CACHE:
            self.shrink()
        unique, first, back = np.unique(h, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, unique)
        new = np.ones(len(unique), bool)
        if len(self.keys):
            new = self.keys[np.minimum(at, len(self.keys) - 1)] != unique
            self.again[at[~new]] = True
        if new.any():
            ids, offsets = self.encode_parts([part_at(i) for i in first[new].tolist()])
            keys = np.concatenate([self.keys, unique[new]])
            order = np.argsort(keys, kind="stable")
            self.keys = keys[order]
            self.start = np.concatenate([self.start, offsets[:-1] + len(self.ids)])[order]
            self.size = np.concatenate([self.size, np.diff(offsets)])[order]
            self.again = np.concatenate([self.again, np.zeros(len(keys) - len(self.again), bool)])[order]
            self.ids = np.concatenate([self.ids, ids])
            at = np.searchsorted(self.keys, unique)
        at = at[back]
        return gather(self.ids, self.start[at], self.size[at]), self.size[at]


def gather(x: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """x[start : start + size] of all places, one after the other."""
    end = np.cumsum(size)
    return x[np.repeat(start - end + size, size) + np.arange(end[-1] if len(end) else 0)]


def spaced_words(part: str) -> list[str]:
    """The words of the byte-level format."""
    return [part] if part[1:].isalpha() and (part[0] == " " or part[0].isalpha()) else WORDS.findall(part)


_FIRST = np.uint64(0xA5A5_5A5A_0F0F_F0F1)
_IDENTITY = np.arange(256, dtype=np.uint8)
_ONLY_SPACE = np.arange(256) == 0x20
_ASCII_WHITE = np.isin(np.arange(256), [*range(0x09, 0x0E), *range(0x1C, 0x21)])


def crowded(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which texts have white space before a space, or a space at their end: only there does a word's border depend on what is left of a space."""
    out = np.zeros(len(offsets) - 1, bool)
    at = np.flatnonzero(raw == 0x20)
    if not len(at):
        return out
    b1, b2, b3 = (raw[np.maximum(at - k, 0)] for k in (1, 2, 3))
    white = _ASCII_WHITE[b1] | (b2 == 0xC2) & ((b1 == 0x85) | (b1 == 0xA0))
    white |= (b3 == 0xE1) & (b2 == 0x9A) & (b1 == 0x80) | (b3 == 0xE3) & (b2 == 0x80) & (b1 == 0x80) | (b3 == 0xE2) & (b2 == 0x81) & (b1 == 0x9F)
    white |= (b3 == 0xE2) & (b2 == 0x80) & ((b1 >= 0x80) & (b1 <= 0x8A) | (b1 == 0xA8) | (b1 == 0xA9) | (b1 == 0xAF))
    text = np.searchsorted(offsets, at, "right") - 1
    white &= at > offsets[text]
    out[text[white]] = True
    filled = np.flatnonzero(np.diff(offsets))
    out[filled[raw[offsets[filled + 1] - 1] == 0x20]] = True
    return out


class Encoder:
    """Encodes texts: the parts between spaces through a cache, texts whose spaces crowd and those with special tokens by the word pattern."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.cache = PartCache(vocabulary, spaced_words)
        self.names = [s.encode() for s in vocabulary.specials]
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(vocabulary.specials, key=len, reverse=True))) + ")") if self.names else None

    def encode_text(self, text: str) -> np.ndarray:
        """One text by the format's rules, without the cache."""
        out = []
        for k, part in enumerate(self.special.split(text) if self.special else [text]):
            if k % 2:
                out.append(np.array([self.v.specials[part]], np.uint32))
            elif part:
                words = WORDS.findall(part)
                distinct = {w: i for i, w in enumerate(dict.fromkeys(words))}
                ids, at = merge_rounds(self.v, [w.encode() for w in distinct])
                order = np.array([distinct[w] for w in words])
                out.append(gather(ids, at[order], np.diff(at)[order]))
        return np.concatenate(out).astype("<u4") if out else np.zeros(0, "<u4")

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of texts (UTF-8 bytes and offsets), and the n + 1 offsets of the texts' ids."""
        odd = crowded(raw, offsets)
        data = raw.tobytes()
        if any(name in data for name in self.names):
            for k in range(len(odd)):
                odd[k] |= any(name in data[offsets[k] : offsets[k + 1]] for name in self.names)
        h, counts, starts, lengths = hash_words(raw, offsets, _IDENTITY, _ONLY_SPACE)
        leads = np.isin(starts, offsets[:-1])
        h = np.where(leads, h ^ _FIRST, h)
        use = np.repeat(~odd, counts)
        h, starts, lengths, leads = h[use], starts[use], lengths[use], leads[use]
        part_at = lambda i: ("" if leads[i] else " ") + data[starts[i] : starts[i] + lengths[i]].decode()
        flat, size = self.cache.lookup(h, part_at)
        n = np.where(odd, 0, counts)
        at = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(n)])]
        return splice(flat, at, {int(k): self.encode_text(data[offsets[k] : offsets[k + 1]].decode()) for k in np.flatnonzero(odd)})


def splice(flat: np.ndarray, at: np.ndarray, others: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of texts (flat, offsets at) with those of other texts put in at their places."""
    if not others:
        return flat, at
    texts = [others.get(k, flat[a:b]) for k, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True))]
    return np.concatenate(texts), np.concatenate([[0], np.cumsum([len(t) for t in texts])])


def decode_ids(v: Vocabulary, flat: np.ndarray, at: np.ndarray) -> list[str]:
    """The text of each row of ids (flat, offsets at): the pieces' bytes in order, read as UTF-8."""
    flat = flat.astype(np.int64)
    size = v.piece_start[flat + 1] - v.piece_start[flat]
    data = gather(v.piece_bytes, v.piece_start[flat], size).tobytes()
    cuts = np.concatenate([[0], np.cumsum(size)])[at].tolist()
    return [data[a:b].decode("utf-8", "replace") for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


_encoders: dict[str, Encoder] = {}


def _encoder(spec: str) -> Encoder:
    """One encoder for each vocabulary and worker, kept between its tasks."""
    name = hashlib.sha256(spec.encode()).hexdigest()
    if name not in _encoders:
        _encoders[name] = Encoder(load(spec))
    return _encoders[name]


def read_spec(spark: SparkSession, path: str):
    """The tokenizer file's text, read once on the driver (it is of a fixed size) and broadcast."""
    with open(path, encoding="utf-8") as file:
        return spark.sparkContext.broadcast(file.read())


def _each(documents: DataFrame, path: str, schema: str, rows) -> DataFrame:
    """rows(encoder, raw, offsets) gives columns; they follow doc_id."""
    spec = read_spec(documents.sparkSession, path)
    docs = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(spec.value)
        for batch in batches:
            raw, offsets = text_of(batch.column("text"))
            for i, j in slices(offsets):
                columns = rows(encoder, raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), *columns.values()], ["doc_id", *columns])

    return docs.mapInArrow(run, f"doc_id {kind}, {schema}")


def encode(documents: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array<int>) of every whole text; null texts count as empty and have no ids.

    Strings of special tokens in a text become their ids, as the tokenizers library does by default. No shuffle;
    repeated rows are kept, only doc_id is carried."""

    def rows(encoder: Encoder, raw: np.ndarray, offsets: np.ndarray) -> dict[str, pa.Array]:
        flat, at = encoder.encode(raw, offsets)
        return {"ids": pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(flat.astype(np.int32)))}

    return _each(documents, path, "ids array<int>", rows)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text of rows of ids (null ids: empty text); ids outside the vocabulary fail."""
    spec = read_spec(encoded.sparkSession, path)
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _encoder(spec.value).v
        for batch in batches:
            ids = [np.array(x or [], np.int64) for x in batch.column("ids").to_pylist()]
            at = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64)
            texts = decode_ids(v, np.concatenate(ids), at) if ids else []
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")


def round_trip(documents: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encodes every text, decodes its ids, and digests both."""

    def rows(encoder: Encoder, raw: np.ndarray, offsets: np.ndarray) -> dict[str, pa.Array]:
        flat, at = encoder.encode(raw, offsets)
        data, cuts = flat.astype("<u4").tobytes(), (4 * at).tolist()
        return {
            "n_tokens": pa.array(np.diff(at)),
            "ids_sha256": pa.array([hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]),
            "decoded_sha256": pa.array([hashlib.sha256(t.encode()).hexdigest() for t in decode_ids(encoder.v, flat, at)]),
        }

    return _each(documents, path, "n_tokens long, ids_sha256 string, decoded_sha256 string", rows)
