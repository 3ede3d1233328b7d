"""Byte-level BPE with a two-tier lookup.

A text is split by a pattern; each match is encoded for itself. The first tier is a minimal perfect hash over the vocabulary:
hash, displace and compare. What it misses is merged pair by pair, lowest rank first and then leftmost, with a heap over linked
bytes. A worker remembers the ids of the words it met last, in two generations, so a word is looked up once and not once a
slice of rows. The tables are built once on the driver from the rank file and broadcast; they are as large as the vocabulary
and do not grow with the data.

Defined results: null counts as empty and gives no ids; any row gives one row, repeated ones too; texts of any length go
through in slices, so memory holds ``SLICE`` matches besides the row itself; columns besides id and text are not read.
"""

from __future__ import annotations

import base64
import heapq
import struct
import uuid
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLICE = 200_000
WORDS = 400_000  # words of a generation that a worker remembers; there are two
PAIRS = 300_000  # pairs of tokens that it remembers
LONGEST = 64  # longer words are not remembered
_PER_BUCKET = 2
_MIX = 0x9E3779B97F4A7C15
_WORD = (1 << 64) - 1


def read_ranks(path: str) -> list[bytes]:
    """Token bytes by rank; ranks are 0, 1, 2, ..."""
    with open(path, "rb") as f:
        ranked = sorted((int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, f))
    if [r for r, _ in ranked] != list(range(len(ranked))):
        raise ValueError("ranks must be consecutive from 0")
    return [t for _, t in ranked]


def _digests(keys: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), ">u8").astype(np.uint64).reshape(-1, 2)


def _slots(low: np.ndarray, shift: np.ndarray, n: int) -> np.ndarray:
    x = low + shift.astype(np.uint64) * np.uint64(_MIX)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    return (x % np.uint64(n)).astype(np.int64)


def perfect_hash(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """shift by bucket and key number by slot, with as many slots as keys. Large buckets are placed first, each
    with the first shift that sends its keys to free slots; a bucket of one key stores its slot as -1 - slot."""
    n = len(keys)
    buckets = max(1, n // _PER_BUCKET)
    digest = _digests(keys)
    home = (digest[:, 0] % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(home, kind="stable")
    starts = np.searchsorted(home[order], np.arange(buckets + 1))
    sizes = np.diff(starts)
    shift, slot_key, free = np.zeros(buckets, np.int64), np.full(n, -1, np.int64), np.ones(n, bool)
    tries = np.arange(1, 65, dtype=np.uint64)
    for b in np.argsort(-sizes, kind="stable"):
        own = order[starts[b] : starts[b + 1]]
        if len(own) < 2:
            break
        first = 0
        while True:
            at = _slots(digest[own, 1][None, :], (tries + np.uint64(first))[:, None], n)
            good = free[at].all(1)
            if len(own) > 1:
                ordered = np.sort(at, 1)
                good &= (ordered[:, 1:] != ordered[:, :-1]).all(1)
            if good.any():
                k = int(np.argmax(good))
                shift[b] = first + int(tries[k])
                free[at[k]] = False
                slot_key[at[k]] = own
                break
            first += len(tries)
    left = np.flatnonzero(free)
    single = np.flatnonzero(sizes == 1)
    shift[single] = -1 - left
    slot_key[left] = order[starts[single]]
    return shift, slot_key


class _Pairs(dict):
    """Rank of two tokens joined, by first << 20 | second; -1 where that is no token."""

    def __init__(self, codec: "Codec"):
        super().__init__()
        self.codec = codec

    def __missing__(self, key: int) -> int:
        if len(self) >= PAIRS:
            self.clear()
        tokens = self.codec.tokens
        found = self[key] = self.codec.rank(tokens[key >> 20] + tokens[key & 0xFFFFF])
        return found


class _Words(dict):
    """Ids of a word, as little-endian 32-bit integers. A full generation is kept as the old one, and what is used of it moves on."""

    def __init__(self, codec: "Codec"):
        super().__init__()
        self.codec, self.old = codec, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            ids = self.codec.packed(word.encode())
        if len(word) <= LONGEST:
            if len(self) >= WORDS:
                self.old = dict(self)
                self.clear()
            self[word] = ids
        return ids


class Codec:
    """Both tiers over one vocabulary."""

    def __init__(self, tokens: list[bytes], shift: np.ndarray, slot_key: np.ndarray, pattern: str):
        self.tokens, self.shift, self.slot_key = tokens, shift, slot_key
        self.pattern = regex.compile(pattern)
        self.shifts, self.slot_keys = shift.tolist(), slot_key.tolist()
        self.longest = max(map(len, tokens), default=0)
        self.single = [self.rank(bytes([b])) for b in range(256)] if tokens else []
        self.pairs, self.words = _Pairs(self), _Words(self)
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)
        self.sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.starts = np.cumsum(self.sizes) - self.sizes

    def whole(self, keys: list[bytes]) -> np.ndarray:
        """Rank of each key, -1 where it is not in the vocabulary."""
        if not keys or not self.tokens:
            return np.full(len(keys), -1, np.int64)
        digest = _digests(keys)
        shift = self.shift[(digest[:, 0] % np.uint64(len(self.shift))).astype(np.int64)]
        slot = np.where(shift < 0, -1 - shift, _slots(digest[:, 1], np.maximum(shift, 0), len(self.tokens)))
        found = self.slot_key[slot]
        tokens = self.tokens
        same = np.fromiter((tokens[i] == k for i, k in zip(found.tolist(), keys)), bool, len(keys))
        return np.where(same, found, -1)

    def rank(self, key: bytes) -> int:
        """``whole`` for one key, without arrays."""
        if len(key) > self.longest:
            return -1
        high, low = divmod(xxhash.xxh3_128_intdigest(key), 1 << 64)
        shift = self.shifts[high % len(self.shifts)]
        if shift < 0:
            slot = -1 - shift
        else:
            x = (low + shift * _MIX) & _WORD
            x = ((x ^ (x >> 31)) * 0xBF58476D1CE4E5B9) & _WORD
            slot = (x ^ (x >> 29)) % len(self.tokens)
        found = self.slot_keys[slot]
        return found if self.tokens[found] == key else -1

    def merged(self, piece: bytes) -> list[int]:
        """Pieces of linked bytes merged by a heap of rank and start, lowest rank and then leftmost first."""
        n, pairs = len(piece), self.pairs
        ids = [self.single[b] for b in piece]  # by start of a piece; -1 for one merged into the piece before it
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [r << 32 | i for i, (a, b) in enumerate(zip(ids, ids[1:])) if (r := pairs[a << 20 | b]) >= 0]
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            entry = pop(heap)
            a, r = entry & 0xFFFFFFFF, entry >> 32
            b = after[a]
            if ids[a] < 0 or b >= n or pairs[ids[a] << 20 | ids[b]] != r:
                continue  # one of the two was merged since
            ids[a], ids[b] = r, -1
            c = after[a] = after[b]
            if c < n:
                before[c] = a
                new = pairs[r << 20 | ids[c]]
                if new >= 0:
                    push(heap, new << 32 | a)
            d = before[a]
            if d >= 0:
                new = pairs[ids[d] << 20 | r]
                if new >= 0:
                    push(heap, new << 32 | d)
        return [i for i in ids if i >= 0]

    def packed(self, key: bytes) -> bytes:
        """Ids of a word that is not remembered: the first tier, then the second."""
        found = self.rank(key)
        if found >= 0:
            return found.to_bytes(4, "little")
        merged = self.merged(key)
        return struct.pack(f"<{len(merged)}I", *merged)

    def encoded(self, text: str) -> bytes:
        if len(text) <= SLICE:
            return b"".join(map(self.words.__getitem__, self.pattern.findall(text)))
        words, out = (m.group() for m in self.pattern.finditer(text)), []
        while part := list(islice(words, SLICE)):
            out.append(b"".join(map(self.words.__getitem__, part)))
        return b"".join(out)

    def decoded(self, ids: bytes) -> bytes:
        """The bytes of all tokens, gathered from one flat table, ``SLICE`` ids at a time."""
        out, every = [], np.frombuffer(ids, "<u4")
        for at in range(0, len(every), SLICE):
            part = every[at : at + SLICE]
            sizes = self.sizes[part]
            begin = np.cumsum(sizes) - sizes
            out.append(self.flat[np.arange(sizes.sum()) + np.repeat(self.starts[part] - begin, sizes)].tobytes())
        return b"".join(out)


_CODECS: dict[str, Codec] = {}


def _codec(name: str, shared) -> Codec:
    """Once per Python worker."""
    if name not in _CODECS:
        _CODECS.clear()
        _CODECS[name] = Codec(*shared.value)
    return _CODECS[name]


def _encode(codec: Codec, batches):
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            rows = [codec.encoded(t.as_py() or "") for t in part.column(1)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(r) // 4 for r in rows], pa.int64()), pa.array(rows, pa.binary())], ["id", "n_tokens", "ids"])


def _decode(codec: Codec, batches):
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            texts = [codec.decoded(x.as_py() or b"") for x in part.column(2)]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.binary())], ["id", "n_tokens", "ids", "bytes"])


class Bpe:
    """``encode``, ``decode`` and both at once over one rank file and splitting pattern. The file is read on the driver only."""

    def __init__(self, spark, path: str, pattern: str):
        tokens = read_ranks(path)
        shift, slot_key = perfect_hash(tokens)
        self.name = uuid.uuid4().hex
        self.shared = spark.sparkContext.broadcast((tokens, shift, slot_key, pattern))

    def _over(self, rows: DataFrame, step, id_col: str, more: str = "") -> DataFrame:
        name, shared = self.name, self.shared
        kind = rows.schema["id"].dataType.simpleString()
        out = rows.mapInArrow(lambda batches: step(_codec(name, shared), batches), f"id {kind}, n_tokens bigint, ids binary{more}")
        return out.withColumnRenamed("id", id_col)

    def encode(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """id, n_tokens, ids (little-endian 32-bit integers)."""
        return self._over(docs.select(docs[id_col].alias("id"), docs[text_col].alias("t")), _encode, id_col)

    def decode(self, encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
        """id, n_tokens, ids and the decoded bytes."""
        count = (F.octet_length(encoded[ids_col]) / 4).cast("long")
        rows = encoded.select(encoded[id_col].alias("id"), F.coalesce(count, F.lit(0)).alias("n_tokens"), encoded[ids_col].alias("ids"))
        return self._over(rows, _decode, id_col, ", bytes binary")

    def round_trip(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """What ``decode(encode(docs))`` gives, in one Python worker a task."""
        rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("t"))
        return self._over(rows, lambda codec, batches: _decode(codec, _encode(codec, batches)), id_col, ", bytes binary")
