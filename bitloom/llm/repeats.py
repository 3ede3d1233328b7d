"""Long repeats between and within documents, by a run-length index.

A byte goes if a string of ``length`` bytes that covers it also starts anywhere else. Matches never cross documents.

1. Anchors. Each window of ``length`` bytes is named by the smallest hash among its grams of ``GRAM`` bytes. Equal windows have
   equal anchors at equal places, and neighbouring windows share theirs, so a document becomes ranges of windows, about one in
   ``length`` / 2 bytes: (anchor, hash of the range's bytes, place).
2. Ranges whose anchor occurs once hold no repeat. If all ranges of an anchor are equal, all their windows are repeats. What is
   left, ranges with one anchor and different bytes, is where repeats begin and end: one copy of each is indexed.
3. Index. The bytes of such ranges are dealt by anchor, so equal windows meet in one task, which puts bounded pieces together: the
   suffixes in order, the Burrows-Wheeler transform in runs of equal characters, and the suffix at the first and the last row of
   each run. Only there is a suffix compared with its neighbour; the matching statistics of all other positions stream from these
   samples, since a match that begins inside a run is one shorter than the match before it. Positions whose longest match
   with another position is ``length`` or more are marked.
4. An anchor with more than ``HOT_BYTES`` of different ranges does not go to one task: its windows are counted by a 128-bit hash,
   with partial sums before the shuffle.

Equality of ranges and documents rests on 64-bit hashes within one 64-bit anchor, and of windows of hot anchors on 128 bits.

Defined results: a null text counts as empty; repeated rows are copies of each other, so all their bytes go if there are
``length``; shorter texts keep all; an empty table gives an empty table; a null id is allowed; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

LENGTH = 200
GRAM = 32
CHUNK = 1 << 20  # bytes hashed at once; a place in a chunk takes as many bits of a key
INDEX_BYTES = 4 << 20  # of one index
HOT_BYTES = 2 << 20
SEPARATOR = 256

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_UNBASE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_PLACE = _U(CHUNK - 1)
_POWERS: dict[str, np.ndarray] = {}


def _powers(name: str, base: np.uint64) -> np.ndarray:
    if name not in _POWERS:
        out = np.full(CHUNK + 1, base, _U)
        out[0] = 1
        _POWERS[name] = np.cumprod(out, dtype=_U)
    return _POWERS[name]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _window_min(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` keys."""
    n = len(keys) - width + 1
    pad = -len(keys) % width
    rows = np.concatenate([keys, np.full(pad, ~_U(0))]).reshape(-1, width)
    ahead = np.minimum.accumulate(rows, 1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def window_ranges(data: bytes, starts: np.ndarray, length: int):
    """data: documents one after another, at most CHUNK bytes; starts: where each begins, and the end. Gives of each range:
    document, first window in it, windows, anchor, hash of its bytes."""
    empty = np.empty(0, np.int64)
    if len(data) < length:
        return empty, empty, empty, empty, empty
    n = len(data) - 7
    word = _mix(np.ndarray(n, "<u8", data, 0, (1,)).astype(_U))
    grams = np.zeros(len(data) - GRAM + 1, _U)
    for i in range(0, GRAM, 8):
        grams = grams * _BASE + word[i : i + len(grams)]
    grams = _mix(grams)
    place = np.arange(len(grams), dtype=_U)
    best = (_window_min((grams & ~_PLACE) | place, length - GRAM + 1) & _PLACE).astype(np.int64)

    sizes = np.diff(starts)
    doc = np.repeat(np.arange(len(sizes)), sizes)[: len(best)]
    windows = np.arange(len(best))
    inside = windows + length <= starts[doc + 1]
    cut = np.ones(len(best), bool)
    cut[1:] = (best[1:] != best[:-1]) | (doc[1:] != doc[:-1]) | ~inside[:-1]
    first = windows[inside & cut]
    # a range ends before the next one begins, or where its document has no further window
    last = np.minimum(np.append(first[1:], len(best)) - 1, starts[doc[first] + 1] - length)

    sums = np.concatenate([np.zeros(1, _U), np.cumsum(word * _powers("up", _BASE)[:n], dtype=_U)])
    count = last - first + 1
    # the words that begin in the range's bytes; the last 7 bytes are covered by the words before them
    body = (sums[last + length - 7] - sums[first]) * _powers("down", _UNBASE)[first]
    body = _mix(body + count.astype(_U) * _U(0xD6E8FEB86659FD93))
    return doc[first], first - starts[doc[first]], count, grams[best[first]].view(np.int64), body.view(np.int64)


def _chunks(texts: list[bytes], length: int):
    """(documents, their offsets, bytes, starts) with at most CHUNK bytes; a longer document is cut so that each window is in one."""
    held, size = [], 0
    for k, text in enumerate(texts):
        if len(text) < length:
            continue
        if len(text) > CHUNK:
            step = CHUNK - length + 1
            for at in range(0, len(text) - length + 1, step):
                part = text[at : at + CHUNK]
                yield [k], [at], part, np.array([0, len(part)])
            continue
        if size + len(text) > CHUNK:
            yield [h for h, _ in held], [0] * len(held), b"".join(t for _, t in held), np.cumsum([0, *(len(t) for _, t in held)])
            held, size = [], 0
        held.append((k, text))
        size += len(text)
    if held:
        yield [h for h, _ in held], [0] * len(held), b"".join(t for _, t in held), np.cumsum([0, *(len(t) for _, t in held)])


def _bytes_of(column) -> list[bytes]:
    return [x.as_py() or b"" for x in column]


def _ranges(length: int):
    def run(batches):
        for batch in batches:
            uid = batch.column(0).to_numpy()
            for docs, offsets, data, starts in _chunks(_bytes_of(batch.column(1)), length):
                doc, at, count, anchor, body = window_ranges(data, starts, length)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(uid[np.array(docs)[doc]]), pa.array(at + np.array(offsets)[doc]), pa.array(count.astype(np.int32)), pa.array(anchor), pa.array(body)],
                    ["uid", "at", "windows", "anchor", "body"],
                )

    return run


def suffix_order(text: np.ndarray, piece: np.ndarray, depth: int) -> np.ndarray:
    """Positions of text in the order of their suffixes, by prefix doubling. Pieces end with SEPARATOR, which sorts before all
    bytes and, between pieces, by the piece; so no two suffixes are equal and none is longer than ``depth``."""
    n, step, place = len(text), 5, 18
    padded = np.concatenate([np.where(text == SEPARATOR, 0, text + 1).astype(_U), np.zeros(step, _U)])
    key, ended = np.zeros(n, _U), np.zeros(n, bool)
    for i in range(step):  # nine bits a character; nothing counts after the end of a piece
        char = padded[i : i + n]
        key = (key << _U(9)) | np.where(ended, _U(0), char)
        ended |= char == 0
    key = (key << _U(place)) | np.where(ended, piece, 0).astype(_U)
    while True:
        order = np.argsort(key)
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], ordered[1:] != ordered[:-1]]))
        if step >= depth or rank[order[-1]] == n - 1:
            return order
        then = np.concatenate([rank[step:], np.zeros(min(step, n), np.int64)])[:n]
        key = rank.astype(_U) * _U(n) + then.astype(_U)
        step *= 2


def common_prefix(text: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Length of the common prefix of the suffixes at a and b, at most ``most``, four characters at a time."""
    data = np.concatenate([text, np.arange(most + 8).astype(text.dtype)]).tobytes()
    words = np.ndarray(len(text) + most + 4, "<u8", data, 0, (2,))
    out = np.full(len(a), most, np.int64)
    alike = np.arange(len(a))
    for at in range(0, most, 4):
        differ = words[a[alike] + at] ^ words[b[alike] + at]
        ends = differ != 0
        low = differ[ends] & (~differ[ends] + _U(1))
        out[alike[ends]] = at + (np.log2(low.astype(np.float64)).astype(np.int64) >> 4)
        alike = alike[~ends]
        if not len(alike):
            break
    return np.minimum(out, most)


def matching_statistics(pieces: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Of all pieces, one after another and each with its separator: for each position the length of the longest prefix of its suffix
    that also begins elsewhere (at most to the end of its piece); where the pieces begin; the number of runs of the transform.
    depth: at least the length of the longest piece."""
    sizes = np.array([len(x) + 1 for x in pieces])
    starts = np.concatenate([[0], np.cumsum(sizes)])
    text = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8).astype(np.uint16)
    text[starts[1:] - 1] = SEPARATOR
    piece = np.repeat(np.arange(len(pieces)), sizes)
    n = len(text)
    order = suffix_order(text, piece, depth + 1)
    before = text[order - 1]  # the transform
    # separators differ from each other
    head = np.concatenate([[True], (before[1:] != before[:-1]) | (before[1:] == SEPARATOR)])
    tail = np.append(head[1:], True)
    place = np.arange(n)
    out = np.zeros(n, np.int64)
    # the first row of a run is compared with the row above, the last with the row below
    for rows, other in ((np.flatnonzero(head), -1), (np.flatnonzero(tail), 1)):
        at = order[rows]
        beside = rows + other
        real = (beside >= 0) & (beside < n)
        known, sample = np.zeros(n, bool), np.zeros(n, np.int64)
        known[at] = True
        sample[at[real]] = common_prefix(text, at[real], order[beside[real]], depth)
        last = np.maximum.accumulate(np.where(known, place, 0))
        np.maximum(out, sample[last] - (place - last), out=out)
    return np.minimum(out, starts[piece + 1] - 1 - place), starts, int(head.sum())


def runs_of(marked: np.ndarray) -> list[tuple[int, int]]:
    """Begin and end of each run of True."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], marked.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


MARKS = "array<struct<b:int,e:int>>"


def _pieces(length: int):
    """The bytes of the wanted ranges of each document."""

    def run(batches):
        for batch in batches:
            for text, wanted in zip(batch.column(2), batch.column(3)):
                text, wanted = text.as_py() or b"", wanted.as_py()
                data = [text[w["at"] : w["at"] + w["windows"] + length - 1] for w in wanted]
                yield pa.RecordBatch.from_arrays([pa.array([w[k] for w in wanted], pa.int64()) for k in ("anchor", "body")] + [pa.array(data, pa.binary())], ["anchor", "body", "data"])

    return run


def _marked(length: int):
    """Rows sorted by anchor and body, one index for each INDEX_BYTES of whole anchors."""

    def run(batches):
        keys, pieces, held, depth = [], [], 0, 2 * length - GRAM

        def marks():
            stats, starts, _ = matching_statistics(pieces, depth)
            found = [runs_of(stats[b : e - 1] >= length) for b, e in zip(starts, starts[1:])]
            rows = [(k, m) for k, m in zip(keys, found) if m]
            keys.clear()
            pieces.clear()
            made = pa.array([[{"b": b, "e": e} for b, e in m] for _, m in rows], pa.list_(pa.struct([("b", pa.int32()), ("e", pa.int32())])))
            return pa.RecordBatch.from_arrays([pa.array([k[i] for k, _ in rows], pa.int64()) for i in (0, 1)] + [made], ["anchor", "body", "marks"])

        for batch in batches:
            for a, b, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if keys and keys[-1] == (a, b):
                    continue  # of a repeated row
                if held >= INDEX_BYTES and keys[-1][0] != a:
                    yield marks()
                    held = 0
                keys.append((a, b))
                pieces.append(x.as_py())
                held += len(pieces[-1])
        if pieces:
            yield marks()

    return run


def _windows(length: int):
    def run(batches):
        for batch in batches:
            for a, b, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                x = x.as_py()
                n = len(x) - length + 1
                h = np.frombuffer(b"".join(xxhash.xxh3_128_digest(x[i : i + length]) for i in range(n)), "<i8").reshape(n, 2)
                yield pa.RecordBatch.from_arrays([pa.array([a] * n, pa.int64()), pa.array([b] * n, pa.int64()), pa.array(np.arange(n, dtype=np.int32)), pa.array(h[:, 0]), pa.array(h[:, 1])], ["anchor", "body", "i", "h1", "h2"])

    return run


def _kept(length: int):
    def run(batches):
        for batch in batches:
            size, gone, spans, digest = [], [], [], []
            for text, marks in zip(batch.column(2), batch.column(3)):
                text = text.as_py() or b""
                hasher, at, runs = hashlib.sha256(), 0, 0
                removed, end = 0, -1
                for m in sorted((m["b"], m["e"]) for m in marks.as_py() or []):
                    b, e = m[0], m[1] - 1 + length
                    if b > end:
                        runs += 1
                        hasher.update(text[at:b])
                        removed += e - b
                    else:
                        removed += max(0, e - end)
                    end = at = max(end, e)
                hasher.update(text[at:])
                size.append(len(text))
                gone.append(removed)
                spans.append(runs)
                digest.append(hasher.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, pa.int64()) for x in (size, gone, spans)], pa.array(digest, pa.string())], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return run


def repeated_ranges(texts: DataFrame, length: int) -> DataFrame:
    """texts: id, uid, t (binary). Gives uid, b, e: windows b to e - 1 of the document are repeats."""
    found = stored(texts.select("uid", "t").mapInArrow(_ranges(length), "uid bigint, at bigint, windows int, anchor bigint, body bigint"), "ranges")
    shared = found.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.min("body").alias("lo"), F.max("body").alias("hi")).filter("n > 1")
    shared = stored(found.join(shared.select("anchor", (F.col("lo") == F.col("hi")).alias("whole")), "anchor"), "shared")

    edges = shared.filter("not whole")
    copy = F.min(F.struct("uid", "at", "windows"))
    classes = stored(edges.groupBy("anchor", "body").agg(F.count(F.lit(1)).alias("n"), copy.alias("copy")).select("anchor", "body", "n", "copy.*"), "classes")
    size = F.sum(F.col("windows") + length - 1)
    classes = classes.join(classes.groupBy("anchor").agg((size > HOT_BYTES).alias("hot")), "anchor")

    def pieces(some: DataFrame) -> DataFrame:
        wanted = some.groupBy("uid").agg(F.collect_list(F.struct("anchor", "body", "at", "windows")).alias("wanted"))
        rows = texts.join(wanted, "uid").select("id", "uid", "t", "wanted")
        return rows.mapInArrow(_pieces(length), "anchor bigint, body bigint, data binary")

    dealt = pieces(classes.filter("not hot")).repartition("anchor").sortWithinPartitions("anchor", "body")
    marks = dealt.mapInArrow(_marked(length), f"anchor bigint, body bigint, marks {MARKS}")

    windows = pieces(classes.filter("hot")).dropDuplicates(["anchor", "body"]).mapInArrow(_windows(length), "anchor bigint, body bigint, i int, h1 bigint, h2 bigint")
    twice = windows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    one = F.struct(F.col("i").alias("b"), (F.col("i") + 1).alias("e"))
    marks = marks.unionByName(windows.join(twice, ["h1", "h2"]).groupBy("anchor", "body").agg(F.collect_list(one).alias("marks")))
    # all windows of a range that has copies are repeats
    copies = classes.filter("n > 1").select("anchor", "body", F.array(F.struct(F.lit(0).alias("b"), F.col("windows").alias("e"))).alias("marks"))
    marked = edges.join(marks.unionByName(copies), ["anchor", "body"]).select("uid", "at", F.explode("marks").alias("m"))
    marked = marked.select("uid", (F.col("at") + F.col("m.b")).alias("b"), (F.col("at") + F.col("m.e")).alias("e"))
    return marked.unionByName(shared.filter("whole").select("uid", F.col("at").alias("b"), (F.col("at") + F.col("windows")).alias("e")))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """id, n_bytes, n_removed, n_spans and the SHA-256 of the bytes that stay. ``length`` is at least GRAM + 1."""
    texts = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("s"))
    texts = texts.select("id", F.xxhash64("id", "s").alias("uid"), F.encode("s", "UTF-8").alias("t"))
    spans = repeated_ranges(texts, length).groupBy("uid").agg(F.collect_list(F.struct("b", "e")).alias("marks"))
    rows = texts.join(spans, "uid", "left").select("id", "uid", "t", "marks")
    out = rows.mapInArrow(_kept(length), f"id {texts.schema['id'].dataType.simpleString()}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
    return out.withColumnRenamed("id", id_col)
