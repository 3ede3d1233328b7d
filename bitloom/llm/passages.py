"""Passages that repeat across documents: seed and extend.

Every window of ``length`` words names one anchor: the smallest hash among its grams of ``gram`` words, the leftmost on ties. Equal
windows name equal anchors, so documents that share a window meet at a shared anchor. The windows of a document that name one
place are a region around it. Regions of an anchor that are equal, by place and content, are one class, settled by the
smallest id in it. Where classes of an anchor differ, their words are compared from the anchor outwards, both ways, and the
maximal repeat of two is kept if it has ``length`` words or more; of two documents the one with the larger id loses it.

An anchor with more than ``most_pairs`` classes would need pairs without bound; its classes are looked up by the hashes of
their windows instead, at most ``length - gram + 1`` a class, with the same result. Candidates are found by 64-bit hashes; what is
removed rests on two of them (anchor and region, or two of a window) or on word-by-word equality of 64-bit word hashes.

Defined results: a null text has no words; a null id is larger than every other id; rows with equal ids take nothing from each
other, and repeated rows have equal results; texts of any length go through whole; an empty table gives an empty table; columns
besides id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import salted_join, stored

LENGTH = 50
GRAM = 20
MOST_PAIRS = 256
WORDS = 1 << 20  # words of a slice of rows, unless one row has more
PAIRS = 1 << 16  # pairs compared at once
KNOWN = 400_000  # words whose hashes a worker remembers
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)  # odd, so they have inverses
REGION = ["anchor", "region"]
SPAN = "struct<lo:int,hi:int>"


class _Hashes(dict):
    """64-bit hash of a word, remembered for short words."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 32:
            if len(self) >= KNOWN:
                self.clear()
            self[word] = value
        return value


_KNOWN = _Hashes()
_POWERS: dict[int, np.ndarray] = {}


def split_words(text: bytes | None) -> list[bytes]:
    """Runs of bytes other than space and 9 to 13."""
    return (text or b"").split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_KNOWN.__getitem__, words), np.uint64, len(words))


def _powers(base: int, n: int) -> np.ndarray:
    """1, base, base^2, ... modulo 2^64."""
    if len(_POWERS.get(base, ())) < n:
        row = np.full(max(n, 1024), base, np.uint64)
        row[0] = 1
        _POWERS[base] = np.multiply.accumulate(row)
    return _POWERS[base][:n]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Hashes of any stretch of a row of word hashes."""

    def __init__(self, hashes: np.ndarray, base: int = BASES[0]):
        n = len(hashes)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(hashes * _powers(base, n), out=self.sums[1:])
        self.down = _powers(pow(base, -1, 1 << 64), n + 1)

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[begin]) * self.down[begin])


def leftmost_least(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the smallest of each ``width`` neighbours, the leftmost on ties."""
    at, span = np.arange(len(values)), 1

    def better(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(values[a] <= values[b], a, b)

    while span * 2 <= width:
        at = better(at[:-span], at[span:])
        span *= 2
    return better(at[: len(at) - (width - span)], at[width - span :]) if width > span else at


def regions(hashes: np.ndarray, starts: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Of documents laid end to end: anchor hash, region hash, and by position in the row the anchor, first and last window.
    ``starts`` has the begin of each document, and the end of the last one."""
    n = len(hashes)
    if n < length:
        return (np.empty(0, np.uint64),) * 2 + (np.empty(0, np.int64),) * 3
    roll = Rolling(hashes)
    at = np.arange(n - gram + 1)
    grams = roll.of(at, at + gram)
    chosen = leftmost_least(grams, length - gram + 1)
    first = np.arange(n - length + 1)
    inside = np.repeat(starts[1:], np.diff(starts))[: len(first)] >= first + length
    fresh = inside.copy()
    fresh[1:] &= ~inside[:-1] | (chosen[1:] != chosen[:-1])
    last = inside.copy()
    last[:-1] &= ~inside[1:] | fresh[1:]
    lo, hi = first[fresh], first[last]
    anchor = chosen[lo]
    shape = ((anchor - lo) * length + (hi - lo)).astype(np.uint64)
    return grams[anchor], _mixed(roll.of(lo, hi + length) ^ _mixed(shape)), anchor, lo, hi


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[int, int, list[list[bytes]]]]:
    """Some rows at a time: begin, end and the words of each; the text is the last column."""
    begin, held, words = 0, 0, []
    for k, text in enumerate(batch.column(batch.num_columns - 1).cast(pa.binary())):
        words.append(split_words(text.as_py()))
        held += len(words[-1])
        if held >= WORDS:
            yield begin, k + 1, words
            begin, held, words = k + 1, 0, []
    if words:
        yield begin, batch.num_rows, words


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())


def _seeds(length: int, gram: int):
    """(id, th, t) to one row per region: anchor, region, id, th, at, left, span."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end, words in _slices(batch):
                starts = np.cumsum([0, *map(len, words)])
                hashes = word_hashes([w for part in words for w in part])
                anchor, region, at, lo, hi = regions(hashes, starts, length, gram)
                row = np.searchsorted(starts, at, "right") - 1
                take = pa.array(begin + row)
                yield pa.RecordBatch.from_arrays(
                    [
                        _signed(anchor),
                        _signed(region),
                        batch.column(0).take(take),
                        batch.column(1).take(take),
                        pa.array(at - starts[row], pa.int32()),
                        pa.array(at - lo, pa.int32()),
                        pa.array(hi - lo, pa.int32()),
                    ],
                    ["anchor", "region", "id", "th", "at", "left", "span"],
                )

    return run


def _contexts(length: int):
    """(id, heads, t) to one row per head: anchor, region, id, rivals, left and the word hashes of its region."""

    def run(batches):
        for batch in batches:
            heads = batch.column(1).to_pylist()
            for begin, end, words in _slices(batch):
                out = []
                for k in range(begin, end):
                    hashes = word_hashes(words[k - begin])
                    for h in heads[k]:
                        lo = h["at"] - h["left"]
                        out.append((k, h["anchor"], h["region"], h["rivals"], h["left"], hashes[lo : lo + h["span"] + length].tobytes()))
                cols = list(zip(*out)) if out else [()] * 6
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(cols[1], pa.int64()),
                        pa.array(cols[2], pa.int64()),
                        batch.column(0).take(pa.array(cols[0], pa.int64())),
                        pa.array(cols[3], pa.int64()),
                        pa.array(cols[4], pa.int32()),
                        pa.array(cols[5], pa.binary()),
                    ],
                    ["anchor", "region", "id", "rivals", "left", "words"],
                )

    return run


def _extended(length: int, gram: int):
    """Rows (anchor, region, id, left, words), those of an anchor together and by id with null last: each class's repeat with
    classes of smaller ids, as one stretch around the anchor, since every repeat holds it."""
    reach = length - gram

    def compared(group: list[tuple], bounds: list[int]) -> pa.RecordBatch:
        left, right = np.zeros((len(group), reach), np.uint64), np.zeros((len(group), reach), np.uint64)
        sizes = np.zeros((len(group), 2), np.int64)
        for k, (_, _, _, before, words) in enumerate(group):
            row = np.frombuffer(words, np.uint64)
            after = row[before + gram :]
            left[k, :before], right[k, : len(after)] = row[:before][::-1], after
            sizes[k] = before, len(after)
        high, low = [], []
        for b, e in zip(bounds, bounds[1:]):
            i, j = np.tril_indices(e - b, -1)
            high.append(b + i)
            low.append(b + j)
        i, j = np.concatenate(high), np.concatenate(low)
        void = np.array([g[2] is None for g in group])
        ident = np.array([g[2] or 0 for g in group])
        other = (void[i] != void[j]) | (ident[i] != ident[j])
        i, j = i[other], j[other]
        most = np.minimum(sizes[i], sizes[j])

        def run_of(side: np.ndarray, cap: np.ndarray) -> np.ndarray:
            same = np.logical_and.accumulate(side[i] == side[j], axis=1).sum(1)
            return np.minimum(same, cap)

        before, after = run_of(left, most[:, 0]), run_of(right, most[:, 1])
        long = before + gram + after >= length
        lo, hi = np.full(len(group), -1), np.full(len(group), -1)
        np.maximum.at(lo, i[long], before[long])
        np.maximum.at(hi, i[long], after[long])
        found = np.flatnonzero(lo >= 0)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([group[k][0] for k in found], pa.int64()),
                pa.array([group[k][1] for k in found], pa.int64()),
                pa.array([[{"lo": -int(lo[k]), "hi": gram + int(hi[k])}] for k in found], pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))),
            ],
            ["anchor", "region", "marks"],
        )

    def run(batches):
        group, bounds, pairs = [], [0], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if group and row[0] == group[-1][0] and row[1] == group[-1][1]:
                    continue  # a row given twice
                if group and row[0] != group[-1][0]:
                    size = len(group) - bounds[-1]
                    pairs += size * (size - 1) // 2
                    bounds.append(len(group))
                    if pairs >= PAIRS:
                        yield compared(group, bounds)
                        group, bounds, pairs = [], [0], 0
                group.append(row)
        if group:
            yield compared(group, [*bounds, len(group)])

    return run


def _windows(length: int):
    """(anchor, region, id, left, words) to one row per window: two hashes of it, and its place from the anchor."""

    def run(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                row = np.frombuffer(batch.column(4)[at].as_py(), np.uint64)
                first = np.arange(len(row) - length + 1)
                one, two = (Rolling(row, b).of(first, first + length) for b in BASES)
                same = pa.array(np.full(len(first), at))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).take(same) for c in range(3)), _signed(one), _signed(two), pa.array(first - batch.column(3)[at].as_py(), pa.int32())],
                    ["anchor", "region", "id", "one", "two", "lo"],
                )

    return run


def _kept(batches):
    """(id, marks, t) to id, n_words, n_removed, spans (words removed, end exclusive) and the kept words joined by one space."""
    for batch in batches:
        marks = batch.column(1).to_pylist()
        for begin, end, words in _slices(batch):
            n, removed, spans, kept = [], [], [], []
            for row, own in zip(words, marks[begin:end]):
                joined: list[list[int]] = []
                for m in sorted(own or (), key=lambda m: m["lo"]):
                    if joined and m["lo"] <= joined[-1][1]:
                        joined[-1][1] = max(joined[-1][1], m["hi"])
                    else:
                        joined.append([m["lo"], m["hi"]])
                left, at = [], 0
                for lo, hi in joined:
                    left += row[at:lo]
                    at = hi
                left += row[at:]
                n.append(len(row))
                removed.append(len(row) - len(left))
                spans.append([{"lo": lo, "hi": hi} for lo, hi in joined])
                kept.append(b" ".join(left))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0)[begin:end],
                    pa.array(n, pa.int64()),
                    pa.array(removed, pa.int64()),
                    pa.array(spans, pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))),
                    pa.array(kept, pa.binary()).cast(pa.string()),
                ],
                ["id", "n_words", "n_removed", "spans", "kept"],
            )


def _order() -> Column:
    """An id with its place: null is the largest."""
    return F.struct(F.col("id").isNull().alias("void"), F.col("id").alias("id"))


def _by_windows(rows: DataFrame, kind: str, length: int, hot_rows: int) -> DataFrame:
    """The marks of classes of anchors with very many of them."""
    windows = rows.select(*REGION, "id", "left", "words").mapInArrow(_windows(length), f"anchor bigint, region bigint, id {kind}, one bigint, two bigint, lo int")
    windows = stored(windows, "windows")
    least = windows.groupBy("one", "two").agg(F.min(_order()).alias("least"), F.max(_order()).alias("most"), F.count(F.lit(1)).alias("rows"))
    least = stored(least.filter("least < most").drop("most"), "window-ids")
    found = salted_join(windows, least, ["one", "two"], "rows", REGION, hot_rows).filter(_order() > F.col("least"))
    marks = F.collect_set(F.struct("lo", (F.col("lo") + length).alias("hi")))
    return found.groupBy(*REGION).agg(marks.cast(f"array<{SPAN}>").alias("marks"))


def remove_passages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, most_pairs: int = MOST_PAIRS, hot_rows: int = 4096
) -> DataFrame:
    """One row per row: id, n_words, n_removed, spans (words removed: lo, and hi exclusive), kept (kept words, joined by one space).

    A word is removed if it lies in ``length`` consecutive words that also stand in a document with a smaller id."""
    if not 0 < gram <= length:
        raise ValueError("a gram has between one word and the length")
    rows = docs.select(docs[id_col].alias("id"), F.xxhash64(docs[text_col]).alias("th"), docs[text_col].alias("t"))
    kind = rows.schema["id"].dataType.simpleString()
    able = F.octet_length("t") >= 2 * length - 1
    texts = rows.filter(able)
    places = "at int, left int, span int"
    seeds = stored(texts.mapInArrow(_seeds(length, gram), f"anchor bigint, region bigint, id {kind}, th bigint, {places}"), "seeds")

    # anchors of two ids or more
    anchors = seeds.groupBy("anchor").agg(F.min(_order()).alias("least"), F.max(_order()).alias("most"), F.count(F.lit(1)).alias("rows"))
    anchors = stored(anchors.filter("least < most").select("anchor", "rows"), "anchors")
    shared = stored(salted_join(seeds, anchors, ["anchor"], "rows", ["id", "th"], hot_rows).drop("rows"), "shared")

    head = F.min(F.struct(F.col("id").isNull().alias("void"), "id", "th", "at", "left", "span")).alias("head")
    classes = stored(shared.groupBy(*REGION).agg(head, F.count(F.lit(1)).alias("rows")), "classes")

    # words around the heads of anchors with several classes
    rivals = classes.groupBy("anchor").agg(F.count(F.lit(1)).alias("rivals")).filter("rivals > 1")
    contested = salted_join(classes.select(*REGION, "head"), stored(rivals, "rivals"), ["anchor"], "rivals", ["region"], hot_rows)
    heads = contested.select("head.id", "head.th", F.struct(*REGION, "rivals", "head.at", "head.left", "head.span").alias("h"))
    heads = heads.groupBy("id", "th").agg(F.collect_list("h").alias("heads"))
    asked = heads.select(F.col("id").alias("head_id"), F.col("th").alias("head_th"), "heads")
    met = texts.join(asked, texts["id"].eqNullSafe(asked["head_id"]) & (texts["th"] == asked["head_th"])).select("id", "heads", "t")
    words = stored(met.mapInArrow(_contexts(length), f"anchor bigint, region bigint, id {kind}, rivals bigint, left int, words binary"), "contexts")

    few = words.filter(F.col("rivals") <= most_pairs).select(*REGION, "id", "left", "words")
    few = few.repartition("anchor").sortWithinPartitions("anchor", F.col("id").asc_nulls_last(), "region")
    marks = few.mapInArrow(_extended(length, gram), f"anchor bigint, region bigint, marks array<{SPAN}>")
    marks = marks.unionByName(_by_windows(words.filter(F.col("rivals") > most_pairs), kind, length, hot_rows))

    # what each row of a class loses
    settled = classes.select(*REGION, "rows", F.struct("head.void", "head.id").alias("first")).join(stored(marks, "marks"), REGION, "left")
    lost = salted_join(shared, settled, REGION, "rows", ["id", "th"], hot_rows)
    whole = F.array(F.struct((-F.col("left")).alias("lo"), (F.col("span") - F.col("left") + length).alias("hi")))
    lost = lost.select("id", "th", "at", F.explode(F.when(_order() > F.col("first"), whole).otherwise(F.col("marks"))).alias("m"))
    lost = lost.groupBy("id", "th").agg(F.collect_set(F.struct((F.col("at") + F.col("m.lo")).alias("lo"), (F.col("at") + F.col("m.hi")).alias("hi"))).alias("marks"))
    lost = stored(lost, "lost").select(F.col("id").alias("lost_id"), F.col("th").alias("lost_th"), "marks")

    joined = texts.join(lost, texts["id"].eqNullSafe(lost["lost_id"]) & (texts["th"] == lost["lost_th"]), "left").select("id", "marks", "t")
    rest = rows.filter(F.coalesce(~able, F.lit(True))).select("id", F.lit(None).cast(f"array<{SPAN}>").alias("marks"), "t")
    out = joined.unionByName(rest).mapInArrow(_kept, f"id {kind}, n_words bigint, n_removed bigint, spans array<{SPAN}>, kept string")
    return out.withColumnRenamed("id", id_col)
