"""Near copies among embeddings: sign hashing by random hyperplanes in several tables, exact cosine, components.

Tables and bits follow from the threshold, the target recall and the number of vectors. Equal vectors of one label are one
node with a weight. Vectors that share a bucket of one label meet block against block, twice: first with their sign bits only, where a pair
goes on if few enough signs differ and no earlier table has it in one bucket; then, of the vectors with such a pair, with their
numbers, and the cosine is taken in double precision. So the numbers of a vector are not sent once for each table.

Defined results: a vector that is null, empty, zero or holds a null or a non-finite number links with nothing, as does one
with a null label; vectors of different lengths do not link; repeated rows are copies; an empty table gives an empty table;
other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks
from .blocks import _runs, block_components
from .common import stored
from .components import components

THRESHOLD = 0.93
RECALL = 0.999
SEED = 5
BLOCK_ROWS = 1024
SCREEN_BITS = 256  # signs a pair is screened by
SCREEN_MISS = 1e-6  # share of pairs at the threshold that the screen may lose


def choose_tables(threshold: float, recall: float, rows: int) -> tuple[int, int]:
    """(tables, bits): bits grow with the logarithm of the rows, so a bucket of unrelated vectors stays small."""
    bits = min(30, max(8, math.ceil(math.log2(max(rows, 2))) - 2))
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return math.ceil(math.log(1 - recall) / math.log1p(-same)), bits


def choose_screen(threshold: float, tables: int, bits: int) -> tuple[int, int]:
    """(tables, signs): the tables whose signs are compared, and how many may differ: a sign differs with the angle over pi."""
    used = min(tables, math.ceil(SCREEN_BITS / bits))
    n, p, tail = used * bits, math.acos(threshold) / math.pi, 1.0
    for k in range(n):
        tail -= math.comb(n, k) * p**k * (1 - p) ** (n - k)
        if tail <= SCREEN_MISS:
            return used, k
    return used, n


def _vectors(tables: int, bits: int):
    planes: dict[int, np.ndarray] = {}

    def run(batches):
        for batch in batches:
            out = []
            for label, vec in zip(batch.column(1).to_pylist(), batch.column(2)):
                x = vec.values.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0 if vec.is_valid and label is not None else np.empty(0)
                if vec.is_valid and (not len(x) or vec.values.null_count or not np.isfinite(x).all() or not x.any()):
                    x = np.empty(0)
                out.append(x)
            nodes, keys, signs, data = [], [], [], []
            for label, x in zip(batch.column(1).to_pylist(), out):
                if not len(x):
                    nodes.append(None)
                    keys.append(None)
                    signs.append(None)
                    data.append(None)
                    continue
                if len(x) not in planes:
                    planes[len(x)] = np.random.default_rng([SEED, len(x)]).standard_normal((tables, bits, len(x)))
                unit = x / np.abs(x).max()  # no overflow or underflow in the norm
                unit = unit / math.sqrt(unit @ unit)
                about = np.packbits(planes[len(x)] @ unit > 0, axis=1)
                tag = f"{label}\0{len(x)}\0".encode()
                nodes.append(xxhash.xxh3_64_intdigest(tag + x.tobytes()) - (1 << 63))
                keys.append([xxhash.xxh3_64_intdigest(tag + bytes([t & 255, t >> 8]) + row.tobytes()) - (1 << 63) for t, row in enumerate(about)])
                signs.append(about.tobytes())
                data.append(unit.tobytes())
            columns = [batch.column(0), pa.array(nodes, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(signs, pa.binary()), pa.array(data, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "node", "keys", "signs", "payload"])

    return run


def _table_of(signs: list[bytes], tables: int) -> np.ndarray:
    return np.frombuffer(b"".join(signs), np.uint8).reshape(len(signs), tables, -1)


def _as_words(signs: np.ndarray) -> np.ndarray:
    """The signs of each row as 64-bit words, filled up with zeros."""
    flat = signs.reshape(len(signs), -1)
    return np.pad(flat, ((0, 0), (0, -flat.shape[1] % 8))).view(np.uint64)


def met_first(signs: np.ndarray, i: np.ndarray, j: np.ndarray, t: np.ndarray) -> np.ndarray:
    """For pairs that share a bucket of table t (one per pair): is none of the tables before it one where all signs are equal."""
    out = np.ones(len(i), bool)
    earlier = np.arange(signs.shape[1])
    for at in range(0, len(i), 1 << 16):
        part = slice(at, at + (1 << 16))
        same = (signs[i[part]] == signs[j[part]]).all(axis=2)
        out[part] = ~(same & (earlier < t[part, None])).any(axis=1)
    return out


def _pairs(group: pa.Table, tables: int, linked):
    """Rows of a block pair, once each, and their pairs that ``linked(rows, left, right)`` marks and no earlier table has."""
    _, rows = np.unique(group.column("node").to_numpy(), return_index=True)
    group = group.take(pa.array(rows))
    side, lo, hi = group.column("own").to_numpy(), group.column("lo")[0].as_py(), group.column("hi")[0].as_py()
    left, right = np.flatnonzero(side == lo), np.flatnonzero(side == hi)
    signs = _table_of(group.column("signs").to_pylist(), tables)
    marks = linked(group, signs, left, right)
    if lo == hi:
        marks = np.triu(marks, 1)
    i, j = np.nonzero(marks)
    i, j = left[i], right[j]
    first = met_first(signs, i, j, group.column("t").to_numpy()[i])
    return group, i[first], j[first]


def _joined(tables, rows: int = 20_000):
    """Few large batches from many small tables."""
    held, n = [], 0
    for table in tables:
        held.append(table)
        n += len(table)
        if n >= rows:
            yield from pa.concat_tables(held).combine_chunks().to_batches()
            held, n = [], 0
    if held:
        yield from pa.concat_tables(held).combine_chunks().to_batches()


SEAT = ["key", "lo", "hi", "own", "t", "node"]


def _close(words: np.ndarray, own: np.ndarray, lo: np.ndarray, hi: np.ndarray, starts: np.ndarray, size: int, limit: int):
    """Row numbers of the pairs with few differing signs in groups of one size, all groups at once."""
    at = starts[:, None] + np.arange(size)
    part, side = words[at], own[at]
    differ = np.zeros((len(at), size, size), np.uint16)
    for w in range(part.shape[2]):
        differ += np.bitwise_count(part[:, :, None, w] ^ part[:, None, :, w])
    across = (side[:, :, None] != side[:, None, :]) | (lo[starts] == hi[starts])[:, None, None]
    g, i, j = np.nonzero((differ <= limit) & across & np.triu(np.ones((size, size), bool), 1))
    return at[g, i], at[g, j]


SMALL = 1 << 20  # cells of the matrices that are compared at once


def _screened(tables: int, used: int, limit: int):
    """Rows that have a pair to verify in their block pair. Input is sorted by key, lo, hi; a group may run over batches."""

    def pairs(rows: pa.Table, starts: np.ndarray, sizes: np.ndarray):
        own, lo, hi, t = (rows.column(c).to_numpy() for c in ("own", "lo", "hi", "t"))
        signs = _table_of(rows.column("signs").to_pylist(), tables)
        words = _as_words(signs[:, :used])
        for size in np.unique(sizes[sizes > 1]).tolist():
            of_size = starts[sizes == size]
            step = max(1, SMALL // size**2)
            for k in range(0, len(of_size), step):
                i, j = _close(words, own, lo, hi, of_size[k : k + step], size, limit)
                first = met_first(signs, i, j, t[i])
                yield np.union1d(i[first], j[first])

    def marked(rows: pa.Table, starts: np.ndarray):
        if len(rows):
            for at in pairs(rows, starts, np.diff(starts, append=len(rows))):
                if len(at):
                    yield rows.select(SEAT).take(pa.array(at))

    def found(batches):
        rest = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = (pa.concat_tables([rest, rows]) if rest is not None else rows).combine_chunks()
            if not len(rows):
                continue
            change = np.zeros(len(rows), bool)
            change[0] = True
            for c in ("key", "lo", "hi"):
                x = rows.column(c).to_numpy()
                change[1:] |= x[1:] != x[:-1]
            starts = np.flatnonzero(change)
            yield from marked(rows.slice(0, starts[-1]), starts[:-1])
            rest = rows.slice(starts[-1])
        if rest is not None:
            yield from marked(rest, np.zeros(1, np.int64))

    return lambda batches: _joined(found(batches))


def _verified(tables: int, threshold: float):
    """node, weight of its links and the smallest node it is connected with, for each block pair."""

    def linked(group, signs, left, right):
        x = np.frombuffer(b"".join(group.column("payload").to_pylist()), np.float64).reshape(len(group), -1)
        return x[left] @ x[right].T >= threshold

    def found(batches):
        for group in _runs(batches, 3):
            group, i, j = _pairs(group, tables, linked)
            if not len(i):
                continue
            nodes, weights = group.column("node").to_numpy(), group.column("weight").to_numpy()
            total = np.bincount(i, weights[j], len(nodes)) + np.bincount(j, weights[i], len(nodes))
            some = np.union1d(i, j)
            root = nodes[block_components(i, j, len(nodes))[some]]
            yield pa.table([pa.array(nodes[some]), pa.array(total[some].astype(np.int64)), pa.array(root)], ["node", "links", "root"])

    return lambda batches: _joined(found(batches))


def block_links(classes: DataFrame, tables: int, bits: int, threshold: float) -> DataFrame:
    """classes: node, weight, keys, signs, payload. Gives node, links and root, several rows a node."""
    seats = blocks.seats(classes.select("node", F.octet_length("payload").cast("long").alias("size"), "keys"), BLOCK_ROWS)
    rows = classes.select("node", "signs").join(seats, "node").select("node", "signs", F.explode("seats").alias("s"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node", "s.key"), F.col("s.blocks")).cast("int"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("s.blocks") - 1)).alias("other"))
    rows = rows.select(F.col("s.key").alias("key"), F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", F.col("s.t").alias("t"), "node", "signs")
    rows = rows.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "node")
    left = rows.mapInArrow(_screened(tables, *choose_screen(threshold, tables, bits)), "key bigint, lo int, hi int, own int, t int, node bigint")
    left = left.join(classes.select("node", "weight", "signs", "payload"), "node").select(*SEAT, "weight", "signs", "payload")
    left = left.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "node")
    return left.mapInArrow(_verified(tables, threshold), "node bigint, links bigint, root bigint")


def vector_links(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label_col: str = "label",
    threshold: float = THRESHOLD,
    recall: float = RECALL,
) -> DataFrame:
    """One row per row: id, n_links, component_id (smallest id reachable by links, itself included), kept."""
    tables, bits = choose_tables(threshold, recall, vectors.count())
    rows = vectors.select(vectors[id_col].alias("id"), vectors[label_col].cast("string").alias("label"), vectors[vec_col].alias("v"))
    kind = rows.schema["id"].dataType.simpleString()
    hashed = stored(rows.mapInArrow(_vectors(tables, bits), f"id {kind}, node bigint, keys array<bigint>, signs binary, payload binary"), "vectors")

    classes = hashed.filter("node is not null").groupBy("node").agg(
        F.count(F.lit(1)).alias("weight"), F.min("id").alias("first_id"), F.first("keys").alias("keys"), F.first("signs").alias("signs"), F.first("payload").alias("payload")
    )
    classes = stored(classes, "classes")
    links = stored(block_links(classes, tables, bits, threshold), "links")

    roots = components(links.select(F.col("node").alias("a"), F.col("root").alias("b")))
    counts = links.groupBy("node").agg(F.sum("links").alias("links"))
    nodes = classes.select("node", "weight", "first_id").join(counts, "node", "left").join(roots, "node", "left")
    nodes = nodes.withColumn("root", F.coalesce("root", "node"))
    named = nodes.groupBy("root").agg(F.min("first_id").alias("component_id"))
    nodes = nodes.join(named, "root").select("node", "component_id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    component = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return hashed.join(nodes, "node", "left").select(
        F.col("id").alias(id_col),
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"),
    )
