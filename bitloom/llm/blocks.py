"""Exact comparison of all pairs that share a bucket, without a row per pair.

``link`` takes bucket keys per node (one per hash table) and a payload per node. Buckets with the same members count once. A
bucket is cut into blocks of bounded rows and bytes, each pair of blocks is one group of a task, and the task gives one row
per node: the weight of its links there and the smallest node it is connected with there. A pair that shares several buckets
is counted in the first of them. A bucket of any size is therefore spread over many tasks, and what is written
grows with the nodes, not with the pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

BLOCK_ROWS = 256
BLOCK_BYTES = 32 << 20


def seats(keys: DataFrame, block_rows: int = BLOCK_ROWS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """keys: node, size (bytes of its payload), keys (array of bucket hashes, one per table, null: none).
    Gives node and its seats: (t, key, blocks) of each kept bucket that it shares with another node."""
    rows = keys.select("node", "size", F.posexplode("keys").alias("t", "key")).dropna()
    shared = rows.groupBy("t", "key").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("size").alias("bytes"),
        F.bit_xor(F.xxhash64("node")).alias("d1"),
        F.bit_xor(F.xxhash64("node", F.lit(1))).alias("d2"),
    )
    shared = shared.filter("n > 1").groupBy("n", "d1", "d2").agg(F.min(F.struct("t", "key")).alias("at"), F.max("bytes").alias("bytes"))
    blocks = F.greatest(F.ceil(F.col("n") / block_rows), F.ceil(F.col("bytes") / block_bytes)).cast("int")
    shared = shared.select("at.t", "at.key", blocks.alias("blocks"))
    own = rows.select("node", "t", "key").join(shared, ["t", "key"])
    return own.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("t", "key", "blocks"))).alias("seats"))


def _runs(batches, key_columns: int) -> Iterator[pa.Table]:
    """Rows of one group at a time, from batches sorted by the first columns."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(key_columns)]
        change = np.zeros(batch.num_rows, bool)
        change[0] = last != tuple(k[0] for k in keys)
        for k in keys:
            change[1:] |= k[1:] != k[:-1]
        last = tuple(k[-1] for k in keys)
        cuts = [*np.flatnonzero(change).tolist(), batch.num_rows]
        if cuts[0] > 0 or not change[0]:
            held.append(batch.slice(0, cuts[0]))
        for begin, stop in zip(cuts, cuts[1:]):
            if held:
                yield pa.Table.from_batches(held)
            held = [batch.slice(begin, stop - begin)]
    if held:
        yield pa.Table.from_batches(held)


def block_components(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """Smallest member of each of n nodes' components under the links i-j."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _compare(kernel: Callable[[list[bytes]], np.ndarray]):
    """kernel: boolean matrix of links between payloads."""

    def rows(batches):
        node, weight, root = [], [], []

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (node, weight, root)], ["node", "links", "root"])
            for x in (node, weight, root):
                x.clear()
            return out

        held = 0
        for group in _runs(batches, 3):
            nodes = group.column("node").to_numpy()
            _, first = np.unique(nodes, return_index=True)  # sorted by node; a repeated row counts once
            nodes = nodes[first]
            if len(nodes) < 2:
                continue
            side = group.column("own").to_numpy()[first]
            lo, hi = group.column("lo")[0].as_py(), group.column("hi")[0].as_py()
            payload = group.column("payload")
            linked = kernel([payload[int(k)].as_py() for k in first])
            linked &= np.triu(np.ones(linked.shape, bool), 1)
            if lo != hi:
                linked &= side[:, None] != side[None, :]
            i, j = np.nonzero(linked)
            if not len(i):
                continue
            comp = block_components(i, j, len(nodes))
            counted = np.ones(len(i), bool)
            t = group.column("t")[0].as_py()
            if t:
                all_seats = [group.column("seats")[int(k)].as_py() for k in first]
                own = {}
                for k, its in enumerate(all_seats):
                    for s in its:
                        if s["t"] < t:
                            own.setdefault(s["t"], {})[k] = s["key"]
                for keys in own.values():
                    if len(keys) > 1:
                        has, val = np.zeros(len(nodes), bool), np.zeros(len(nodes), np.int64)
                        has[list(keys)] = True
                        val[list(keys)] = list(keys.values())
                        counted &= ~(has[i] & has[j] & (val[i] == val[j]))
            weights = group.column("weight").to_numpy()[first]
            total = np.bincount(i[counted], weights[j[counted]], len(nodes)) + np.bincount(j[counted], weights[i[counted]], len(nodes))
            some = np.unique(np.concatenate([i, j]))
            node.append(nodes[some])
            weight.append(total[some].astype(np.int64))
            root.append(nodes[comp[some]])
            held += len(some)
            if held > 50_000:
                yield flush()
                held = 0
        if node:
            yield flush()

    return rows


def link(payloads: DataFrame, kernel: Callable[[list[bytes]], np.ndarray], name: str) -> DataFrame:
    """payloads: node, weight, payload (binary), seats. Gives node, links (weight of the linked nodes) and root, several rows a
    node: nodes with equal roots are connected."""
    rows = payloads.select("node", "weight", "payload", "seats", F.explode("seats").alias("s"))
    own = F.pmod(F.xxhash64("node", "s.key"), F.col("s.blocks")).cast("int")
    rows = rows.select("*", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("s.blocks") - 1)).alias("other"))
    rows = rows.select(
        F.col("s.key").alias("key"),
        F.least("own", "other").alias("lo"),
        F.greatest("own", "other").alias("hi"),
        "own",
        F.col("s.t").alias("t"),
        "node",
        "weight",
        "payload",
        "seats",
    )
    rows = rows.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "node")
    return stored(rows.mapInArrow(_compare(kernel), "node bigint, links bigint, root bigint"), name)
