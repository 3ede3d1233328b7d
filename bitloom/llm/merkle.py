"""A Merkle manifest of a table: a leaf per row, a tree per group, and a tree over the groups.

Rows of a group are numbered along sampled ranges of (group, id), so no task holds a group. A level is built by a self-join:
the node at slot zero of each run of ``arity`` nodes computes the indices of its siblings (XOR of one for a binary tree,
slot offsets otherwise), an equijoin brings their digests, and the slot-zero row emits the parent. Each level is written to
the shared folder. Proofs go down again: a run is given the path of its parent, and its members add their siblings.

A digest is lowercase hex SHA-256, and inputs of a digest are joined as hex text. A node that is alone on its level is the root.

Defined results: a null field is ``-``; a null group is a group, before all others; null ids come first in their group; rows that
agree in group and id are ordered by their digest, and equal rows are leaves of their own; an empty table gives no
rows; columns that are not named are not read, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored

ARITY = 16
PATH = "array<struct<before:string,after:string>>"


def alone() -> Column:
    """Whether a run is all of its group: what is left is the root."""
    return (F.col("run") == 0) & (F.size("digests") == 1)


def digest(inputs: Column) -> Column:
    return F.sha2(inputs, 256)


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return digest(F.concat(*map(field, values)))


def group_key(group: Column) -> Column:
    """A group as text without nulls, in the order of its bytes, null first."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))


def numbered(rows: DataFrame, key: str, order: Sequence[str], name: str) -> DataFrame:
    """Adds ``idx``, the place of a row within its key by ``order``, from 0.

    Ranges of (key, order) are sorted task by task and written with their row numbers; the start of a key in a range follows
    from the counts of the ranges before, at most one row per key and range."""
    placed = rows.repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    placed = stored(placed.select("*", F.monotonically_increasing_id().alias("at")), name)
    placed = placed.withColumn("part", F.shiftright("at", 33))
    parts = placed.groupBy(key, "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    earlier = W.partitionBy(key).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select(key, "part", "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("skip"))
    return placed.join(parts, [key, "part"]).select(*rows.columns, (F.col("at") - F.col("first") + F.col("skip")).alias("idx"))


def siblings(idx: Column, arity: int) -> Column:
    """Indices of the other slots of the run of ``idx``, those beyond the end of the level too."""
    if arity == 2:
        return F.array(idx.bitwiseXOR(F.lit(1).cast("long")))
    slot = F.pmod(idx, F.lit(arity))
    return F.transform(F.sequence(F.lit(1), F.lit(arity - 1)), lambda d: idx - slot + F.pmod(slot + d, F.lit(arity)))


def run_digests(nodes: DataFrame, arity: int) -> DataFrame:
    """(key, run, digests): the digests of each run in order, at most ``arity``, by a join of slot zero with its siblings."""
    heads = nodes.filter(F.pmod("idx", F.lit(arity)) == 0)
    wanted = F.concat(F.array("idx"), siblings(F.col("idx"), arity))
    wanted = heads.select("key", F.col("idx").alias("head"), F.explode(wanted).alias("idx"))
    found = wanted.join(nodes.select("key", "idx", "digest"), ["key", "idx"])
    runs = found.groupBy("key", "head").agg(F.array_sort(F.collect_list(F.struct("idx", "digest"))).alias("s"))
    return runs.select("key", (F.col("head") / arity).cast("long").alias("run"), F.col("s.digest").alias("digests"))


def levels(nodes: DataFrame, arity: int, name: str) -> tuple[list[DataFrame], DataFrame]:
    """The runs of each level from the leaves (key, idx, digest) up, and (key, digest) of the roots."""
    tables: list[DataFrame] = []
    while not tables or not nodes.isEmpty():
        tables.append(stored(run_digests(nodes, arity), f"{name}-{len(tables)}"))
        nodes = tables[-1].filter(~alone()).select("key", F.col("run").alias("idx"), digest(F.concat_ws("", "digests")).alias("digest"))
    roots = [t.filter(alone()).select("key", F.get("digests", F.lit(0)).alias("digest")) for t in tables]
    out = roots[0]
    for r in roots[1:]:
        out = out.unionByName(r)
    return tables, out


def step(digests: Column, slot: Column) -> Column:
    """The siblings of a slot, those before and those after it."""
    before, after = F.slice(digests, F.lit(1), slot), F.slice(digests, slot + 2, F.size(digests))
    return F.struct(F.concat_ws("", before).alias("before"), F.concat_ws("", after).alias("after"))


def longer(slot: Column) -> Column:
    """The path of a member of a run: its step there and the path of the run; a node that is alone has no step."""
    return F.when(alone(), F.col("path")).otherwise(F.concat(F.array(step(F.col("digests"), slot)), F.col("path")))


def paths(tables: list[DataFrame], top: DataFrame, arity: int) -> DataFrame:
    """The runs of the leaves with the path and root above each; ``top`` has key, path and root for each root."""
    above = held = None
    for level in reversed(tables):
        ends = level.filter(alone()).select("key", "run").join(top, "key")
        held = level.join(ends if above is None else above.unionByName(ends), ["key", "run"])
        member = held.select("*", F.posexplode("digests").alias("slot", "_"))
        above = member.select("key", (F.col("run") * arity + F.col("slot")).alias("run"), longer(F.col("slot")).alias("path"), "root")
    return held


def folded(path: Column, start: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.reduce(path, start, lambda acc, p: digest(F.concat(p["before"], acc, p["after"])))


def proof_digest(path: Column) -> Column:
    """Digest of all siblings of a leaf, level by level from the leaf up, left to right."""
    return digest(F.concat_ws("", F.transform(path, lambda p: F.concat(p["before"], p["after"]))))


def manifest(
    docs: DataFrame, fields: Sequence[str], id_col: str = "doc_id", group_col: str = "source", arity: int = ARITY, carry: dict[str, Column] | None = None
) -> DataFrame:
    """One row per row: id, leaf (digest of the fields in order), subroot, root, path (siblings before and after, from the
    leaf to the root) and the columns of ``carry``, which are computed from the row."""
    if arity < 2:
        raise ValueError("a tree needs an arity of 2 or more")
    carry = carry or {}
    rows = docs.select(
        group_key(docs[group_col]).alias("key"),
        docs[id_col].alias("id"),
        leaf(*[docs[c] for c in fields]).alias("digest"),
        *[c.alias(f"carry_{n}") for n, c in carry.items()],
    )
    leaves = stored(numbered(rows, "key", ["id", "digest"], "leaves"), "leaves")
    tables, subroots = levels(leaves.select("key", "idx", "digest"), arity, "level")

    # the groups are the leaves of a tree whose only key is empty
    groups = subroots.select(F.lit("").alias("key"), F.col("key").alias("id"), "digest")
    groups = stored(numbered(groups, "key", ["id"], "groups"), "groups")
    upper, roots = levels(groups.select("key", "idx", "digest"), arity, "upper")
    top = roots.select("key", F.expr(f"cast(array() AS {PATH})").alias("path"), F.col("digest").alias("root"))
    runs = paths(upper, top, arity)
    place = groups.withColumn("run", F.floor(F.col("idx") / arity)).withColumn("slot", F.pmod("idx", F.lit(arity)).cast("int"))
    top = place.join(runs, ["key", "run"])
    top = stored(top.select(F.col("id").alias("key"), longer(F.col("slot")).alias("path"), F.struct(F.col("digest").alias("sub"), "root").alias("root")), "tops")

    runs = paths(tables, top, arity)
    place = leaves.withColumn("run", F.floor(F.col("idx") / arity)).withColumn("slot", F.pmod("idx", F.lit(arity)).cast("int"))
    return place.join(runs, ["key", "run"]).select(
        F.col("id").alias(id_col),
        F.col("digest").alias("leaf"),
        F.col("root.sub").alias("subroot"),
        F.col("root.root").alias("root"),
        longer(F.col("slot")).alias("path"),
        *[F.col(f"carry_{n}").alias(n) for n in carry],
    )
