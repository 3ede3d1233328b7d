"""Exact duplicates by a distributed content sort.

Sampled splitters range-partition the normalised texts, each partition is sorted externally so that equal texts are
neighbours, and a window compares neighbours by their full content.

The splitters are cut to the first bytes of a text plus an 8-byte fingerprint, so that sampling moves a bounded
number of bytes a row. A group with more than ``hot_rows`` rows or ``HOT_BYTES`` bytes is dealt over several ranges by a
salt, whatever the size of the table; the parts of such a group meet again as one row each, by SHA-256. The lists of such
groups are broadcast up to ``HOT_LIST`` entries and joined by shuffle beyond it.

Defined results: a null text counts as empty; a null id loses against every other id; of rows that agree in text and id one
stays; an empty table gives an empty table; further columns are not read by ``exact_groups`` and kept by ``exact_dedup``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ascii_lower, stored

PREFIX = 32
HOT_ROWS = 512
HOT_BYTES = 16 << 20
HOT_LIST = 100_000  # most fingerprints, and most groups, that are broadcast
BUCKETS = 64


def normalised(text: Column) -> Column:
    return ascii_lower(F.coalesce(text, F.lit("")))


def _listed(rows: DataFrame, listed: DataFrame, on: list[str], short: bool) -> DataFrame:
    """Left join with a list that has a key once. A short list is broadcast; a long one is joined by shuffle, and as many rows may
    share a key, they are dealt over ``BUCKETS`` copies of its entry by their id."""
    if short:
        return rows.join(F.broadcast(listed), on, "left")
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(BUCKETS)).cast("int"))
    copies = listed.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(BUCKETS - 1))))
    return dealt.join(copies, [*on, "bucket"], "left").drop("bucket")


def _salted(rows: DataFrame, hot_rows: int) -> tuple[DataFrame, bool]:
    """Adds heavy and salt; and whether few groups are heavy."""
    counted = rows.groupBy("print").agg(F.count(F.lit(1)).alias("copies"), F.sum(F.octet_length("norm")).alias("held"))
    parts = F.ceil(F.greatest(F.col("copies") / hot_rows, F.col("held") / HOT_BYTES))
    hot = counted.select("print", F.least(parts, F.col("copies")).alias("parts")).filter(F.col("parts") > 1)
    hot = stored(hot, "hot-prints")
    short = hot.count() <= HOT_LIST
    return _listed(rows, hot, ["print"], short).select(
        *rows.columns,
        F.col("parts").isNotNull().alias("heavy"),
        F.coalesce(F.pmod(F.xxhash64("id"), F.col("parts")), F.lit(0)).alias("salt"),
    ), short


def _swept(docs: DataFrame, id_col: str, text_col: str, keep: str, hot_rows: int, carry: list[Column]) -> tuple[DataFrame, bool]:
    """One row per document: the winner and size of its group within its range, and its place there; and whether few groups are heavy."""
    rows = docs.select(docs[id_col].alias("id"), normalised(docs[text_col]).alias("norm"), *carry)
    rows, short = _salted(rows.withColumn("print", F.xxhash64("norm")), hot_rows)
    rows = rows.withColumn("prefix", F.substring("norm", 1, PREFIX)).repartitionByRange("prefix", "print", "salt")
    group = W.partitionBy("prefix", "print", "salt", "norm")
    best = F.max if keep == "max" else F.min
    order = F.col("id").desc_nulls_last() if keep == "max" else F.col("id").asc_nulls_last()
    swept = rows.select(
        "id",
        "print",
        "heavy",
        F.sha2("norm", 256).alias("sha"),
        F.row_number().over(group.orderBy(order)).alias("place"),
        best("id").over(group).alias("best"),
        F.count(F.lit(1)).over(group).alias("n"),
        *[c for c in rows.columns if c == "row"],
    )
    return swept, short


def _hot_groups(swept: DataFrame, keep: str) -> DataFrame:
    """The parts of each hot group put together."""
    best = F.max if keep == "max" else F.min
    heads = swept.filter(F.col("heavy") & (F.col("place") == 1))
    return heads.groupBy("print", "sha").agg(best("best").alias("all_best"), F.sum("n").alias("all_n"))


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", hot_rows: int = HOT_ROWS
) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256 of the normalised text."""
    swept, short = _swept(docs, id_col, text_col, keep, hot_rows, [])
    swept = stored(swept, "exact")
    out = _listed(swept, _hot_groups(swept, keep), ["print", "sha"], short)
    keep_id = F.when(F.col("all_n").isNull(), F.col("best")).otherwise(F.col("all_best"))
    return out.select(
        F.col("id").alias(id_col),
        keep_id.alias("keep_id"),
        F.coalesce("all_n", "n").alias("group_size"),
        ((F.col("place") == 1) & F.col("id").eqNullSafe(keep_id)).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", hot_rows: int = HOT_ROWS
) -> DataFrame:
    """The rows that stay, with the columns they came with."""
    carry = [F.struct(*[docs[c] for c in docs.columns]).alias("row")]
    swept, short = _swept(docs, id_col, text_col, keep, hot_rows, carry)
    heads = stored(swept.filter(F.col("place") == 1), "exact")
    out = _listed(heads, _hot_groups(heads.drop("row"), keep), ["print", "sha"], short)
    out = out.filter(F.col("all_n").isNull() | F.col("id").eqNullSafe(F.col("all_best")))
    return out.select("row.*")
