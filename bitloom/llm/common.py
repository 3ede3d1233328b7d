"""Small helpers the operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bitloom.session import scratch_path

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read again: cuts the lineage and outlives executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. ``lower`` does just that where every character is one byte, and is faster there."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower())
    )


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


HOT_ROWS = 4096
HOT_KEYS = 10_000  # at most so many keys are hot, which bounds what is broadcast


def salted_join(rows: DataFrame, params: DataFrame, on: list[str], n: str, spread: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Rows that have their keys in ``params``, with its columns; ``params`` has a key once and says in ``n`` how many rows have it.

    A key with more than ``hot_rows`` rows, or a ``HOT_KEYS``-th of all rows if that is more, is dealt over several tasks by a salt from the columns of ``spread``."""
    limit = max(hot_rows, -(-(params.agg(F.sum(n)).first()[0] or 0) // HOT_KEYS))
    salts = F.ceil(F.col(n) / limit).cast("int")
    hot = F.broadcast(params.filter(F.col(n) > limit).select(*on, salts.alias("salts")))
    salt = F.pmod(F.xxhash64(*spread), F.coalesce("salts", F.lit(1))).cast("int")
    dealt = rows.join(hot, on, "left").withColumn("salt", salt).drop("salts")
    copies = params.withColumn("salt", F.explode(F.sequence(F.lit(0), F.greatest(salts, F.lit(1)) - 1)))
    return dealt.join(copies, [*on, "salt"]).drop("salt")
