"""Registration of catalog queries and the tables they derive from the given ones."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ...functions import scalars as S
from ...session import cut_lineage
from ...sizing import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def plain(df: DataFrame) -> DataFrame:
    """Columns in the types both engines share: whole numbers as BIGINT, arrays as comma text."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType, T.BooleanType, T.DecimalType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, T.FloatType):
            c = c.cast("double")
        elif isinstance(f.dataType, T.ArrayType):
            c = F.array_join(c, ",")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return plain(fn(spark, sf_dir))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf: str, name: str, heavy: bool = False) -> DataFrame:
    """A given table; ``heavy`` shares a small file with all cores for costly row-local work."""
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    return spread(df, df.columns[0]) if heavy else df


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    """INT8 vectors of 64 elements with a label 0..9."""
    e = table(spark, sf, "embeddings", heavy=True)
    return e.select(F.col("vec_id").alias("row_id"), "label", F.transform("embedding", S.quantize_int8).alias("vec"))


def image(spark: SparkSession, sf: str, width: int, channels: int) -> DataFrame:
    from ...layouts import to_image

    cells = to_image(vectors(spark, sf).drop("label"), width, channels)
    return cells.withColumn("val", F.col("val").cast("long"))


def ternary_weights(spark: SparkSession, n_in: int = 64, n_out: int = 10) -> DataFrame:
    """A fixed parameter table by formula."""
    return spark.range(n_in * n_out).selectExpr(f"CAST(id DIV {n_out} AS INT) in_idx", f"CAST(id % {n_out} AS INT) out_idx").selectExpr(
        "in_idx", "out_idx", "((in_idx * 7 + out_idx * 13 + in_idx * out_idx) % 3) - 1 AS w"
    )


def step_thresholds(spark: SparkSession, channels: int = 10) -> DataFrame:
    return spark.range(channels * 15).selectExpr(
        "CAST(id DIV 15 AS INT) c", "CAST(id % 15 AS INT) step", "CAST(-112 + 16 * (id % 15) + ((id DIV 15) % 3) AS DOUBLE) t"
    )


def words(spark: SparkSession, sf: str) -> DataFrame:
    """Ordered words per event type."""
    from ...operators.scans import row_numbers

    e = table(spark, sf, "events").select(
        F.col("event_type").alias("stream_id"), "event_id", (F.col("user_id") * 1000003 + F.col("event_id")).alias("word"), "ts"
    )
    return row_numbers(e, ["stream_id"], ["event_id"]).drop("event_id")


def layer_tables(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Twelve layers per model, one model per twelve orders; chain edges plus a skip edge every four."""
    kinds = "array('matmul','threshold','im2col','depthwise','maxpool','add','sumpool','pool','channelwise','upsample','pad','topk')"
    o = table(spark, sf, "orders", heavy=True).selectExpr("o_orderkey DIV 12 AS m", "CAST(o_orderkey % 12 AS INT) AS layer_id")
    sized = o.selectExpr("m", "layer_id", "16 * (1 + layer_id % 8) AS mw", "16 * (1 + (layer_id + m) % 8) AS mh", "4 + m % 5 AS dim")
    attrs = """map('MW', string(mw), 'MH', string(mh), 'vec', string(1 + m % 4), 'C', string(mh), 'H', string(dim), 'W', string(dim),
        'OH', string(dim - 2), 'OW', string(dim - 2), 'kh', '3', 'kw', '3', 'dh', '1', 'dw', '1', 'sh', '1', 'sw', '1', 'steps', '15',
        'labels', string(mw), 'weight_bits', string(2 + m % 3), 'input_bits', string(1 + layer_id % 4), 'acc_bits', string(8 + m % 9),
        'no_activation', string(m % 2), 'batch', '1', 'depthwise', string((m + 1) % 2))"""
    # saved once: a stored map keeps the plans of its readers small
    layers = cut_lineage(sized.selectExpr("concat('m', m) AS model_id", "layer_id", f"element_at({kinds}, layer_id + 1) AS op_type", f"{attrs} AS attrs"))
    edges = o.where("layer_id < 11").selectExpr("m", "layer_id AS src", "layer_id + 1 AS dst").unionByName(
        o.where("layer_id % 4 = 0 AND layer_id < 8").selectExpr("m", "layer_id AS src", "layer_id + 4 AS dst")
    )
    present = o.selectExpr("m", "layer_id AS dst")
    edges = edges.join(present, ["m", "dst"], "left_semi").selectExpr("concat('m', m) AS model_id", "src", "dst")
    return layers, edges


# SQL for the same tables

V = """v AS (SELECT vec_id AS row_id, CAST(label AS BIGINT) AS label, list_transform(embedding, lambda x:
  CAST(greatest(-128, least(127, floor(CAST(x AS DOUBLE) * 127 + 0.5))) AS BIGINT)) AS vec FROM embeddings)"""
Q = V + ",\nq AS (SELECT row_id, label, unnest(range(64)) AS i, unnest(vec) AS x FROM v)"
W = "w AS (SELECT i, o, ((i*7 + o*13 + i*o) % 3) - 1 AS w FROM range(64) a(i), range(10) b(o))"
TH = "th AS (SELECT c, s, -112 + 16*s + (c % 3) AS t FROM range(10) a(c), range(15) b(s))"
ACC = Q + ",\n" + W + ",\nacc AS (SELECT row_id, label, o, CAST(sum(x*w) AS BIGINT) AS acc FROM q JOIN w USING (i) GROUP BY ALL)"
OUT = ACC + ",\n" + TH + """,
scored AS (SELECT row_id, label, o, (SELECT count(*) FROM th WHERE th.c = acc.o AND th.t <= acc.acc) AS y FROM acc)"""


def image_sql(width: int, channels: int) -> str:
    return Q + f""",
px AS (SELECT row_id, i // {width * channels} AS h, (i // {channels}) % {width} AS w, i % {channels} AS c, x AS val FROM q)"""


WORDS = """words AS (SELECT event_type AS stream_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS seq,
  user_id * 1000003 + event_id AS word FROM events)"""

LAYERS = """o AS (SELECT o_orderkey // 12 AS m, o_orderkey % 12 AS l FROM orders),
ly AS (SELECT m, 'm' || m AS model_id, l AS layer_id,
  ['matmul','threshold','im2col','depthwise','maxpool','add','sumpool','pool','channelwise','upsample','pad','topk'][l + 1] AS op,
  16 * (1 + l % 8) AS mw, 16 * (1 + (l + m) % 8) AS mh, 1 + m % 4 AS vec, 4 + m % 5 AS dim, 2 + m % 3 AS wb, 1 + l % 4 AS ib, 8 + m % 9 AS ab,
  m % 2 AS noact FROM o)"""
EDGES = """ed AS (SELECT model_id, src, dst FROM (SELECT m, 'm' || m AS model_id, l AS src, l + 1 AS dst FROM o WHERE l < 11
  UNION ALL SELECT m, 'm' || m, l, l + 4 FROM o WHERE l % 4 = 0 AND l < 8) e WHERE EXISTS (SELECT 1 FROM o WHERE o.m = e.m AND o.l = e.dst))"""


def cycles_sql(pe: str, simd: str) -> str:
    """Cycles of a layer of the ``ly`` table at a given parallelism."""
    return f"""CAST(floor(CASE op
  WHEN 'matmul' THEN (mh / ({pe})::DOUBLE) * (mw / ({simd})::DOUBLE) * vec
  WHEN 'depthwise' THEN mh * 9.0 / ({pe})::DOUBLE / ({simd})::DOUBLE * dim * dim
  WHEN 'threshold' THEN vec * mh / ({pe})::DOUBLE WHEN 'add' THEN vec * mh / ({pe})::DOUBLE WHEN 'channelwise' THEN vec * mh / ({pe})::DOUBLE
  WHEN 'sumpool' THEN vec * mh / ({pe})::DOUBLE + mh / ({pe})::DOUBLE
  WHEN 'pool' THEN mh * 9.0 / ({pe})::DOUBLE * (dim - 2) * (dim - 2)
  WHEN 'maxpool' THEN dim * dim * (1 + 1 / 9.0::DOUBLE)
  WHEN 'im2col' THEN dim * 3 * (mh / ({simd})::DOUBLE) + (dim - 2) * greatest((dim - 2) * 9 * (mh / ({simd})::DOUBLE), dim * (mh / ({simd})::DOUBLE))
  WHEN 'pad' THEN mh / ({simd})::DOUBLE * (dim - 2) * (dim - 2)
  WHEN 'upsample' THEN (dim - 2) * (dim - 2)
  WHEN 'topk' THEN mw / ({pe})::DOUBLE END) AS BIGINT)"""
