"""Matrix products and accumulations."""

import numpy as np
from pyspark.sql import functions as F

from ...functions import scalars as S
from ...layouts import to_cells
from ...operators import evaluation, features, ranking
from ...operators import matmul as MM
from ...operators import spatial as N
from .base import ACC, OUT, Q, W, image, image_sql, query, step_thresholds, table, ternary_weights, vectors


@query("a1_matmul_dense", f"WITH {ACC} SELECT row_id, o AS out_idx, acc FROM acc")
def _(spark, sf):
    out = MM.matmul(vectors(spark, sf).select("row_id", "vec"), ternary_weights(spark), (64, 10))
    return out.select("row_id", F.posexplode("vec").alias("out_idx", "acc"))


@query("a1_matmul_cells", f"WITH {ACC} SELECT row_id, o AS out_idx, acc FROM acc")
def _(spark, sf):
    return MM.matmul_cells(to_cells(vectors(spark, sf).drop("label")), ternary_weights(spark))


@query("a1_matmul_block_product", f"WITH {ACC} SELECT row_id, o AS out_idx, acc FROM acc")
def _(spark, sf):
    rows = vectors(spark, sf).select(F.col("row_id").alias("_row"), "vec")
    sums = MM.block_sums(rows, ternary_weights(spark), (64, 10), side=16, together=2048)
    cells = sums.select(F.col("_row").alias("row_id"), "ob", F.posexplode("val").alias("o", "acc"))
    return cells.select("row_id", (F.col("ob") * 16 + F.col("o")).alias("out_idx"), F.col("acc").cast("long").alias("acc"))


@query("a1_matmul_strips", f"WITH {ACC} SELECT row_id, o AS out_idx, acc FROM acc")
def _(spark, sf):
    return MM.matmul_blocks(vectors(spark, sf), ternary_weights(spark), 10, block=8)


@query(
    "a2_xnor_popcount",
    f"""WITH {Q}, {W.replace("((i*7 + o*13 + i*o) % 3) - 1", "2 * ((i*7 + o*13 + i*o) % 2) - 1")}
SELECT row_id, o AS out_idx, (sum((CASE WHEN x >= 0 THEN 1 ELSE -1 END) * w)::BIGINT + 64) // 2 AS acc FROM q JOIN w USING (i) GROUP BY row_id, o""",
)
def _(spark, sf):
    v = vectors(spark, sf).select("row_id", F.transform("vec", S.sign_bipolar).alias("vec"))
    w = ternary_weights(spark).withColumn("w", F.expr("2 * ((in_idx * 7 + out_idx * 13 + in_idx * out_idx) % 2) - 1"))
    return MM.xnor_matmul(v, w, 64)


@query("a3_matmul_threshold", f"WITH {OUT} SELECT row_id, o AS out_idx, y FROM scored")
def _(spark, sf):
    out = MM.mvau(vectors(spark, sf).select("row_id", "vec"), ternary_weights(spark), step_thresholds(spark), (64, 10), 15)
    return out.select("row_id", F.posexplode("vec").alias("out_idx", "y"))


@query(
    "a3_layer_chain",
    f"""WITH {OUT}, w2 AS (SELECT i, o, ((i*5 + o*11 + i*o) % 3) - 1 AS w FROM range(10) a(i), range(6) b(o)),
s2 AS (SELECT row_id, w2.o AS o, CAST(sum((y - 8) * w) AS BIGINT) AS acc FROM scored JOIN w2 ON w2.i = scored.o GROUP BY 1, 2)
SELECT row_id, o AS out_idx, (CASE WHEN acc >= 0 THEN 1 ELSE -1 END)::BIGINT AS y FROM s2""",
)
def _(spark, sf):
    w1 = MM.weight_matrix(ternary_weights(spark), (64, 10))
    t1 = MM.threshold_matrix(step_thresholds(spark), 10, 15)
    second = spark.range(60).selectExpr("CAST(id DIV 6 AS INT) i", "CAST(id % 6 AS INT) o").selectExpr("i AS in_idx", "o AS out_idx", "((i*5 + o*11 + i*o) % 3) - 1 AS w")
    zero = spark.range(6).selectExpr("CAST(id AS INT) c", "0 AS step", "0.0D AS t")
    layers = [(w1, t1, 1, -8), (MM.weight_matrix(second, (10, 6)), MM.threshold_matrix(zero, 6, 1), 2, -1)]
    out = MM.dense_layers(vectors(spark, sf).select("row_id", "vec"), layers)
    return out.select("row_id", F.posexplode("vec").alias("out_idx", "y"))


def flagship(spark, sf):
    """Quantize, multiply, threshold, pick the label, measure accuracy per label."""
    out = MM.mvau(vectors(spark, sf), ternary_weights(spark), step_thresholds(spark), (64, 10), 15)
    top = out.select("row_id", "label", F.element_at(ranking.label_select(F.col("vec"), 1), 1).alias("predicted"))
    return evaluation.accuracy(top, by=["label"])


@query(
    "flagship_scoring",
    f"""WITH {OUT}, r AS (SELECT row_id, label, o, row_number() OVER (PARTITION BY row_id ORDER BY y DESC, o) AS rn FROM scored)
SELECT label, count(*) FILTER (o = label) AS ok, count(*) FILTER (o <> label) AS nok, count(*) FILTER (o = label) * 100.0::DOUBLE / count(*) AS accuracy FROM r WHERE rn = 1 GROUP BY label""",
)
def _(spark, sf):
    return flagship(spark, sf)


def mlp_layers():
    """A fixed 600-64-64-64-1 chain of small weights and 2-bit activations, as matrices by formula."""
    sizes, layers = [600, 64, 64, 64, 1], []
    for n, (a, b) in enumerate(zip(sizes, sizes[1:])):
        i, o = np.arange(a)[:, None], np.arange(b)[None, :]
        w = ((i * (7 + n) + o * 13 + i * o) % 3 - 1).astype(float)
        steps = np.array([[-8.0, 0.0, 8.0]]) + np.arange(b)[:, None] % 3 if b > 1 else np.zeros((1, 1))
        layers.append((w, steps, 1, -1) if b > 1 else (w, steps, 2, -1))
    return layers


MLP_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linenumber", "l_partkey", "l_suppkey"]


@query("mlp_flow_scoring")
def _(spark, sf):
    """Feature job on lineitem, bits padded to 600, scored by the chain against ``l_linestatus``."""
    li = table(spark, sf, "lineitem", heavy=True).withColumn("label", F.when(F.col("l_linestatus") == "O", 1).otherwise(-1))
    bits, _width = features.feature_job(li, MLP_COLUMNS, keep=["label"], as_text=True)
    out = MM.dense_layers(bits, mlp_layers(), "bits", bipolar_bits=True)
    return evaluation.accuracy(out.select("label", F.element_at("bits", 1).alias("predicted")), by=["label"])


def _taps(spark, kh, kw, channels, bipolar=False):
    raw = spark.range(channels * kh * kw).selectExpr(f"CAST(id DIV {kh * kw} AS INT) c", f"CAST(id DIV {kw} % {kh} AS INT) kh", f"CAST(id % {kw} AS INT) kw")
    value = "2 * ((c + kh + kw) % 2) - 1" if bipolar else "(c * 5 + kh * 3 + kw * 7) % 5 - 2"
    return raw.selectExpr("c", "kh", "kw", f"CAST({value} AS INT) AS w")


def windows_sql(size: int, k: int, s: int = 1, d: int = 1) -> str:
    """Windows of the ``px`` cells of a square image."""
    n = (size - (d * (k - 1) + 1)) // s + 1
    return f"""win AS (SELECT row_id, oh, ow, kh, kw, c, val FROM range({n}) a(oh), range({n}) b(ow), range({k}) e(kh), range({k}) f(kw), px
  WHERE h = oh * {s} + kh * {d} AND w = ow * {s} + kw * {d})"""


@query(
    "a4_depthwise",
    f"""WITH {image_sql(4, 4)}, {windows_sql(4, 3)} SELECT row_id, oh, ow, c, sum(val * ((c*5 + kh*3 + kw*7) % 5 - 2))::BIGINT AS val FROM win GROUP BY row_id, oh, ow, c""",
)
def _(spark, sf):
    return N.depthwise2d(image(spark, sf, 4, 4), _taps(spark, 3, 3, 4), (4, 4), (3, 3))


@query(
    "a4_depthwise_bipolar",
    f"""WITH {image_sql(4, 4)}, {windows_sql(4, 3)} SELECT row_id, oh, ow, c, (sum((CASE WHEN val >= 0 THEN 1 ELSE -1 END) * (2 * ((c + kh + kw) % 2) - 1))::BIGINT + 9) // 2 AS val FROM win GROUP BY row_id, oh, ow, c""",
)
def _(spark, sf):
    signs = image(spark, sf, 4, 4).withColumn("val", S.sign_bipolar(F.col("val")))
    return N.depthwise2d(signs, _taps(spark, 3, 3, 4, True), (4, 4), (3, 3), bipolar_width=9)


@query(
    "a4_depthwise_threshold",
    f"""WITH {image_sql(4, 4)}, {windows_sql(4, 3)}, s AS (SELECT row_id, oh, ow, c, sum(val * ((c*5 + kh*3 + kw*7) % 5 - 2))::BIGINT AS x FROM win GROUP BY row_id, oh, ow, c),
t AS (SELECT c, -112 + 16*s + (c % 3) AS t FROM range(4) a(c), range(15) b(s))
SELECT row_id, oh, ow, c, (SELECT count(*) FROM t WHERE t.c = s.c AND t <= x) - 8 AS val FROM s""",
)
def _(spark, sf):
    return N.depthwise2d(image(spark, sf, 4, 4), _taps(spark, 3, 3, 4), (4, 4), (3, 3), thresholds=step_thresholds(spark, 4), out_bias=-8)


@query("a5_global_sum_pool", f"WITH {image_sql(4, 4)} SELECT row_id, c, sum(val)::BIGINT AS val FROM px GROUP BY row_id, c")
def _(spark, sf):
    return N.global_acc_pool(image(spark, sf, 4, 4))


@query("a6_max_pool", f"WITH {image_sql(8, 1)} SELECT row_id, h // 2 AS h, w // 2 AS w, c, max(val) AS val FROM px GROUP BY row_id, h // 2, w // 2, c")
def _(spark, sf):
    return N.max_pool(image(spark, sf, 8, 1), (2, 2), (8, 8))


@query("a6_max_pool_1d_ceil", f"WITH {Q} SELECT row_id, 0::BIGINT AS h, i // 5 AS w, 0::BIGINT AS c, max(x) AS val FROM q GROUP BY row_id, i // 5")
def _(spark, sf):
    return N.max_pool(image(spark, sf, 64, 1), (1, 5), (1, 64), ceil_mode=True)


@query("a6_max_pool_1d", f"WITH {Q} SELECT row_id, 0::BIGINT AS h, i // 5 AS w, 0::BIGINT AS c, max(x) AS val FROM q WHERE i < 60 GROUP BY row_id, i // 5")
def _(spark, sf):
    return N.max_pool(image(spark, sf, 64, 1), (1, 5), (1, 64))


@query("a7_window_max_pool", f"WITH {image_sql(8, 1)}, {windows_sql(8, 3)} SELECT row_id, oh, ow, c, max(val) AS val FROM win GROUP BY row_id, oh, ow, c")
def _(spark, sf):
    return N.pool(N.im2col(image(spark, sf, 8, 1), (8, 8), (3, 3)), "max", 3)


@query(
    "a7_quant_avg_pool",
    f"WITH {image_sql(8, 1)}, {windows_sql(8, 3)} SELECT row_id, oh, ow, c, sum(val + 128)::BIGINT >> {N.quant_avg_shift(3, 8, 4)} AS val FROM win GROUP BY row_id, oh, ow, c",
)
def _(spark, sf):
    shifted = image(spark, sf, 8, 1).withColumn("val", F.col("val") + 128)
    return N.pool(N.im2col(shifted, (8, 8), (3, 3)), "quantavg", 3, 8, 4)
