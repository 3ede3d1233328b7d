"""Jobs on parameter tables of many models."""

from pyspark.sql import functions as F

from ...operators import parameters as P
from .base import Q, query, table, vectors

KEYS = "'m' || (row_id // 16) AS model_id, (row_id % 16) // 4 AS layer_id, row_id % 4 AS channel"
BASE = Q + f""",
wt AS (SELECT {KEYS}, i AS in_idx, x AS w FROM q),
tt AS (SELECT {KEYS}, i AS step, i * 3 + x * 0.25::DOUBLE AS t FROM q),
ml AS (SELECT {KEYS}, ((row_id * 7) % 9 - (row_id % 16 < 4)::INT) / 4.0::DOUBLE AS val FROM v),
ad AS (SELECT {KEYS}, (row_id % 5) * 0.5::DOUBLE AS val FROM v),
ty AS (SELECT DISTINCT 'm' || (row_id // 16) AS model_id, (row_id % 16) // 4 AS layer_id FROM v),
tr AS (SELECT model_id, layer_id, CASE WHEN layer_id % 2 = 0 THEN 0 ELSE -8 END AS x_min, CASE WHEN layer_id % 2 = 0 THEN 15 ELSE 7 END AS x_max FROM ty)"""


def _keys(df):
    return df.withColumn("model_id", F.expr("concat('m', row_id DIV 16)")).withColumn("layer_id", F.expr("CAST(row_id % 16 DIV 4 AS INT)")).withColumn("channel", F.expr("CAST(row_id % 4 AS INT)"))


def weights(spark, sf):
    return _keys(vectors(spark, sf)).select("model_id", "layer_id", F.col("channel").alias("out_idx"), F.posexplode("vec").alias("in_idx", "w"))


def thresholds(spark, sf):
    cells = _keys(vectors(spark, sf)).select("model_id", "layer_id", "channel", F.posexplode("vec").alias("step", "x"))
    return cells.select("model_id", "layer_id", "channel", "step", (F.col("step") * 3 + F.col("x") * 0.25).alias("t"))


def muls(spark, sf):
    return _keys(vectors(spark, sf)).select("model_id", "layer_id", "channel", F.expr("((row_id * 7) % 9 - int(row_id % 16 < 4)) / 4.0D AS val"))


def adds(spark, sf):
    return _keys(vectors(spark, sf)).select("model_id", "layer_id", "channel", F.expr("(row_id % 5) * 0.5D AS val"))


def types(spark, sf):
    t = _keys(vectors(spark, sf)).select("model_id", "layer_id").distinct()
    return t.selectExpr(
        "model_id", "layer_id", "if(layer_id % 2 = 0, 0, -8) AS x_min", "if(layer_id % 2 = 0, 15, 7) AS x_max", "-128 AS w_min", "127 AS w_max", "layer_id = 2 AS runtime", "layer_id = 3 AS last"
    )


def spec(spark, sf):
    return table(spark, sf, "part").selectExpr(
        "concat('m', p_partkey DIV 8) AS model_id",
        "CAST(p_partkey % 8 AS INT) AS layer_id",
        "0 AS channel",
        "element_at(array('relu','identity','selu','bipolar'), CAST(p_partkey % 4 AS INT) + 1) AS kind",
        "1 + p_size % 10 AS bits",
        "p_partkey % 4 IN (1, 3) AND p_partkey % 23 <> 0 OR p_partkey % 19 = 0 AS signed",
        "p_partkey % 4 = 1 AND p_size % 2 = 0 OR p_partkey % 29 = 0 AS narrow",
        "if(p_partkey % 17 = 0, 1.0D, 0.0D) AS zero_point",
        "if(p_partkey % 4 = 3 AND p_partkey % 3 <> 0, 1.0D, p_retailprice / 10000) AS scale",
    )


SPEC = """sp AS (SELECT 'm' || (p_partkey // 8) AS model_id, p_partkey % 8 AS layer_id, 0::BIGINT AS channel,
  ['relu','identity','selu','bipolar'][p_partkey % 4 + 1] AS kind, 1 + p_size % 10 AS bits,
  (p_partkey % 4 IN (1, 3) AND p_partkey % 23 <> 0) OR p_partkey % 19 = 0 AS signed,
  (p_partkey % 4 = 1 AND p_size % 2 = 0) OR p_partkey % 29 = 0 AS narrow,
  CASE WHEN p_partkey % 17 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS zero_point,
  CASE WHEN p_partkey % 4 = 3 AND p_partkey % 3 <> 0 THEN 1.0::DOUBLE ELSE p_retailprice / 10000 END AS scale FROM part)"""

_REASON = """CASE WHEN zero_point <> 0 THEN 'zero point is not 0' WHEN kind IN ('relu', 'selu') AND signed THEN 'signed output on an unsigned activation'
  WHEN kind IN ('relu', 'selu') AND narrow THEN 'narrow range on an unsigned activation' WHEN kind = 'identity' AND NOT signed THEN 'unsigned identity'
  WHEN kind = 'bipolar' AND scale <> 1 THEN 'bipolar needs scale 1' END"""


def _supported(spark, sf):
    s = spec(spark, sf)
    bad = P.validate_quant_spec(s).select("model_id", "layer_id")
    return P.convertible(s).join(bad, ["model_id", "layer_id"], "left_anti")


@query(
    "p1_derive_thresholds",
    f"""WITH {SPEC}, ok AS (SELECT *, CASE WHEN kind = 'bipolar' OR (kind = 'identity' AND bits = 1) THEN 1 WHEN kind = 'identity' AND narrow THEN (1 << bits) - 2 ELSE (1 << bits) - 1 END AS n
  FROM sp WHERE {_REASON} IS NULL AND bits <= 8),
st AS (SELECT *, unnest(range(n)) AS step, abs(scale) AS s FROM ok),
u AS (SELECT *, -1.0::DOUBLE + s / 2 + s * step AS u, -s / 2 - s * (n // 2 - 1) - CASE WHEN narrow THEN 0 ELSE s END AS first FROM st)
SELECT model_id, layer_id, channel, step, round(CASE WHEN kind = 'bipolar' OR (kind = 'identity' AND bits = 1) THEN 0.0 WHEN kind = 'relu' THEN s / 2 + s * step WHEN kind = 'identity' THEN first + s * step
  WHEN u <= 0 THEN ln(CASE WHEN u <= 0 THEN u / ({P.SELU_ALPHA}::DOUBLE * {P.SELU_LAMBDA}::DOUBLE) + 1 ELSE 1 END) ELSE u / {P.SELU_LAMBDA}::DOUBLE END, 6) AS t FROM u""",
)
def _(spark, sf):
    return P.derive_thresholds(_supported(spark, sf)).withColumn("t", F.round("t", 6))


_BIAS = "CASE WHEN kind IN ('relu', 'selu') THEN 0.0 WHEN kind = 'bipolar' OR bits = 1 THEN -0.5 WHEN narrow THEN -(pow(2, bits - 1) - 1) ELSE -pow(2, bits - 1) END::DOUBLE"


@query(
    "p2_bias_scale",
    f"WITH {SPEC}, b AS (SELECT *, {_BIAS} AS bias, CASE WHEN kind = 'bipolar' THEN abs(scale) * 2 ELSE abs(scale) END AS out_scale FROM sp) SELECT model_id, layer_id, channel, bias, out_scale, bias * out_scale AS out_bias FROM b",
)
def _(spark, sf):
    return P.act_bias_scale(spec(spark, sf))


@query("p3_reject_specs", f"WITH {SPEC} SELECT model_id, layer_id, {_REASON} AS reason FROM sp WHERE {_REASON} IS NOT NULL")
def _(spark, sf):
    return P.validate_quant_spec(spec(spark, sf)).select("model_id", "layer_id", "reason")


@query("p4_convertible", f"WITH {SPEC} SELECT model_id, layer_id, kind, bits::BIGINT AS bits FROM sp WHERE bits <= 8")
def _(spark, sf):
    return P.convertible(spec(spark, sf)).select("model_id", "layer_id", "kind", "bits")


@query("p5_fold_weights", f"WITH {BASE} SELECT model_id, layer_id, channel AS out_idx, in_idx, CAST(round_even(w / (CASE WHEN channel % 2 = 0 THEN 2.0 ELSE 0.5 END)::DOUBLE, 0) AS BIGINT) AS w_int FROM wt")
def _(spark, sf):
    w = weights(spark, sf)
    scales = _keys(vectors(spark, sf)).select("model_id", "layer_id", F.col("channel").alias("out_idx"), F.expr("if(channel % 2 = 0, 2.0D, 0.5D) AS scale"))
    return P.fold_weights(w.withColumn("q", F.col("w").cast("double")), scales).select("model_id", "layer_id", "out_idx", "in_idx", "w_int")


@query("p6_absorb_add", f"WITH {BASE} SELECT model_id, layer_id, channel, step, t - val AS t FROM tt JOIN ad USING (model_id, layer_id, channel)")
def _(spark, sf):
    return P.absorb_add(thresholds(spark, sf), adds(spark, sf))


@query(
    "p7_absorb_mul",
    f"""WITH {BASE}, okl AS (SELECT model_id, layer_id FROM ml GROUP BY 1, 2 HAVING min(val) > 0)
SELECT model_id, layer_id, channel, step, CASE WHEN okl.model_id IS NOT NULL THEN t / CASE WHEN val = 0 THEN 1 ELSE val END ELSE t END AS t FROM tt JOIN ml USING (model_id, layer_id, channel) LEFT JOIN okl USING (model_id, layer_id)""",
)
def _(spark, sf):
    return P.absorb_mul(thresholds(spark, sf), muls(spark, sf))


@query("p8_split_sign", f"WITH {BASE} SELECT model_id, layer_id, channel, val, sign(val)::BIGINT AS sign, abs(val) AS magnitude FROM ml")
def _(spark, sf):
    return P.split_sign(muls(spark, sf))


@query("p9_absorb_sign", f"WITH {BASE} SELECT model_id, layer_id, channel AS out_idx, in_idx, w * sign(val)::BIGINT AS w FROM wt JOIN ml USING (model_id, layer_id, channel)")
def _(spark, sf):
    return P.absorb_sign(weights(spark, sf), P.split_sign(muls(spark, sf)))


@query(
    "p10_collapse_affine",
    f"""WITH {BASE}, x AS (SELECT model_id, layer_id, wt.channel * 16 + in_idx // 4 AS channel, w * 0.25::DOUBLE AS val, in_idx % 4 AS pos FROM wt),
p AS (SELECT model_id, layer_id, channel, max(val) FILTER (pos = 0) AS a0, max(val) FILTER (pos = 1) AS m1, max(val) FILTER (pos = 2) AS a2, max(val) FILTER (pos = 3) AS m3 FROM x GROUP BY 1, 2, 3)
SELECT model_id, layer_id, channel, 1.0::DOUBLE * m1 * m3 + 0 AS mul, ((0.0::DOUBLE + a0) * m1 + a2) * m3 + 0 AS "add" FROM p""",
)
def _(spark, sf):
    chain = weights(spark, sf).selectExpr("model_id", "layer_id", "out_idx * 16 + in_idx DIV 4 AS channel", "in_idx % 4 AS pos", "if(in_idx % 2 = 0, 'add', 'mul') AS op", "w * 0.25D AS val")
    out = P.collapse_affine(chain)
    return out.withColumn("mul", F.col("mul") + 0).withColumn("add", F.col("add") + 0)


@query("p11_push_affine", f"WITH {BASE} SELECT model_id, layer_id, channel AS out_idx, 0.5::DOUBLE AS mul, (layer_id - 1) * 0.25::DOUBLE * sum(w)::BIGINT + 0 AS \"add\" FROM wt GROUP BY model_id, layer_id, channel")
def _(spark, sf):
    affine = types(spark, sf).selectExpr("model_id", "layer_id", "0.5D AS mul", "(layer_id - 1) * 0.25D AS add")
    return P.push_affine_past_matmul(affine, weights(spark, sf)).withColumn("add", F.col("add") + 0)


@query(
    "p12_round_thresholds",
    f"""WITH {BASE} SELECT model_id, layer_id, channel, step, greatest(x_min - 1, least(x_max + 1, CASE WHEN x_min >= 0 THEN greatest(ceil(t)::BIGINT, 0) ELSE ceil(t)::BIGINT END))::BIGINT AS t
FROM tt JOIN tr USING (model_id, layer_id)""",
)
def _(spark, sf):
    rng = types(spark, sf).selectExpr("model_id", "layer_id", "x_min AS type_min", "x_max AS type_max")
    return P.round_thresholds(thresholds(spark, sf), rng)


_TYPE = """CASE WHEN {lo} >= 0 THEN (SELECT CASE WHEN min(b) <= 1 THEN 'BINARY' ELSE 'UINT' || min(b) END FROM range(65) r(b) WHERE {hi} + 1 <= pow(2, b))
  ELSE (SELECT 'INT' || min(b) FROM range(1, 65) r(b) WHERE -pow(2, b - 1) <= {lo} AND {hi} <= pow(2, b - 1) - 1) END"""


@query(
    "p13_absorb_out_bias",
    f"""WITH {BASE}, a AS (SELECT model_id, layer_id, layer_id * 1.5::DOUBLE - 3 AS val FROM ty), b AS (SELECT model_id, layer_id, 15 AS steps, 1.0::DOUBLE AS out_scale, -2.0 + val AS out_bias FROM ty JOIN a USING (model_id, layer_id)),
c AS (SELECT *, out_bias AS lo, out_bias + 15 AS hi FROM b)
SELECT model_id, layer_id, steps::BIGINT AS steps, out_scale, out_bias::DOUBLE AS out_bias, CASE WHEN lo = floor(lo) THEN {_TYPE.format(lo="lo", hi="hi")} ELSE 'FLOAT32' END AS out_type FROM c""",
)
def _(spark, sf):
    t = types(spark, sf).select("model_id", "layer_id")
    layers = t.selectExpr("*", "15 AS steps", "1.0D AS out_scale", "-2.0D AS out_bias")
    return P.absorb_out_bias(layers, t.selectExpr("*", "layer_id * 1.5D - 3 AS val"))


@query(
    "p14_validate_thresholds",
    f"""WITH {BASE}, d AS (SELECT *, t < lag(t) OVER (PARTITION BY model_id, layer_id, channel ORDER BY step) AS down FROM tt),
g AS (SELECT model_id, layer_id, channel, count(*) FILTER (down) AS n_descending, count(*) AS n_steps, count(*) FILTER (t < 0) AS n_negative, count(*) FILTER (t <> floor(t)) AS n_fractional FROM d GROUP BY 1, 2, 3)
SELECT model_id, layer_id, channel, n_descending, n_steps, n_negative, n_fractional FROM g WHERE n_descending > 2 * layer_id OR n_steps <> 64 OR (layer_id % 2 = 0 AND n_negative > 0) OR n_descending > 0""",
)
def _(spark, sf):
    steps = types(spark, sf).selectExpr("model_id", "layer_id", "64 AS steps", "layer_id % 2 = 0 AS unsigned")
    return P.validate_thresholds(thresholds(spark, sf), steps, integral=False).drop("steps", "unsigned")


@query("p15_tile_channels", f"WITH {BASE} SELECT model_id, tt.layer_id * 4 + tt.channel AS layer_id, k AS channel, step, t FROM tt, range(8) r(k)")
def _(spark, sf):
    one_row = thresholds(spark, sf).withColumn("layer_id", F.col("layer_id") * 4 + F.col("channel")).drop("channel")
    return P.tile_channels(one_row, 8).select("model_id", "layer_id", "channel", "step", "t")


_WIDTH = """(CASE WHEN {lo} >= 0 THEN (SELECT greatest(min(b), 1) FROM range(65) r(b) WHERE {hi} + 1 <= pow(2, b))
  ELSE (SELECT min(b) + 1 FROM range(65) r(b) WHERE greatest(-{lo}, {hi} + 1) <= pow(2, b)) END)"""


@query(
    "a8_accumulator_width",
    f"""WITH {BASE}, s AS (SELECT model_id, layer_id, channel, sum(least(w * x_min, w * x_max)) AS lo, sum(greatest(w * x_min, w * x_max)) AS hi,
  least(sum(least(-128 * x_min, -128 * x_max)), sum(least(127 * x_min, 127 * x_max))) AS rlo, greatest(sum(greatest(-128 * x_min, -128 * x_max)), sum(greatest(127 * x_min, 127 * x_max))) AS rhi
  FROM wt JOIN tr USING (model_id, layer_id) GROUP BY 1, 2, 3),
l AS (SELECT model_id, layer_id, CASE WHEN layer_id = 2 THEN min(rlo) ELSE min(lo) END::BIGINT AS acc_min, CASE WHEN layer_id = 2 THEN max(rhi) ELSE max(hi) END::BIGINT AS acc_max FROM s GROUP BY 1, 2),
h AS (SELECT model_id, layer_id, min(t) AS tmin, max(t) AS tmax FROM tt GROUP BY 1, 2)
SELECT model_id, layer_id, acc_min, acc_max, CASE WHEN layer_id = 3 THEN (({_WIDTH.format(lo="acc_min", hi="acc_max")} + 7) // 8) * 8 ELSE {_WIDTH.format(lo="acc_min", hi="acc_max")} END::BIGINT AS width,
  (acc_min < 0)::BIGINT AS signed, (tmax > acc_max OR tmin < acc_min)::BIGINT AS thresholds_clipped FROM l JOIN h USING (model_id, layer_id)""",
)
def _(spark, sf):
    return P.min_accumulator(weights(spark, sf), types(spark, sf), thresholds(spark, sf))


@query("a8_clip_thresholds", f"WITH {BASE} SELECT model_id, layer_id, channel, step, greatest(x_min, least(x_max, t))::DOUBLE AS t FROM tt JOIN tr USING (model_id, layer_id)")
def _(spark, sf):
    return P.clip_thresholds(thresholds(spark, sf), types(spark, sf).selectExpr("model_id", "layer_id", "double(x_min) AS acc_min", "double(x_max) AS acc_max"))


def _sign_rule(lo: str, hi: str) -> str:
    below = f"(CASE WHEN abs({lo}) > {hi} THEN {lo} ELSE -{hi} - 1 END)"
    return f"CASE WHEN {lo} < 0 THEN {_TYPE.format(lo=below, hi=below)} ELSE {_TYPE.format(lo=hi, hi=hi)} END"


@query("a9_weight_width", f"WITH {BASE}, r AS (SELECT model_id, layer_id, min(w) AS w_min, max(w) AS w_max FROM wt GROUP BY 1, 2) SELECT model_id, layer_id, w_min, w_max, {_sign_rule('w_min', 'w_max')} AS w_type FROM r")
def _(spark, sf):
    return P.min_weight_width(weights(spark, sf))


@query(
    "a10_threshold_type",
    f"""WITH {BASE}, r AS (SELECT model_id, layer_id, least(min(ceil(t)), any_value(x_min))::BIGINT AS lo, greatest(max(ceil(t)), any_value(x_max))::BIGINT AS hi FROM tt JOIN tr USING (model_id, layer_id) GROUP BY 1, 2)
SELECT model_id, layer_id, lo, hi, {_sign_rule("lo", "hi")} AS t_type, 1::BIGINT AS integral FROM r""",
)
def _(spark, sf):
    rng = types(spark, sf).selectExpr("model_id", "layer_id", "x_min AS type_min", "x_max AS type_max")
    return P.min_threshold_type(thresholds(spark, sf).withColumn("t", F.ceil("t").cast("double")), rng)
