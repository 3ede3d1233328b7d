"""Layer inventory of many models, derived from orders."""

from pyspark.sql import functions as F

from ...operators import inventory as C
from .base import EDGES, LAYERS, cycles_sql, layer_tables, query, table

_COUNTS = """cnt AS (
SELECT model_id, layer_id, 'op_mac_' || least(ib, wb) || 'bx' || greatest(ib, wb) || 'b' AS metric, (mw * mh * vec)::DOUBLE AS value FROM ly WHERE op = 'matmul'
UNION ALL SELECT model_id, layer_id, 'param_weight_' || wb || 'b', mw * mh FROM ly WHERE op = 'matmul'
UNION ALL SELECT model_id, layer_id, 'param_threshold_' || ab || 'b', mh FROM ly WHERE op = 'matmul' AND noact = 0
UNION ALL SELECT model_id, layer_id, 'op_mac_' || least(ib, wb) || 'bx' || greatest(ib, wb) || 'b', 9 * mh * dim * dim FROM ly WHERE op = 'depthwise'
UNION ALL SELECT model_id, layer_id, 'param_weight_' || wb || 'b', 9 * mh FROM ly WHERE op = 'depthwise'
UNION ALL SELECT model_id, layer_id, 'param_threshold_' || ab || 'b', mh FROM ly WHERE op = 'depthwise' AND noact = 0
UNION ALL SELECT model_id, layer_id, 'param_threshold_' || wb || 'b', mh * 15 FROM ly WHERE op = 'threshold')"""


@query("c1_op_counts", f"WITH {LAYERS}, {_COUNTS} SELECT model_id, layer_id, metric, value FROM cnt")
def _(spark, sf):
    return C.op_counts(layer_tables(spark, sf)[0])


@query("c2_totals", f"WITH {LAYERS}, {_COUNTS} SELECT model_id, metric, sum(value) AS value FROM cnt GROUP BY 1, 2")
def _(spark, sf):
    counts = C.op_counts(layer_tables(spark, sf)[0])
    noise = counts.withColumn("metric", F.lit("efficiency_pct")).withColumn("value", F.lit(50.0))
    return C.totals(counts.unionByName(noise))


@query("c2_layers_and_totals", f"WITH {LAYERS}, {_COUNTS} SELECT model_id, coalesce(layer_id, -1) AS layer_id, metric, sum(value) AS value FROM cnt GROUP BY GROUPING SETS ((model_id, layer_id, metric), (model_id, metric))")
def _(spark, sf):
    out = C.layers_and_totals(C.op_counts(layer_tables(spark, sf)[0]))
    return out.withColumn("layer_id", F.coalesce("layer_id", F.lit(-1)))


_CYC = f"cy AS (SELECT *, {cycles_sql('1', '1')} AS cycles FROM ly)"


@query("c3_cycles", f"WITH {LAYERS}, {_CYC} SELECT model_id, layer_id, op AS op_type, cycles FROM cy")
def _(spark, sf):
    return C.cycles(layer_tables(spark, sf)[0]).drop("attrs")


@query(
    "c4_performance",
    f"""WITH RECURSIVE {LAYERS}, {EDGES}, {_CYC},
walk AS (SELECT model_id, layer_id, cycles AS path FROM cy
  UNION ALL SELECT walk.model_id, cy.layer_id, walk.path + cy.cycles FROM walk JOIN ed ON ed.model_id = walk.model_id AND ed.src = walk.layer_id JOIN cy ON cy.model_id = ed.model_id AND cy.layer_id = ed.dst),
cp AS (SELECT model_id, max(path) AS p FROM walk GROUP BY 1),
mx AS (SELECT model_id, max(cycles) AS c FROM cy GROUP BY 1)
SELECT model_id, c AS max_cycles, (SELECT min(layer_id) FROM cy WHERE cy.model_id = mx.model_id AND cy.cycles = c) AS max_cycles_layer, p AS critical_path_cycles,
  round(1e9::DOUBLE / 10.0::DOUBLE / c, 6) AS items_per_s, p * 10.0::DOUBLE AS latency_ns FROM mx JOIN cp USING (model_id)""",
)
def _(spark, sf):
    layers, edges = layer_tables(spark, sf)
    return C.performance(C.cycles(layers), edges, 10.0).withColumn("items_per_s", F.round("items_per_s", 6))


_PRIMS = ", ".join(f"({i}, '{n}', {w}, {d})" for i, (n, (w, d)) in enumerate(C.MEMORY_PRIMITIVES.items()))


@query(
    "c5_memory_fit",
    f"""WITH r AS (SELECT p_partkey AS request, p_size::BIGINT AS width, 64 * (1 + p_partkey % 200) AS depth FROM part),
f AS (SELECT request, width, depth, ord, name AS primitive, (((width + pw - 1) // pw) * ((depth + pd - 1) // pd))::BIGINT AS count, pw * pd AS cap FROM r, (VALUES {_PRIMS}) p(ord, name, pw, pd))
SELECT request, width, depth, primitive, count, round((width * depth) / (count * cap)::DOUBLE, 9) AS efficiency, count * cap - width * depth AS waste,
  row_number() OVER (PARTITION BY request ORDER BY count * cap - width * depth, ord) AS rank FROM f""",
)
def _(spark, sf):
    r = table(spark, sf, "part").selectExpr("p_partkey AS request", "bigint(p_size) AS width", "64 * (1 + p_partkey % 200) AS depth")
    return C.memory_fit(r).withColumn("efficiency", F.round("efficiency", 9))


TARGET = 2000


def _pass(name: str, source: str, target: str) -> str:
    at = cycles_sql
    return f"""{name}a AS (SELECT *, {target} AS tgt, list_filter(range(1, mw + 1), lambda d: mw % d = 0) AS opts FROM {source}),
{name}b AS (SELECT *, list_filter(opts, lambda d: {at('1', 'd')} < tgt OR wb * d > 36)[1] AS stop FROM {name}a),
{name}c AS (SELECT *, CASE WHEN op <> 'matmul' THEN 1 WHEN stop IS NULL THEN mw WHEN {at('1', 'stop')} < tgt THEN stop ELSE coalesce(list_filter(opts, lambda d: d < stop)[-1], 1) END AS s1,
  CASE WHEN op IN ('matmul', 'add', 'channelwise', 'sumpool', 'threshold', 'depthwise', 'pool') THEN mh WHEN op = 'topk' THEN mw END AS lim FROM {name}b),
{name}d AS (SELECT *, CASE WHEN lim IS NULL THEN 1 ELSE coalesce(list_filter(range(1, lim + 1), lambda d: lim % d = 0 AND {at('d', 's1')} < tgt)[1], lim) END AS pe FROM {name}c),
{name}e AS (SELECT *, CASE WHEN op = 'matmul' THEN s1
  WHEN op = 'depthwise' THEN CASE WHEN pe = mh AND {at('pe', '1')} > tgt THEN coalesce(list_filter([1, 3, 9], lambda d: {at('pe', 'd')} < tgt)[1], 9) ELSE 1 END
  WHEN op = 'pad' OR (op = 'im2col' AND m % 2 = 1) THEN coalesce(list_filter(range(1, mh + 1), lambda d: mh % d = 0 AND {at('pe', 'd')} < tgt)[1], mh) ELSE 1 END AS s2 FROM {name}d),
{name}f AS (SELECT x.*, CASE WHEN x.op = 'im2col' AND y.pe IS NOT NULL THEN y.pe ELSE x.s2 END AS simd FROM {name}e x
  LEFT JOIN {name}e y ON y.model_id = x.model_id AND y.layer_id = x.layer_id + 1 AND y.op IN ('depthwise', 'pool')),
{name} AS (SELECT m, model_id, layer_id, op, mw, mh, vec, dim, wb, ib, ab, noact, pe, simd, {at('pe', 'simd')} AS cycles FROM {name}f)"""


@query(
    "c6_sweep",
    f"""WITH {LAYERS}, {_pass("p1", "ly", str(TARGET))}, g AS (SELECT model_id, greatest(max(cycles), {TARGET}) AS goal FROM p1 GROUP BY 1),
l2 AS (SELECT ly.*, goal FROM ly JOIN g USING (model_id)), {_pass("p2", "l2", "goal")}
SELECT model_id, layer_id, op AS op_type, pe::BIGINT AS "PE", simd::BIGINT AS "SIMD", cycles FROM p2""",
)
def _(spark, sf):
    layers, edges = layer_tables(spark, sf)
    return C.sweep(layers, TARGET, edges).drop("attrs")
