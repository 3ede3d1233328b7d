"""Joins, thresholds, top-k, evaluation and set checks."""

from pyspark.sql import functions as F

from ...layouts import to_cells
from ...operators import elementwise as E
from ...operators import evaluation as M
from ...operators import matmul as MM
from ...operators import ranking as R
from ...operators import thresholds as TH
from ...operators.inventory import attr, op_counts
from .base import LAYERS, OUT, Q, V, image, image_sql, layer_tables, query, step_thresholds, table, ternary_weights, vectors


def scores(spark, sf):
    """``(row_id, label, scores)``: threshold counts of ten outputs."""
    v = vectors(spark, sf)
    out = MM.mvau(v, ternary_weights(spark), step_thresholds(spark), (64, 10), 15)
    return out.withColumnRenamed("vec", "scores")


def _lookup_sql(idx: str, extra: str) -> str:
    return f"""WITH {V}, s AS (SELECT row_id, list_sum(vec)::BIGINT AS s FROM v), n AS (SELECT count(*) AS n FROM embeddings),
l AS (SELECT l_linenumber, {idx} AS idx FROM lineitem)
SELECT l_linenumber::BIGINT AS l_linenumber, count(*) AS n, sum(s.s)::BIGINT AS total{extra} FROM l JOIN s ON s.row_id = CASE WHEN idx >= (SELECT n FROM n) THEN 0 ELSE idx END GROUP BY 1"""


@query("j1_lookup_row0", _lookup_sql("l_partkey % (SELECT count(*) + count(*) // 5 FROM embeddings)", ",(count(*) FILTER (idx >= (SELECT n FROM n)))::BIGINT AS n_out_of_range"))
def _(spark, sf):
    emb = vectors(spark, sf).select(F.col("row_id").alias("idx"), "vec")
    n = emb.count()  # a sixth of the indexes lies beyond the table
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % (n + n // 5)).alias("idx"))
    hit = E.lookup(li, "idx", emb, "row0", spread=["l_orderkey"])
    total = F.aggregate("vec", F.lit(0).cast("long"), lambda a, x: a + x)
    return hit.groupBy("l_linenumber").agg(F.count("*").alias("n"), F.sum(total).alias("total"), F.sum("oob").alias("n_out_of_range"))


@query("j1_lookup_checked", _lookup_sql("l_partkey % (SELECT count(*) FROM embeddings)", ""))
def _(spark, sf):
    emb = vectors(spark, sf).select(F.col("row_id").alias("idx"), "vec")
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % emb.count()).alias("idx"))
    hit = E.lookup(li, "idx", emb, spread=["l_orderkey"])
    total = F.aggregate("vec", F.lit(0).cast("long"), lambda a, x: a + x)
    return hit.groupBy("l_linenumber").agg(F.count("*").alias("n"), F.sum(total).alias("total"))


def _pair(spark, sf):
    v = vectors(spark, sf).select("row_id", "vec")
    return v, v.select("row_id", F.transform("vec", lambda x, i: x * 2 + i).alias("vec"))


def _pair_sql(expr: str) -> str:
    return f"WITH {Q} SELECT row_id, string_agg(({expr})::VARCHAR, ',' ORDER BY i) AS vec FROM q GROUP BY row_id"


@query("j2_add_streams", _pair_sql("x + (2 * x + i)"))
def _(spark, sf):
    return E.add_streams(*_pair(spark, sf))


@query("j3_sub_streams", _pair_sql("x - (2 * x + i)"))
def _(spark, sf):
    return E.eltwise(*_pair(spark, sf), "sub")


@query("j3_absdiff_streams", _pair_sql("abs(x - (2 * x + i))"))
def _(spark, sf):
    return E.eltwise(*_pair(spark, sf), "absdiff")


@query(
    "j4_concat_streams",
    f"""WITH {Q} SELECT row_id, string_agg(x::VARCHAR, ',' ORDER BY i) || ',' || string_agg((2*x+i)::VARCHAR, ',' ORDER BY i) || ',' || string_agg(x::VARCHAR, ',' ORDER BY i) AS vec
FROM q GROUP BY row_id""",
)
def _(spark, sf):
    a, b = _pair(spark, sf)
    return E.concat_streams([a, b, a])


_CHANNEL = {"add": "val + (c * 3 - 4)", "mul": "val * (c * 3 - 4)", "cmp_le": "(val <= c * 3 - 4)::BIGINT", "cmp_ge": "(val >= c * 3 - 4)::BIGINT"}


def _channelwise(func):
    def run(spark, sf):
        params = spark.range(4).selectExpr("CAST(id AS INT) c", "id * 3 - 4 AS p")
        return E.channelwise(image(spark, sf, 4, 4), params, func)

    return run


for _func, _expr in _CHANNEL.items():
    query(f"j5_channelwise_{_func}", f"WITH {image_sql(4, 4)} SELECT row_id, h, w, c, {_expr} AS val FROM px")(_channelwise(_func))


@query(
    "j6_multi_threshold",
    f"""WITH {image_sql(4, 4)}, t AS (SELECT c, -112 + 16*s + (c % 3) AS t FROM range(4) a(c), range(15) b(s))
SELECT row_id, h, w, c, (SELECT count(*) FROM t WHERE t.c = px.c AND t <= val) - 8 AS val FROM px""",
)
def _(spark, sf):
    out = TH.multi_threshold(image(spark, sf, 4, 4), step_thresholds(spark, 4), 1, -8)
    return out


@query("j6_threshold_bipolar", f"WITH {image_sql(4, 4)} SELECT row_id, h, w, c, (CASE WHEN val >= 3 THEN 1 ELSE -1 END)::BIGINT AS val FROM px")
def _(spark, sf):
    shared = spark.range(1).selectExpr("0 AS step", "3.0D AS t")
    return TH.multi_threshold(image(spark, sf, 4, 4), shared, 2, -1, channel=None)


@query(
    "j6_threshold_range_count",
    """WITH rows AS (SELECT o_custkey % 3 AS c, o_totalprice AS v, 1 AS cell, o_orderkey FROM orders
  UNION ALL SELECT l_linenumber % 3, l_extendedprice * 3, 0, NULL FROM lineitem),
run AS (SELECT *, sum(1 - cell) OVER (PARTITION BY c ORDER BY v, cell ROWS UNBOUNDED PRECEDING) AS n FROM rows)
SELECT o_orderkey AS row_id, c, v AS val, n::BIGINT AS reached FROM run WHERE cell = 1""",
)
def _(spark, sf):
    cells = table(spark, sf, "orders").selectExpr("o_orderkey AS row_id", "o_custkey % 3 AS c", "o_totalprice AS val")
    steps = table(spark, sf, "lineitem").selectExpr("l_linenumber % 3 AS c", "l_extendedprice * 3 AS t")
    return TH.range_count(cells, steps)


@query(
    "j6_threshold_many_steps",
    """WITH p AS (SELECT l_orderkey AS row_id, ((l_linenumber - 1) % 7)::BIGINT AS c, CAST(floor(l_extendedprice) AS BIGINT) AS val FROM lineitem)
SELECT row_id, c, val, greatest(0, least(2000, (val - 900 - c) // 50 + 1)) AS y FROM p""",
)
def _(spark, sf):
    cells = table(spark, sf, "lineitem", heavy=True).selectExpr("l_orderkey AS row_id", "(l_linenumber - 1) % 7 AS c", "CAST(floor(l_extendedprice) AS BIGINT) AS val", "CAST(floor(l_extendedprice) AS BIGINT) AS x")
    steps = spark.range(7 * 2000).selectExpr("CAST(id DIV 2000 AS INT) c", "CAST(id % 2000 AS INT) step", "CAST(900 + id DIV 2000 + 50 * (id % 2000) AS DOUBLE) t")
    out = TH.multi_threshold_wide(cells, steps)
    return out.select("row_id", "c", F.col("x").alias("val"), F.col("val").alias("y"))


@query(
    "j7_golden_compare",
    f"""WITH {Q}, e AS (SELECT row_id, i, x::DOUBLE AS e FROM q), g AS (SELECT row_id, i, x + CASE WHEN row_id % 7 = 0 AND i = 5 THEN 0.5 ELSE 0.0005 END::DOUBLE AS g FROM q WHERE NOT (row_id % 11 = 3 AND i = 9))
SELECT row_id, count(*) AS n_cells, (count(*) FILTER (NOT coalesce(abs(e - g) <= 0.001::DOUBLE + 0.00001::DOUBLE * abs(g), false)))::BIGINT AS n_bad,
CASE WHEN count(*) FILTER (NOT coalesce(abs(e - g) <= 0.001::DOUBLE + 0.00001::DOUBLE * abs(g), false)) = 0 THEN 'SUCCESS' ELSE 'FAIL' END AS status
FROM e FULL JOIN g USING (row_id, i) GROUP BY row_id""",
)
def _(spark, sf):
    cells = to_cells(vectors(spark, sf).drop("label"))
    shift = F.when((F.col("row_id") % 7 == 0) & (F.col("i") == 5), 0.5).otherwise(0.0005)
    got = cells.withColumn("val", F.col("val") + shift).where("NOT (row_id % 11 = 3 AND i = 9)")
    return M.compare(cells.withColumn("val", F.col("val").cast("double")), got)


@query(
    "j7_golden_reshaped",
    f"""WITH {Q}, e AS (SELECT row_id, i, x::DOUBLE AS e FROM q), g AS (SELECT row_id, i, x + CASE WHEN row_id % 5 = 0 AND i = 37 THEN 0.5 ELSE 0.0005 END::DOUBLE AS g FROM q WHERE NOT (row_id % 13 = 3 AND i = 63)),
c AS (SELECT row_id, coalesce(abs(e - g) <= 0.001::DOUBLE + 0.00001::DOUBLE * abs(g), false) AS near FROM e FULL JOIN g USING (row_id, i))
SELECT row_id, count(*) AS n_cells, count(*) FILTER (NOT near) AS n_bad, CASE WHEN bool_and(near) THEN 'SUCCESS' ELSE 'FAIL' END AS status FROM c GROUP BY row_id""",
)
def _(spark, sf):
    """Images of 4 by 4 by 4 against the vectors they are flattened to."""
    golden = image(spark, sf, 4, 4).withColumn("val", F.col("val").cast("double"))
    shift = F.when((F.col("row_id") % 5 == 0) & (F.col("i") == 37), 0.5).otherwise(0.0005)
    got = to_cells(vectors(spark, sf).drop("label")).withColumn("val", F.col("val") + shift).where("NOT (row_id % 13 = 3 AND i = 63)")
    return M.compare_reshaped(golden, got, {"h": 4, "w": 4, "c": 4}, {"i": 64})


@query("j8_duplicate", f"WITH {V} SELECT copy, count(*) AS n, sum(list_sum(vec))::BIGINT AS total FROM v, range(3) r(copy) GROUP BY copy")
def _(spark, sf):
    copies = E.tee(vectors(spark, sf), 3)
    total = F.sum(F.aggregate("vec", F.lit(0).cast("long"), lambda a, x: a + x)).alias("total")
    out = None
    for i, c in enumerate(copies):
        one = c.agg(F.count("*").alias("n"), total).withColumn("copy", F.lit(i))
        out = one if out is None else out.unionByName(one)
    return out


@query("j9_name_labels", "SELECT s_suppkey, s_nationkey::BIGINT AS label, n_name AS name FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey")
def _(spark, sf):
    names = table(spark, sf, "nation").select(F.col("n_nationkey").alias("label"), F.col("n_name").alias("name"))
    return E.name_labels(table(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").alias("label")), names)


def _top(order: str) -> str:
    return f"""WITH {OUT}, r AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY y DESC, {order}) AS rn FROM scored)
SELECT row_id, string_agg(o::VARCHAR, ',' ORDER BY rn) AS top FROM r WHERE rn <= 5 GROUP BY row_id"""


@query("k1_label_select", _top("o"))
def _(spark, sf):
    return scores(spark, sf).select("row_id", R.label_select(F.col("scores"), 5).alias("top"))


@query("k1_label_select_cells", f"WITH {OUT} SELECT row_id, o AS out_idx, acc, row_number() OVER (PARTITION BY row_id ORDER BY acc DESC, o) AS rank FROM acc QUALIFY rank <= 3")
def _(spark, sf):
    acc = MM.matmul(vectors(spark, sf), ternary_weights(spark), (64, 10)).select("row_id", F.posexplode("vec").alias("out_idx", "acc"))
    return R.label_select_cells(acc, 3)


@query("k2_topk_argsort", _top("o DESC"))
def _(spark, sf):
    return scores(spark, sf).select("row_id", R.topk_argsort(F.col("scores"), 5).alias("top"))


@query("k3_verify_topk", f"WITH {V} SELECT row_id, 1::BIGINT AS low_ok, 1::BIGINT AS high_ok, (list_max(vec) = vec[1])::BIGINT AS first_ok FROM v")
def _(spark, sf):
    s = scores(spark, sf).join(vectors(spark, sf).select("row_id", "vec"), "row_id")
    x = F.col("scores")
    return s.select(
        "row_id",
        R.verify_topk(x, R.label_select(x, 5), 5).alias("low_ok"),
        R.verify_topk(x, R.topk_argsort(x, 5), 5).alias("high_ok"),
        R.verify_topk(F.col("vec"), F.array(F.lit(0)), 1).alias("first_ok"),
    )


@query("k3_verify_changed", f"WITH {V} SELECT row_id, (list_slice(list_reverse_sort(vec), 1, 2) = list_reverse_sort([list_max(vec), vec[row_id % 64 + 1]]))::BIGINT AS ok FROM v")
def _(spark, sf):
    """The second index is one that depends on the row, and so is right in few rows."""
    vec = F.col("vec")
    chosen = F.array(F.element_at(R.label_select(vec, 1), 1).cast("long"), F.col("row_id") % 64)
    return vectors(spark, sf).select("row_id", R.verify_topk(vec, chosen, 2).cast("long").alias("ok"))


@query("k4_rank_by", "SELECT event_type, count(*) AS n, row_number() OVER (ORDER BY count(*), event_type) AS rank FROM events GROUP BY 1")
def _(spark, sf):
    n = table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return R.rank_by(n, "n", ["event_type"])


@query("k5_sample_by_class", "SELECT event_type, event_id FROM events ORDER BY event_type, event_id LIMIT 100")
def _(spark, sf):
    return R.sample_items(table(spark, sf, "events").select("event_type", "event_id"), 100, False, "event_type", "event_id")


@query(
    "k5_sample_interleaved",
    "SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS rn FROM events) ORDER BY rn, event_type LIMIT 103",
)
def _(spark, sf):
    return R.sample_items(table(spark, sf, "events").select("event_type", "event_id"), 103, True, "event_type", "event_id")


_PRED = f"""WITH {OUT}, r AS (SELECT row_id, label, o, row_number() OVER (PARTITION BY row_id ORDER BY y DESC, o) AS rn FROM scored),
p AS (SELECT row_id, label, o AS predicted FROM r WHERE rn = 1)"""


def predictions(spark, sf):
    return scores(spark, sf).select("row_id", "label", F.element_at(R.label_select(F.col("scores"), 1), 1).alias("predicted"))


@query("m1_accuracy", _PRED + " SELECT count(*) FILTER (predicted = label) AS ok, count(*) FILTER (predicted <> label) AS nok, count(*) FILTER (predicted = label) * 100.0::DOUBLE / count(*) AS accuracy FROM p")
def _(spark, sf):
    return M.accuracy(predictions(spark, sf))


@query(
    "m1_batch_accuracy",
    _PRED
    + """, b AS (SELECT * FROM p WHERE row_id // 64 < (SELECT count(*) // 64 FROM p))
SELECT count(*) FILTER (predicted = label) AS ok, count(*) FILTER (predicted <> label) AS nok, count(*) FILTER (predicted = label) * 100.0::DOUBLE / count(*) AS accuracy,
(SELECT count(*) FROM p) - count(*) AS dropped FROM b""",
)
def _(spark, sf):
    return M.batch_accuracy(predictions(spark, sf), 64, "row_id", dense=True)


_HITS = f"""WITH {OUT}, r AS (SELECT row_id, label, o, row_number() OVER (PARTITION BY row_id ORDER BY y DESC, o DESC) AS rn FROM scored),
h AS (SELECT row_id, (max((rn = 1 AND o = label)::INT))::BIGINT AS t1, (max((rn <= 5 AND o = label)::INT))::BIGINT AS tk FROM r GROUP BY row_id)"""


@query("m2_topk_accuracy", _HITS + " SELECT count(*) AS n, sum(t1)::BIGINT AS top1, sum(tk)::BIGINT AS topk, sum(t1) * 100.0::DOUBLE / count(*) AS top1_pct, sum(tk) * 100.0::DOUBLE / count(*) AS topk_pct FROM h")
def _(spark, sf):
    return M.topk_accuracy(scores(spark, sf), 5)


@query("m2_running_topk", _HITS + " SELECT row_id, row_id + 1 AS n, (sum(t1) OVER (ORDER BY row_id))::BIGINT AS top1, (sum(tk) OVER (ORDER BY row_id))::BIGINT AS topk FROM h")
def _(spark, sf):
    return M.running_topk_accuracy(scores(spark, sf), 5, "row_id")


@query(
    "m3_running_accuracy",
    """WITH b AS (SELECT event_id // 100 AS batch_id, event_id, (user_id % 5 = length(event_type) % 5)::INT AS hit FROM events),
g AS (SELECT batch_id, sum(hit) AS ok, count(*) AS n FROM b GROUP BY 1)
SELECT batch_id, (sum(ok) OVER (ORDER BY batch_id))::BIGINT AS ok, (sum(n - ok) OVER (ORDER BY batch_id))::BIGINT AS nok FROM g""",
)
def _(spark, sf):
    p = table(spark, sf, "events").selectExpr("event_id DIV 100 AS batch_id", "user_id % 5 AS predicted", "length(event_type) % 5 AS label")
    return M.running_accuracy(p)


@query(
    "m5_verify_stages",
    f"""WITH {Q}, s AS (SELECT 'exact' AS stage, row_id, count(*) AS n_cells, 0 AS n_bad FROM q GROUP BY row_id
UNION ALL SELECT 'shifted', row_id, count(*), count(*) FILTER (row_id % 5 = 0) FROM q GROUP BY row_id)
SELECT stage, CASE WHEN max(n_bad) = 0 THEN 'SUCCESS' ELSE 'FAIL' END AS result, count(*) AS n_items FROM s GROUP BY stage""",
)
def _(spark, sf):
    rows = vectors(spark, sf).drop("label")
    moved = rows.withColumn("vec", F.transform("vec", lambda x: x + F.when(F.col("row_id") % 5 == 0, 1).otherwise(0)))
    return M.overall(M.verify_stages({"exact": (rows, rows), "shifted": (rows, moved)}))


@query("m6_within_tolerance", "SELECT l_linenumber::BIGINT AS l_linenumber, avg_price, max_price, (abs(max_price - avg_price) < abs(max_price) * 0.5)::BIGINT AS within FROM (SELECT l_linenumber, round(avg(l_extendedprice), 4) AS avg_price, max(l_extendedprice) AS max_price FROM lineitem GROUP BY 1)")
def _(spark, sf):
    p = table(spark, sf, "lineitem").groupBy("l_linenumber").agg(F.round(F.avg("l_extendedprice"), 4).alias("avg_price"), F.max("l_extendedprice").alias("max_price"))
    return M.within(p, "avg_price", "max_price", 0.5)


@query(
    "u2_report_differences",
    f"""WITH {LAYERS}, e AS (SELECT model_id, layer_id, mw AS value FROM ly), g AS (SELECT model_id, layer_id + (layer_id = 11)::INT AS layer_id, mw + (layer_id = 3)::INT AS value FROM ly)
SELECT model_id, layer_id, coalesce(e.value, -1)::BIGINT AS expected, coalesce(g.value, -1)::BIGINT AS got,
CASE WHEN g.value IS NULL THEN 'missing' WHEN e.value IS NULL THEN 'unexpected' ELSE 'different' END AS reason
FROM e FULL JOIN g USING (model_id, layer_id) WHERE e.value IS DISTINCT FROM g.value""",
)
def _(spark, sf):
    layers, _edges = layer_tables(spark, sf)
    e = layers.select("model_id", "layer_id", attr("MW").alias("value"))
    g = e.select("model_id", (F.col("layer_id") + (F.col("layer_id") == 11).cast("int")).alias("layer_id"), (F.col("value") + (F.col("layer_id") == 3).cast("int")).alias("value"))
    d = M.report_differences(e, g, ["model_id", "layer_id"])
    return d.withColumn("expected", F.coalesce("expected", F.lit(-1))).withColumn("got", F.coalesce("got", F.lit(-1)))


def _config(spark, sf):
    return table(spark, sf, "part").selectExpr("concat('m', p_partkey DIV 4) AS model_id", "CAST(p_partkey % 4 * 4 AS INT) AS layer_id", "'PE' AS name", "string(p_size) AS value")


_CONFIG = "cf AS (SELECT 'm' || (p_partkey // 4) AS model_id, p_partkey % 4 * 4 AS layer_id, p_size FROM part)"


@query("u3_apply_config", f"WITH {LAYERS}, {_CONFIG} SELECT ly.model_id, ly.layer_id, coalesce(p_size, 1)::BIGINT AS pe, mw FROM ly LEFT JOIN cf USING (model_id, layer_id)")
def _(spark, sf):
    layers, _edges = layer_tables(spark, sf)
    return M.apply_config(layers, _config(spark, sf)).select("model_id", "layer_id", attr("PE").alias("pe"), attr("MW").alias("mw"))


@query("u3_unmatched_config", f"WITH {LAYERS}, {_CONFIG} SELECT model_id, layer_id, 'PE' AS name, p_size::VARCHAR AS value FROM cf WHERE NOT EXISTS (SELECT 1 FROM ly WHERE ly.model_id = cf.model_id AND ly.layer_id = cf.layer_id)")
def _(spark, sf):
    return M.unmatched_config(layer_tables(spark, sf)[0], _config(spark, sf))


def report_metrics(spark, sf):
    return op_counts(layer_tables(spark, sf)[0])
