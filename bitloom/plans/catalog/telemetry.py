"""Frames, traces, throughput and buffer sizing on events and orders."""

from pyspark.sql import Observation
from pyspark.sql import functions as F

from ...functions.scalars import clock_micros
from ...operators import integrity as I
from ...operators import telemetry as V
from ...session import cut_lineage, saved
from .base import WORDS, query, table, words

_FOLD = "xor(xor({v} & 8388607, ({v} >> 23) & 8388607), ({v} >> 46) & 8388607)"


def terms_sql(n: int, k: int, bits: int, source: str = "words") -> str:
    w = bits // k
    terms = " + ".join(f"((seq % {n} * {k} + {j}) % 3 + 1) * " + _FOLD.format(v=f"((word >> {j * w}) & {(1 << w) - 1 if w < 63 else 9223372036854775807})") for j in range(k))
    return f"SELECT stream_id, seq // {n} AS frame, ({terms}) % 16777216 AS term FROM {source}"


CHECKSUM = "(frame % 256) * 16777216 + (sum(term) % 16777216)::BIGINT"


def checksum_sql(n: int, k: int, bits: int) -> str:
    return f"WITH {WORDS}, t AS ({terms_sql(n, k, bits)})\nSELECT stream_id, frame, {CHECKSUM} AS checksum FROM t GROUP BY 1, 2 HAVING count(*) = {n}"


@query("e1_frame_checksum", checksum_sql(16, 1, 64))
def _(spark, sf):
    return I.frame_checksum(words(spark, sf), 16)


@query("e1_frame_checksum_subwords", checksum_sql(10, 4, 32))
def _(spark, sf):
    w = words(spark, sf).withColumn("word", F.col("word").bitwiseAND(F.lit((1 << 32) - 1)))
    return I.frame_checksum(w, 10, 4, 32)


@query("e2_checksum_drained", checksum_sql(32, 2, 64))
def _(spark, sf):
    _none, sums = I.checksum_tap(words(spark, sf), 32, 2, 64, drain=True)
    return sums


@query("e3_mark_frames", f"WITH {WORDS} SELECT stream_id, seq, word, ((seq + 1) % 12 = 0)::BIGINT AS last FROM words")
def _(spark, sf):
    return I.mark_frames(words(spark, sf), 0, default=12).drop("ts")


@query("e3_strip_marks", f"WITH {WORDS} SELECT stream_id, seq, word FROM words")
def _(spark, sf):
    return I.mark_frames(I.mark_frames(words(spark, sf), 12), 12, direction="in").drop("ts")


def trace(spark, sf):
    e = table(spark, sf, "events")
    first = table(spark, sf, "events").agg(F.min(clock_micros(F.col("ts")))).scalar()
    kind = F.when(F.col("event_type").isin("purchase", "view"), "TVALID").otherwise("TREADY")
    t = F.floor((clock_micros(F.col("ts")) - first) / 1000000) * 20
    raw = e.select(F.concat(F.lit("u"), "user_id", F.lit("_"), kind).alias("signal"), t.alias("t"), "event_id")
    # a recorded trace is a stored table that is read more than once
    return cut_lineage(raw.groupBy("signal", "t").agg((F.max("event_id") % 2).alias("val")))


TRACE = """tr AS (SELECT 'u' || user_id || '_' || CASE WHEN event_type IN ('purchase', 'view') THEN 'TVALID' ELSE 'TREADY' END AS signal,
  (epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events)) // 1000000 * 20 AS t, max(event_id) % 2 AS val FROM events GROUP BY 1, 2),
both_if AS (SELECT left(signal, length(signal) - 6) AS iface FROM tr GROUP BY 1 HAVING count(DISTINCT right(signal, 6)) = 2)"""
STATS = TRACE + """,
ev AS (SELECT left(signal, length(signal) - 6) AS iface, substr(right(signal, 6), 2, 1) AS kind, t, val, 0 AS mark FROM tr),
ev2 AS (SELECT * FROM ev WHERE iface IN (SELECT iface FROM both_if)),
allev AS (SELECT * FROM ev2 UNION ALL SELECT iface, k, (SELECT max(t) FROM ev2), 0, 1 FROM both_if, (VALUES ('V'), ('R')) x(k)),
st AS (SELECT iface, (t - lag(t, 1, 0) OVER w) // 20 AS n,
  coalesce(last_value(CASE WHEN kind = 'V' THEN val END IGNORE NULLS) OVER (PARTITION BY iface ORDER BY t, (kind = 'R')::INT, mark ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS v,
  coalesce(last_value(CASE WHEN kind = 'R' THEN val END IGNORE NULLS) OVER (PARTITION BY iface ORDER BY t, (kind = 'R')::INT, mark ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS r
  FROM allev WINDOW w AS (PARTITION BY iface ORDER BY t, (kind = 'R')::INT, mark)),
stats AS (SELECT iface, a AS v, b AS r, coalesce(sum(n) FILTER (v = a AND r = b), 0)::BIGINT AS n, coalesce(sum(n) FILTER (v = a AND r = b), 0) / sum(n)::DOUBLE AS fraction
  FROM st, range(2) x(a), range(2) y(b) GROUP BY 1, 2, 3)"""


@query("v1_interface_stats", f"WITH {STATS} SELECT iface, v, r, n, fraction FROM stats")
def _(spark, sf):
    return V.interface_stats(V.interface_events(trace(spark, sf)))


@query("v2_rank_interfaces", f"WITH {STATS} SELECT iface, v, r, n, fraction, row_number() OVER (ORDER BY fraction, iface) AS rank FROM stats WHERE v = 1 AND r = 0")
def _(spark, sf):
    return V.rank_interfaces(V.interface_stats(V.interface_events(trace(spark, sf))))


@query("s8_list_interfaces", f"WITH {TRACE} SELECT iface FROM both_if")
def _(spark, sf):
    return V.list_interfaces(trace(spark, sf).select("signal"))


_QUEUES = """qs AS (SELECT 'top.StreamingFIFO_' || l_suppkey || '.' || CASE WHEN l_linenumber % 2 = 0 THEN 'count' ELSE 'level' END AS signal, l_quantity::BIGINT - 49 AS val FROM lineitem)"""


def queues(spark, sf):
    return table(spark, sf, "lineitem").selectExpr("concat('top.StreamingFIFO_', l_suppkey, '.', if(l_linenumber % 2 = 0, 'count', 'level')) AS signal", "bigint(l_quantity) - 49 AS val")


@query("s8_list_queue_counters", f"WITH {_QUEUES} SELECT DISTINCT signal FROM qs WHERE contains(signal, 'count')")
def _(spark, sf):
    return V.list_queue_counters(queues(spark, sf))


@query("v3_peak_fill", f"WITH {_QUEUES} SELECT signal, greatest(max(val), 0) AS peak FROM qs GROUP BY 1")
def _(spark, sf):
    return V.peak_fill(queues(spark, sf))


PERIOD = 48
FLOW = f"""tx AS (SELECT DISTINCT user_id AS id, event_type IN ('click', 'view') AS p, (event_id * 7) % {PERIOD} AS cycle FROM events),
ids AS (SELECT DISTINCT id, p FROM tx),
one AS (SELECT id, p, t, (SELECT count(*) FROM tx WHERE tx.id = ids.id AND tx.p = ids.p AND cycle <= t) AS level FROM ids, range({PERIOD}) r(t)),
tot AS (SELECT id, p, max(level) AS total FROM one GROUP BY 1, 2),
fl AS (SELECT id, p, t + k * {PERIOD} AS t, level + k * total AS level FROM one JOIN tot USING (id, p), range(2) r(k))"""


def transfers(spark, sf, producer: bool):
    side = "IN" if producer else "NOT IN"
    return table(spark, sf, "events").where(f"event_type {side} ('click', 'view')").selectExpr("user_id AS edge_id", f"event_id * 7 % {PERIOD} AS cycle")


@query("v4_cumulative_flow", f"WITH {FLOW} SELECT id AS stream_id, t, level FROM fl WHERE p")
def _(spark, sf):
    return V.cumulative_flow(transfers(spark, sf, True).withColumnRenamed("edge_id", "stream_id"), PERIOD)


DEPTH = FLOW + f""",
pr AS (SELECT id, t, level FROM fl WHERE p), cn AS (SELECT id, t, level FROM fl WHERE NOT p),
bad AS (SELECT DISTINCT cn.id, s FROM cn JOIN range({PERIOD}) r(s) ON cn.t < {PERIOD} - s JOIN pr ON pr.id = cn.id AND pr.t = cn.t + s WHERE pr.level < cn.level),
sh AS (SELECT x.id, coalesce((SELECT min(s) FROM range({PERIOD}) r(s) WHERE NOT EXISTS (SELECT 1 FROM bad WHERE bad.id = x.id AND bad.s = r.s)), {PERIOD - 1}) AS shift
  FROM (SELECT id FROM pr INTERSECT SELECT id FROM cn) x),
dp AS (SELECT sh.id, any_value(shift) AS shift, max(pr.level - cn.level) AS depth FROM sh JOIN cn ON cn.id = sh.id AND cn.t < {PERIOD} JOIN pr ON pr.id = sh.id AND pr.t = cn.t + shift GROUP BY 1)"""


def depths(spark, sf):
    return V.transfer_depth(transfers(spark, sf, True), transfers(spark, sf, False), PERIOD)


@query("v5_buffer_depth", f"WITH {DEPTH} SELECT id AS edge_id, shift::BIGINT AS shift, depth FROM dp")
def _(spark, sf):
    return depths(spark, sf)


@query(
    "v6_round_depth",
    f"WITH {DEPTH}, e AS (SELECT DISTINCT c_custkey AS id FROM customer), d AS (SELECT e.id, coalesce(depth, 32) AS depth FROM e LEFT JOIN dp USING (id)) SELECT id AS edge_id, CASE WHEN depth <= 2 THEN 2 WHEN depth <= 32 THEN 32 ELSE depth END::BIGINT AS depth FROM d",
)
def _(spark, sf):
    edges = table(spark, sf, "customer").select(F.col("c_custkey").alias("edge_id")).distinct()
    return V.edge_depths(edges, depths(spark, sf)).select("edge_id", V.round_depth(F.col("depth")).alias("depth"))


@query(
    "e9_throughput",
    """WITH r AS (SELECT l_linenumber, sum(l_quantity) AS n, sum(l_tax + 0.01) AS t, sum(l_quantity * 75) AS bi, sum(l_quantity) AS bo FROM lineitem GROUP BY 1)
SELECT l_linenumber::BIGINT AS l_linenumber, n AS batch_size, round(t * 1000, 3) AS runtime_ms, round(n / t, 3) AS items_per_s, round(bi * 0.000001 / t, 6) AS mb_in_per_s, round(bo * 0.000001 / t, 6) AS mb_out_per_s FROM r""",
)
def _(spark, sf):
    runs = table(spark, sf, "lineitem").selectExpr("l_linenumber", "l_quantity AS n_items", "l_tax + 0.01D AS runtime_s", "l_quantity * 75 AS bytes_in", "l_quantity AS bytes_out")
    out = V.throughput(runs, ("l_linenumber",))
    for c, digits in (("runtime_ms", 3), ("items_per_s", 3), ("mb_in_per_s", 6), ("mb_out_per_s", 6)):
        out = out.withColumn(c, F.round(c, digits))
    return out


@query(
    "e10_steady_state",
    """WITH r AS (SELECT c_custkey AS run_id, CAST(pow(8, c_custkey % 4) AS BIGINT) AS batch, 1000 + c_custkey % 50 AS first, 1000 + c_custkey % 50 + (CAST(pow(8, c_custkey % 4) AS BIGINT) - 1) * (40 + c_custkey % 7) AS cycles FROM customer)
SELECT run_id, batch, cycles, first AS latency_cycles, round(batch / ((CASE WHEN batch = 1 THEN cycles ELSE cycles - first END) * 10.0::DOUBLE * 0.000000001::DOUBLE), 3) AS stable_items_per_s FROM r""",
)
def _(spark, sf):
    c = table(spark, sf, "customer").selectExpr("c_custkey AS run_id", "bigint(pow(8, c_custkey % 4)) AS b", "1000 + c_custkey % 50 AS first", "40 + c_custkey % 7 AS step")
    both = c.selectExpr("run_id", "explode(array_distinct(array(1L, b))) AS batch", "first", "step")
    runs = both.selectExpr("run_id", "batch", "first + (batch - 1) * step AS cycles", "10.0D AS clk_ns")
    out = V.steady_state(runs)
    return out.select("run_id", "batch", "cycles", "latency_cycles", F.round("stable_items_per_s", 3).alias("stable_items_per_s"))


@query(
    "e11_batch_regression",
    """WITH r AS (SELECT c_nationkey AS run_group, pow(8, c_custkey % 5) AS x, 2.5 + 0.031 * pow(8, c_custkey % 5) + c_custkey % 3 AS y FROM customer)
SELECT run_group::BIGINT AS run_group, round(regr_intercept(y, x), 5) AS overhead_ms, round(regr_slope(y, x), 8) AS ms_per_item, count(*) AS n_runs FROM r GROUP BY 1""",
)
def _(spark, sf):
    runs = table(spark, sf, "customer").selectExpr("c_nationkey AS run_group", "pow(8, c_custkey % 5) AS batch", "2.5D + 0.031D * pow(8, c_custkey % 5) + c_custkey % 3 AS runtime_ms")
    out = V.batch_regression(runs)
    return out.withColumn("overhead_ms", F.round("overhead_ms", 5)).withColumn("ms_per_item", F.round("ms_per_item", 8))


_ALTERED = f"""{WORDS}, altered AS (SELECT stream_id, seq, word + CASE WHEN seq % 97 = 5 THEN 1 ELSE 0 END AS word FROM words),
t AS ({terms_sql(16, 1, 64)}), u AS ({terms_sql(16, 1, 64, "altered")})"""


@query(
    "x4_observed_step",
    f"""WITH {_ALTERED}, a AS (SELECT stream_id, frame, {CHECKSUM} AS c FROM t GROUP BY 1, 2 HAVING count(*) = 16),
b AS (SELECT stream_id, frame, {CHECKSUM} AS c FROM u GROUP BY 1, 2 HAVING count(*) = 16)
SELECT stream_id, count(*) AS n_frames, count(*) FILTER (a.c <> b.c) AS n_different, (SELECT count(*) FROM t) AS n_words,
  (SELECT sum(term) FROM t)::BIGINT AS terms_before, (SELECT sum(term) FROM u)::BIGINT AS terms_after FROM a JOIN b USING (stream_id, frame) GROUP BY 1""",
)
def _(spark, sf):
    """A step that alters every 97th word, between two observers; the checksum branches say which streams it met."""
    before, after = Observation("before"), Observation("after")
    came = words(spark, sf).select("stream_id", "seq", "word").observe(before, *I.frame_metrics(16))
    altered = came.withColumn("word", F.col("word") + (F.col("seq") % 97 == 5).cast("long"))
    out = saved(altered.observe(after, *I.frame_metrics(16)), "altered")
    seen, then = before.get, after.get
    if seen["n_words"] != then["n_words"]:
        raise ValueError("the step lost words")
    differences = I.frame_differences(words(spark, sf), out, 16)
    return differences.select("*", F.lit(seen["n_words"]).alias("n_words"), F.lit(seen["terms"]).alias("terms_before"), F.lit(then["terms"]).alias("terms_after"))
