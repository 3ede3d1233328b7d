"""Feature preparation on lineitem and events."""

from pyspark.sql import functions as F

from ...functions import scalars as S
from ...operators import evaluation
from ...operators import features as X
from .base import query, table

NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]
JOB = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_linenumber"]
KEY = ["l_orderkey", "l_partkey", "l_suppkey"]


@query(
    "f1_label_encode",
    """WITH a AS (SELECT l_returnflag AS v, row_number() OVER (ORDER BY l_returnflag) - 1 AS code FROM (SELECT DISTINCT l_returnflag FROM lineitem)),
b AS (SELECT l_linestatus AS v, row_number() OVER (ORDER BY l_linestatus) - 1 AS code FROM (SELECT DISTINCT l_linestatus FROM lineitem))
SELECT a.code AS l_returnflag, b.code AS l_linestatus, count(*) AS n, sum(l_quantity) AS qty FROM lineitem JOIN a ON a.v = l_returnflag JOIN b ON b.v = l_linestatus GROUP BY 1, 2""",
)
def _(spark, sf):
    li = table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity", "l_orderkey")
    return X.label_encode(li).groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("qty"))


EVENT_TYPES = ["click", "view", "purchase", "signup", "error"]


@query(
    "f2_one_hot",
    """SELECT (event_type = 'click')::BIGINT AS click, (event_type = 'view')::BIGINT AS "view", (event_type = 'purchase')::BIGINT AS purchase,
  (event_type = 'signup')::BIGINT AS signup, (event_type = 'error')::BIGINT AS error, event_id FROM events""",
)
def _(spark, sf):
    return X.one_hot(table(spark, sf, "events").select("event_id", "event_type"), "event_type", EVENT_TYPES)


@query("f2_unknown_values", "SELECT event_type, count(*) AS n FROM events WHERE event_type NOT IN ('click', 'view', 'purchase') GROUP BY 1")
def _(spark, sf):
    return X.unknown_values(table(spark, sf, "events"), "event_type", EVENT_TYPES[:3])


@query("f3_min_positive", "SELECT " + ", ".join(f"min({c}) FILTER ({c} > 0)::DOUBLE AS {c}" for c in NUMERIC) + " FROM lineitem")
def _(spark, sf):
    return X.min_positive(table(spark, sf, "lineitem"), NUMERIC)


def _m(c: str, t: str = "lineitem") -> str:
    return f"(SELECT min({c}) FILTER ({c} > 0) FROM {t})::DOUBLE"


def _scaled(c: str, t: str = "lineitem") -> str:
    return f"(CASE WHEN 1.0 / {_m(c, t)} > 1 THEN {c}::DOUBLE * (1.0::DOUBLE / {_m(c, t)}) ELSE {c}::DOUBLE END)"


def _rounded(c: str, t: str = "lineitem") -> str:
    x = f"greatest(0.0::DOUBLE, least(4294967295.0::DOUBLE, {_scaled(c, t)}))"
    return f"CAST(CASE WHEN {x} - floor({x}) < 0.5 THEN floor({x}) ELSE ceil({x}) END AS BIGINT)"


@query(
    "f4_scale_min_positive",
    f"SELECT l_orderkey, l_partkey, l_suppkey, round({_scaled('l_discount')}, 6) AS l_discount, round({_scaled('l_tax')}, 6) AS l_tax, {_scaled('l_quantity')} AS l_quantity FROM lineitem",
)
def _(spark, sf):
    li = table(spark, sf, "lineitem").select(*KEY, "l_discount", "l_tax", "l_quantity")
    out = X.scale_by_min_positive(li, ["l_discount", "l_tax", "l_quantity"])
    return out.withColumn("l_discount", F.round("l_discount", 6)).withColumn("l_tax", F.round("l_tax", 6))


def _bits(c: str, t: str = "lineitem") -> str:
    return f"(SELECT min(b) FROM range(64) r(b), (SELECT max({_scaled(c, t)}) AS x FROM {t}) WHERE x + 1 <= pow(2, b))"


@query(
    "f5_bits_needed",
    " UNION ALL ".join(f"""SELECT '{c}' AS "column", {_m(c)} AS min_positive, {_bits(c)} AS bits""" for c in NUMERIC),
)
def _(spark, sf):
    return X.bits_report(table(spark, sf, "lineitem"), NUMERIC)


@query("f6_quantize_u32", "SELECT l_orderkey, l_partkey, l_suppkey, " + ", ".join(f"{_rounded(c)} AS {c}" for c in NUMERIC) + " FROM lineitem")
def _(spark, sf):
    li = table(spark, sf, "lineitem").select(*KEY, *NUMERIC)
    return X.quantize_columns(li, NUMERIC, X.column_stats(li, NUMERIC))


@query(
    "f7_overrides",
    """WITH o AS (SELECT doc_id AS event_id, quality * 1000 + doc_id AS value FROM labels)
SELECT event_id, coalesce(o.value, user_id) AS user_id FROM events LEFT JOIN o USING (event_id)""",
)
def _(spark, sf):
    o = table(spark, sf, "labels").select(F.col("doc_id").alias("event_id"), (F.col("quality") * 1000 + F.col("doc_id")).alias("value"))
    return X.apply_overrides(table(spark, sf, "events").select("event_id", "user_id"), "event_id", "user_id", o)


@query("f8_bits", "SELECT event_id, array_to_string(list_transform(range(8), lambda i: (user_id >> (7 - i)) & 1), ',') AS bits, lpad(bin(user_id), 8, '0') AS text FROM events")
def _(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", S.bit_array(F.col("user_id"), 8).alias("bits"), S.bit_string(F.col("user_id"), 8).alias("text"))


_BIT_TEXT = " || ".join(f"lpad(bin({_rounded(c, 'enc')}), (SELECT bits FROM wid WHERE c = '{c}')::INT, '0')" for c in JOB)
_ENCODED = """enc AS (SELECT l_orderkey, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, a.code AS l_returnflag, b.code AS l_linestatus, l_linenumber
FROM lineitem JOIN (SELECT l_returnflag AS v, row_number() OVER (ORDER BY l_returnflag) - 1 AS code FROM (SELECT DISTINCT l_returnflag FROM lineitem)) a ON a.v = l_returnflag
JOIN (SELECT l_linestatus AS v, row_number() OVER (ORDER BY l_linestatus) - 1 AS code FROM (SELECT DISTINCT l_linestatus FROM lineitem)) b ON b.v = l_linestatus)"""


def _job(select: str) -> str:
    widths = " UNION ALL ".join(f"SELECT '{c}' AS c, {_bits(c, 'enc')} AS bits" for c in JOB)
    return f"WITH {_ENCODED}, wid AS ({widths}) SELECT {select} FROM enc"


@query("f9_assemble_bits", _job(f"l_orderkey, l_partkey, l_suppkey, {_BIT_TEXT} AS bits"))
def _(spark, sf):
    li = table(spark, sf, "lineitem")
    return X.feature_job(li, JOB, keep=KEY, as_text=True)[0]


@query(
    "f9_feature_vector",
    _job(f"l_orderkey, l_partkey, l_suppkey, sum(length(replace({_BIT_TEXT}, '0', '')))::BIGINT AS ones, max(length({_BIT_TEXT})) AS width") + " GROUP BY ALL",
)
def _(spark, sf):
    vecs, width = X.feature_job(table(spark, sf, "lineitem"), JOB, keep=KEY)
    ones = F.aggregate("bits", F.lit(0).cast("long"), lambda a, b: a + b)
    return vecs.select(*KEY, ones.alias("ones"), F.size("bits").alias("width")).groupBy(*KEY).agg(F.sum("ones").alias("ones"), F.max("width").alias("width"))


@query("f10_split", "SELECT CASE WHEN event_id < 700 THEN 'train' ELSE 'test' END AS split, count(*) AS n, sum(user_id)::BIGINT AS users FROM events GROUP BY 1")
def _(spark, sf):
    e = X.split_by_position(table(spark, sf, "events"), "event_id", 700)
    both = X.split_by_source(e, "train").unionByName(X.split_by_source(e, "test"))
    return both.groupBy("split").agg(F.count("*").alias("n"), F.sum("user_id").alias("users"))


@query(
    "f11_batches",
    """WITH e AS (SELECT event_id * 3 + event_id % 2 AS event_id FROM events), p AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS pos FROM e)
SELECT event_id, pos // 64 AS batch_id FROM p WHERE pos // 64 < (SELECT count(*) // 64 FROM p)""",
)
def _(spark, sf):
    e = table(spark, sf, "events").selectExpr("event_id * 3 + event_id % 2 AS event_id")
    return X.batches(e, 64, "event_id")


@query(
    "u1_union",
    "SELECT split, count(*) AS n, sum(event_id)::BIGINT AS ids FROM (SELECT 'train' AS split, * FROM events WHERE event_id % 3 <> 0 UNION ALL SELECT 'test', * FROM events WHERE event_id % 3 = 0) GROUP BY 1",
)
def _(spark, sf):
    e = table(spark, sf, "events")
    train = e.where("event_id % 3 <> 0").withColumn("split", F.lit("train"))
    both = train.unionByName(e.where("event_id % 3 = 0").withColumn("split", F.lit("test")))
    return both.groupBy("split").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query(
    "m4_binary_accuracy",
    """SELECT count(*) FILTER ((n_chars > 400)::INT = quality) AS ok, count(*) FILTER ((n_chars > 400)::INT <> quality) AS nok,
  count(*) FILTER ((n_chars > 400)::INT = quality) * 100.0::DOUBLE / count(*) AS accuracy FROM documents JOIN labels USING (doc_id)""",
)
def _(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select((F.col("n_chars") - 400).alias("score"), F.col("quality").alias("label"))
    return evaluation.binary_accuracy(d)
