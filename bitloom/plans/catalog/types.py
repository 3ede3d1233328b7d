"""Types, projections and packing."""

from pyspark.sql import functions as F

from ...functions import packing as P
from ...functions import scalars as S
from ...layouts import flat_index
from ...operators import elementwise as E
from ...operators import spatial
from ...sources import generators, writers
from ...types import QuantType
from .base import Q, V, image, image_sql, query, table, vectors

INT8 = QuantType.parse("INT8")


@query(
    "t1_check_type",
    """WITH t AS (SELECT count(l_linenumber) AS n, count(*) FILTER (l_linenumber NOT BETWEEN 0 AND 3) AS b,
  count(l_partkey) AS n2, count(*) FILTER (l_partkey NOT BETWEEN 0 AND 3) AS b2,
  count(l_extendedprice) AS n3, count(*) FILTER (l_extendedprice NOT BETWEEN 0 AND 3 OR l_extendedprice <> floor(l_extendedprice)) AS b3 FROM lineitem)
SELECT 'l_linenumber' AS "column", n AS n_checked, b AS n_bad FROM t UNION ALL SELECT 'l_partkey', n2, b2 FROM t
UNION ALL SELECT 'l_extendedprice', n3, b3 FROM t""",
)
def _(spark, sf):
    return E.check_type(table(spark, sf, "lineitem"), ["l_linenumber", "l_partkey", "l_extendedprice"], QuantType.parse("UINT2"))


def _smallest(lo: str, hi: str) -> str:
    """SQL for the narrowest type of a range."""
    return f"""CASE WHEN {lo} >= 0 THEN (SELECT CASE WHEN b <= 1 THEN 'BINARY' ELSE 'UINT' || b END FROM
  (SELECT min(b) AS b FROM range(65) r(b) WHERE {hi} + 1 <= pow(2, b)))
  ELSE (SELECT 'INT' || min(b) FROM range(1, 65) r(b) WHERE -pow(2, b - 1) <= {lo} AND {hi} <= pow(2, b - 1) - 1) END"""


@query(
    "t2_smallest_type",
    f"""WITH t AS (SELECT 'l_orderkey' AS "column", min(l_orderkey)::DOUBLE AS lo, max(l_orderkey)::DOUBLE AS hi FROM lineitem
UNION ALL SELECT 'l_linenumber', min(l_linenumber), max(l_linenumber) FROM lineitem
UNION ALL SELECT 'l_margin', min(l_linenumber - l_suppkey), max(l_linenumber - l_suppkey) FROM lineitem)
SELECT "column", lo, hi, {_smallest("lo", "hi")} AS type FROM t""",
)
def _(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("l_margin", F.col("l_linenumber") - F.col("l_suppkey"))
    return E.smallest_type(li, ["l_orderkey", "l_linenumber", "l_margin"])


@query(
    "t3_bipolar_binary",
    f"""WITH {Q}, b AS (SELECT row_id, i, CASE WHEN x >= 0 THEN 1 ELSE -1 END AS s FROM q)
SELECT row_id, sum(s)::BIGINT AS sum_bipolar, sum((s + 1) // 2)::BIGINT AS sum_binary, sum(2 * ((s + 1) // 2) - 1)::BIGINT AS sum_back FROM b GROUP BY row_id""",
)
def _(spark, sf):
    v = vectors(spark, sf).withColumn("s", F.transform("vec", S.sign_bipolar))
    v = v.withColumn("b", F.transform("s", S.to_binary))
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    return v.select("row_id", total(F.col("s")).alias("sum_bipolar"), total(F.col("b")).alias("sum_binary"), total(F.transform("b", S.to_bipolar)).alias("sum_back"))


@query(
    "t4_fixed_point",
    """SELECT event_id, CAST(round(value / 0.125) AS BIGINT) AS steps, CAST(round(value / 0.125) AS BIGINT) * 0.125::DOUBLE AS back FROM events""",
)
def _(spark, sf):
    e = table(spark, sf, "events").withColumn("steps", S.to_fixed(F.col("value"), 0.125))
    return e.select("event_id", "steps", S.from_fixed(F.col("steps"), 0.125).alias("back"))


@query(
    "t5_scale_normalize",
    f"""WITH {image_sql(4, 4)} SELECT row_id, h, w, c, round(((val + 128) / 255.0::DOUBLE - [0.4, 0.45, 0.5, 0.55][c + 1]::DOUBLE) / 0.25::DOUBLE, 6) AS val FROM px""",
)
def _(spark, sf):
    means = spark.createDataFrame([(0, 0.4), (1, 0.45), (2, 0.5), (3, 0.55)], "c INT, mean DOUBLE")
    pixels = image(spark, sf, 4, 4).withColumn("val", S.scale_255(F.col("val") + 128))
    out = E.scale_normalize(pixels, means, 0.25)
    return out.withColumn("val", F.round("val", 6))


@query("t6_center_crop", f"WITH {image_sql(8, 1)} SELECT row_id, h - 2 AS h, w - 2 AS w, c, val FROM px WHERE h BETWEEN 2 AND 5 AND w BETWEEN 2 AND 5")
def _(spark, sf):
    return spatial.center_crop(image(spark, sf, 8, 1), 8, 8, 4)


@query("t7_layout_nchw", f"WITH {image_sql(4, 4)} SELECT row_id, (c * 4 + h) * 4 + w AS nchw, (h * 4 + w) * 4 + c AS nhwc, val FROM px")
def _(spark, sf):
    return image(spark, sf, 4, 4).select("row_id", flat_index("NCHW", 4, 4, 4).alias("nchw"), flat_index("NHWC", 4, 4, 4).alias("nhwc"), "val")


@query(
    "t8_fold_unfold",
    f"WITH {Q} SELECT row_id, i // 8 AS fold, string_agg(x::VARCHAR, ',' ORDER BY i) AS part FROM q GROUP BY row_id, i // 8",
)
def _(spark, sf):
    v = vectors(spark, sf).select("row_id", E.fold(F.col("vec"), 8).alias("folds"))
    back = v.select("row_id", E.fold(E.unfold(F.col("folds")), 8).alias("folds"))
    return back.select("row_id", F.posexplode("folds").alias("fold", "part"))


@query(
    "t9_pad_vector",
    f"WITH {V} SELECT row_id, array_to_string(list_transform(list_concat(vec, [0,0,0,0,0,0,0,0]), lambda x: CASE WHEN x >= 0 THEN 1 ELSE -1 END), ',') AS vec FROM v",
)
def _(spark, sf):
    padded = vectors(spark, sf).select("row_id", E.pad_vec(F.col("vec"), 72).alias("vec"))
    return padded.select("row_id", F.transform("vec", S.sign_bipolar).alias("vec"))


_BYTES = "list_transform(vec, lambda x: lpad(lower(to_hex((x + 256) % 256)), 2, '0'))"


@query(
    "t10_pack",
    f"""WITH {V} SELECT row_id, array_to_string({_BYTES}, '') AS int8_hex, array_to_string(list_reverse({_BYTES}), '') AS reversed_hex,
  lower(hex(from_binary(lpad(array_to_string(list_transform(vec, lambda x: CASE WHEN x >= 0 THEN '1' ELSE '0' END), ''), 72, '0')))) AS bipolar_hex,
  lower(hex(from_binary(array_to_string(list_transform(vec, lambda x: lpad(bin((x + 128) % 128), 7, '0')), '')))) AS int7_hex FROM v""",
)
def _(spark, sf):
    v = vectors(spark, sf)
    signs = F.transform("vec", S.sign_bipolar)
    wrapped = F.transform("vec", lambda x: F.when(F.pmod(x, F.lit(128)) >= 64, F.pmod(x, F.lit(128)) - 128).otherwise(F.pmod(x, F.lit(128))))
    return v.select(
        "row_id",
        P.pack_hex(F.col("vec"), INT8, 512).alias("int8_hex"),
        P.pack_hex(F.col("vec"), INT8, 512, reverse_endian=True).alias("reversed_hex"),
        P.pack_hex(signs, QuantType.parse("BIPOLAR"), 72).alias("bipolar_hex"),
        P.pack_hex(wrapped, QuantType.parse("INT7"), 448).alias("int7_hex"),
    )


@query("t11_unpack", f"WITH {V} SELECT row_id, array_to_string(vec, ',') AS vec, array_to_string(list_transform(vec, lambda x: CASE WHEN x >= 0 THEN 1 ELSE -1 END), ',') AS signs FROM v")
def _(spark, sf):
    v = vectors(spark, sf)
    bip = QuantType.parse("BIPOLAR")
    packed = v.select(
        "row_id",
        P.pack_bytes(F.col("vec"), INT8, 520).alias("a"),
        P.pack_bytes(F.transform("vec", S.sign_bipolar), bip, 64, reverse_inner=True, reverse_endian=True).alias("b"),
    )
    return packed.select("row_id", P.unpack_bytes(F.col("a"), INT8, 64).alias("vec"), P.unpack_bytes(F.col("b"), bip, 64, reverse_inner=True, reverse_endian=True).alias("signs"))


@query(
    "t12_hex_bytes",
    """WITH h AS (SELECT event_id, '0x' || lpad(lower(to_hex(event_id * 7919)), 16, '0') AS hex FROM events)
SELECT event_id, hex, array_to_string(list_transform(range(8), lambda i: CAST('0x' || substr(hex, 3 + 2 * CAST(i AS BIGINT), 2) AS BIGINT)), ',') AS bytes, hex AS back FROM h""",
)
def _(spark, sf):
    h = table(spark, sf, "events").select("event_id", F.concat(F.lit("0x"), F.lpad(F.lower(F.hex(F.col("event_id") * 7919)), 16, "0")).alias("hex"))
    h = h.withColumn("bytes", P.hex_to_byte_values(F.col("hex")))
    return h.select("event_id", "hex", "bytes", P.byte_values_to_hex(F.col("bytes")).alias("back"))


@query("t13_abs_shift", f"WITH {Q} SELECT row_id, i, abs(x) AS magnitude, CAST(floor(x / 4.0) AS BIGINT) AS shifted FROM q")
def _(spark, sf):
    c = vectors(spark, sf).select("row_id", F.posexplode("vec").alias("i", "x"))
    return c.select("row_id", "i", F.abs("x").alias("magnitude"), S.right_shift(F.col("x"), 2).alias("shifted"))


@query("t14_sign", f"WITH {Q} SELECT row_id, i, CASE WHEN x >= 0 THEN 1 ELSE -1 END::BIGINT AS s FROM q")
def _(spark, sf):
    c = vectors(spark, sf).select("row_id", F.posexplode("vec").alias("i", "x"))
    return c.select("row_id", "i", S.sign_bipolar(F.col("x")).alias("s"))


@query(
    "s9_hex_lines",
    f"""WITH {V}, r AS (SELECT row_id, label, unnest(range(9)) AS line_no, vec FROM v)
SELECT row_id, line_no, CASE WHEN line_no = 8 THEN repeat('ff', 7) || lpad(hex(label), 2, '0') ELSE
  array_to_string(list_transform(list_reverse(vec[line_no * 8 + 1 : line_no * 8 + 8]), lambda x: lpad(upper(to_hex((x + 256) % 256)), 2, '0')), '') END AS line FROM r""",
)
def _(spark, sf):
    return writers.hex_lines(vectors(spark, sf), 8)


@query(
    "s11_generate_typed",
    "SELECT t AS type, count(*) * 16 AS n_checked, 0::BIGINT AS n_bad FROM events, (VALUES ('INT4'), ('UINT8'), ('BIPOLAR'), ('TERNARY')) v(t) GROUP BY t",
)
def _(spark, sf):
    events = table(spark, sf, "events")
    out = None
    for name in ("INT4", "UINT8", "BIPOLAR", "TERNARY"):
        q = QuantType.parse(name)
        cells = generators.gen_like(events, "event_id", q, 16).select(F.explode("vec").alias("val"))
        checked = E.check_type(cells, ["val"], q).select(F.lit(name).alias("type"), "n_checked", "n_bad")
        out = checked if out is None else out.unionByName(checked)
    return out
