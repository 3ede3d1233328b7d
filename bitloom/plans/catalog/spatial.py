"""Sliding windows and resampling on 8x8 and 4x4x4 images."""

from pyspark.sql import functions as F

from ...operators import spatial as N
from .base import V, image, image_sql, query, vectors
from .products import windows_sql


@query("n1_im2col", f"WITH {image_sql(8, 1)}, {windows_sql(8, 2, 2, 2)} SELECT * FROM win")
def _(spark, sf):
    return N.im2col(image(spark, sf, 8, 1), (8, 8), (2, 2), (2, 2), (2, 2))


@query("n1_im2col_order", f"WITH {image_sql(4, 4)}, {windows_sql(4, 3)} SELECT row_id, oh, ow, (kh * 3 + kw) * 4 + c AS pos, c * 9 + kh * 3 + kw AS dw_pos, val FROM win")
def _(spark, sf):
    w = N.im2col(image(spark, sf, 4, 4), (4, 4), (3, 3))
    return w.select("row_id", "oh", "ow", N.window_order((3, 3), 4).alias("pos"), N.window_order((3, 3), 4, True).alias("dw_pos"), "val")


@query("n1_im2col_1d", f"WITH {V}, q AS (SELECT row_id, unnest(range(64)) AS i, unnest(vec) AS x FROM v) SELECT row_id, 0::BIGINT AS oh, ow, 0::BIGINT AS kh, kw, 0::BIGINT AS c, x AS val FROM range(30) a(ow), range(5) b(kw), q WHERE i = ow * 2 + kw")
def _(spark, sf):
    return N.im2col(image(spark, sf, 64, 1), (1, 64), (1, 5), (1, 2))


_SHAPES = [(0, 8, 8, 2, 2, 2, 2, 2, 2), (1, 8, 8, 3, 3, 1, 1, 1, 1), (2, 6, 5, 2, 3, 2, 1, 1, 1)]


@query(
    "n1_im2col_by_batch",
    f"""WITH {image_sql(8, 1)}, s(batch_id, height, width, nh, nw, sh, sw, dh, dw) AS (VALUES {", ".join(map(str, _SHAPES))}),
win AS (SELECT batch_id, row_id, a.oh, b.ow, e.kh, f.kw, a.oh * sh + e.kh * dh AS h, b.ow * sw + f.kw * dw AS w
  FROM s JOIN v ON v.row_id % 3 = batch_id, range(8) a(oh), range(8) b(ow), range(3) e(kh), range(3) f(kw)
  WHERE kh < nh AND kw < nw AND a.oh <= (height - dh * (nh - 1) - 1) // sh AND b.ow <= (width - dw * (nw - 1) - 1) // sw)
SELECT batch_id::BIGINT AS batch_id, row_id, oh, ow, kh, kw, c, val FROM win JOIN px USING (row_id, h, w)""",
)
def _(spark, sf):
    shapes = spark.createDataFrame(_SHAPES, "batch_id bigint, " + ", ".join(f"{c} int" for c in N.SHAPE))
    return N.im2col_by_batch(image(spark, sf, 8, 1).withColumn("batch_id", F.col("row_id") % 3), shapes)


def _kernel(spark, k, channels, outs):
    n = channels * outs
    return spark.range(k * k * n).selectExpr(f"CAST(id DIV {k * n} AS INT) kh", f"CAST(id DIV {n} % {k} AS INT) kw", f"CAST(id DIV {outs} % {channels} AS INT) c", f"CAST(id % {outs} AS INT) out_idx").selectExpr(
        "*", "(kh * 3 + kw * 5 + c * 7 + out_idx * 11) % 5 - 2 AS w"
    )


_KERNEL = "(kh*3 + kw*5 + c*7 + o*11) % 5 - 2"


@query(
    "n2_conv2d",
    f"""WITH {image_sql(4, 4)}, k AS (SELECT kh, kw, c, o, {_KERNEL} AS w FROM range(3) a(kh), range(3) b(kw), range(4) e(c), range(3) f(o)),
g AS (SELECT row_id, oh, ow, o FROM v, range(4) a(oh), range(4) b(ow), range(3) e(o)),
t AS (SELECT row_id, px.h + 1 - kh AS oh, px.w + 1 - kw AS ow, o, sum(val * k.w)::BIGINT AS val FROM px JOIN k USING (c) GROUP BY ALL)
SELECT row_id, oh, ow, o AS out_idx, coalesce(val, 0)::BIGINT AS val FROM g LEFT JOIN t USING (row_id, oh, ow, o)""",
)
def _(spark, sf):
    return N.conv2d(image(spark, sf, 4, 4), _kernel(spark, 3, 4, 3), (4, 4), (3, 3), pads=(1, 1, 1, 1))


@query("n3_downsample", f"WITH {image_sql(8, 1)} SELECT row_id, h // 3 AS h, w // 3 AS w, c, val FROM px WHERE h % 3 = 0 AND w % 3 = 0")
def _(spark, sf):
    return N.downsample(image(spark, sf, 8, 1), 3)


@query(
    "n4_pad2d",
    f"""WITH {image_sql(4, 4)} SELECT r.row_id, a.h, b.w, e.c, coalesce(px.val, 0) AS val FROM v r, range(8) a(h), range(9) b(w), range(4) e(c)
LEFT JOIN px ON px.row_id = r.row_id AND px.h = a.h - 1 AND px.w = b.w - 3 AND px.c = e.c""",
)
def _(spark, sf):
    return N.pad2d(image(spark, sf, 4, 4), (1, 3, 3, 2), (4, 4))


@query(
    "n5_pixel_pad",
    f"""WITH {image_sql(4, 4)} SELECT r.row_id, a.h, b.w, e.c, coalesce(px.val, 0) AS val FROM v r, range(7) a(h), range(10) b(w), range(4) e(c)
LEFT JOIN px ON px.row_id = r.row_id AND px.h * 2 = a.h AND px.w * 3 = b.w AND px.c = e.c""",
)
def _(spark, sf):
    return N.pixel_pad(image(spark, sf, 4, 4), (2, 3), (4, 4))


@query(
    "n6_deconv2d",
    f"""WITH {image_sql(4, 4)}, k AS (SELECT kh, kw, c, o, {_KERNEL} AS w FROM range(2) a(kh), range(2) b(kw), range(4) e(c), range(3) f(o)),
g AS (SELECT row_id, oh, ow, o FROM v, range(11) a(oh), range(11) b(ow), range(3) e(o)),
t AS (SELECT row_id, h * 3 + kh AS oh, px.w * 3 + kw AS ow, o, sum(val * k.w)::BIGINT AS val FROM px JOIN k USING (c) GROUP BY ALL)
SELECT row_id, oh, ow, o AS out_idx, coalesce(val, 0)::BIGINT AS val FROM g LEFT JOIN t USING (row_id, oh, ow, o)""",
)
def _(spark, sf):
    return N.deconv2d(image(spark, sf, 4, 4), N.mirrored(_kernel(spark, 2, 4, 3), (2, 2)), (4, 4), (2, 2), (3, 3), pad=0)


@query("n7_upsample", f"WITH {image_sql(4, 4)} SELECT row_id, h * 2 + a AS h, w * 2 + b AS w, c, val FROM px, range(2) r(a), range(2) s(b)")
def _(spark, sf):
    return N.upsample(image(spark, sf, 4, 4), 2)


@query(
    "n8_rechunk",
    f"""WITH {V}, p AS (SELECT label AS stream_id, row_number() OVER (PARTITION BY label ORDER BY row_id) - 1 AS seq, vec FROM v),
c AS (SELECT stream_id, seq * 64 + unnest(range(64)) AS pos, unnest(vec) AS x FROM p)
SELECT stream_id, pos // 48 AS seq, string_agg(x::VARCHAR, ',' ORDER BY pos) AS vec FROM c GROUP BY 1, 2""",
)
def _(spark, sf):
    from ...operators.scans import row_numbers

    w = row_numbers(vectors(spark, sf).withColumnRenamed("label", "stream_id"), ["stream_id"], ["row_id"]).drop("row_id")
    return N.rechunk(w, 48, n=64)
