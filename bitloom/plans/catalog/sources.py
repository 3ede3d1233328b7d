"""Readers and writers: each query writes a derived table in a format and reads it back."""

from pyspark.sql import functions as F

from ...operators import telemetry as V
from ...operators.inventory import op_counts
from ...session import cut_lineage, scratch_path
from ...sources import readers, writers
from .base import LAYERS, WORDS, layer_tables, query, table, vectors, words
from .base import V as VSQL
from .inventory import _COUNTS
from .telemetry import STATS, trace


@query("s1_read_params", f"WITH {VSQL} SELECT row_id, len(vec) AS n, list_sum(vec)::BIGINT AS total FROM v")
def _(spark, sf):
    path = scratch_path(spark, "params")
    vectors(spark, sf).select("row_id", "vec").write.parquet(path)
    v = readers.read_params(spark, path, "vectors")
    return v.select("row_id", F.size("vec").alias("n"), F.aggregate("vec", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("s2_labelled_csv", "SELECT CASE WHEN event_id % 3 <> 0 THEN 'train' ELSE 'test' END AS split, event_type, count(*) AS n, sum(user_id)::BIGINT AS users, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def _(spark, sf):
    e = table(spark, sf, "events").selectExpr("event_id AS id", "user_id", "event_type", "value", "props AS attack_cat")
    paths = [scratch_path(spark, "csv-train"), scratch_path(spark, "csv-test")]
    e.where("id % 3 <> 0").write.option("header", True).csv(paths[0])
    e.where("id % 3 = 0").write.option("header", True).csv(paths[1])
    back = readers.read_labelled_csv(spark, *paths, e.schema)
    return back.groupBy("split", "event_type").agg(F.count("*").alias("n"), F.sum("user_id").alias("users"), F.round(F.sum("value"), 2).alias("total"))


@query("s3_npy_files", f"WITH {VSQL} SELECT label, count(*) AS n, sum(list_sum(vec))::DOUBLE AS total, sum(vec[64])::DOUBLE AS last FROM v GROUP BY 1")
def _(spark, sf):
    path = scratch_path(spark, "npy")
    writers.write_npy(vectors(spark, sf), path if "://" in path or path.startswith("file:") else f"file://{path}", label="label")
    back = readers.read_npy(spark, f"{path}/*.npy", labelled=True)
    total = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x)
    return back.groupBy("label").agg(F.count("*").alias("n"), F.sum(total).alias("total"), F.sum(F.element_at("vec", -1)).alias("last"))


def _hex_table(spark, sf):
    e = table(spark, sf, "events").selectExpr("CAST(user_id % 4 AS INT) AS part", "CAST(event_id % 3 AS INT) AS layer", "event_id DIV 300 AS line", "event_id", "(event_id * 2654435 + user_id) % 4294967296 AS word")
    lines = e.groupBy("part", "layer", "line").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "word"))), lambda s: s["word"]).alias("words"))
    return lines


_HEX = """h AS (SELECT user_id % 4 AS part, event_id % 3 AS layer, event_id // 300 AS line, (event_id * 2654435 + user_id) % 4294967296 AS word,
  row_number() OVER (PARTITION BY user_id % 4, event_id % 3, event_id // 300 ORDER BY event_id) - 1 AS pos FROM events)"""


@query("s4_hex_words", f"WITH {_HEX} SELECT part, layer, line, pos, word FROM h")
def _(spark, sf):
    path = scratch_path(spark, "hex")
    writers.write_hex_words(_hex_table(spark, sf), path)
    return readers.read_hex_words(spark, path)


@query("s4_verify_words", f"WITH {_HEX} SELECT part, layer, line, pos, word AS written, word + 1 AS read FROM h WHERE word % 50 = 7")
def _(spark, sf):
    written = _hex_table(spark, sf).select("part", "layer", "line", F.posexplode("words").alias("pos", "word"))
    path = scratch_path(spark, "hex")
    writers.write_hex_words(_hex_table(spark, sf), path)
    read = readers.read_hex_words(spark, path).withColumn("word", F.when(F.col("word") % 50 == 7, F.col("word") + 1).otherwise(F.col("word")))
    return readers.verify_words(written, read)


@query("s5_labelled_files", "SELECT dense_rank() OVER (ORDER BY lang) - 1 AS label, 'lang=' || lang AS folder, sum(octet_length(encode(text)) + 1)::BIGINT AS n_bytes FROM documents GROUP BY lang")
def _(spark, sf):
    path = scratch_path(spark, "files")
    table(spark, sf, "documents").select("lang", "text").write.partitionBy("lang").text(path)
    return readers.read_labelled_files(spark, path).groupBy("label", "folder").agg(F.sum("length").alias("n_bytes"))


@query(
    "s5_sampled_files",
    """WITH f AS (SELECT 's_nationkey=' || s_nationkey AS folder, string_agg(s_name || chr(10), '' ORDER BY s_suppkey) AS content FROM supplier GROUP BY 1),
l AS (SELECT row_number() OVER (ORDER BY folder) - 1 AS label, * FROM f)
SELECT label, folder, octet_length(encode(content))::BIGINT AS length, sha256(content) AS content_sha256 FROM l WHERE label < 10""",
)
def _(spark, sf):
    """One file of supplier names for each nation; ten are taken class by class and only those are opened."""
    path = scratch_path(spark, "sampled")
    named = table(spark, sf, "supplier").select("s_nationkey", "s_suppkey", "s_name").repartition("s_nationkey").sortWithinPartitions("s_nationkey", "s_suppkey")
    named.drop("s_suppkey").write.partitionBy("s_nationkey").text(path)
    return readers.sample_labelled_files(spark, path, 10, True).select("label", "folder", "length", F.sha2("content", 256).alias("content_sha256"))


@query("s6_reports", f"WITH {LAYERS}, {_COUNTS} SELECT model_id, coalesce(layer_id, -1) AS layer_id, metric, sum(value) AS value FROM cnt GROUP BY GROUPING SETS ((model_id, layer_id, metric), (model_id, metric))")
def _(spark, sf):
    path = scratch_path(spark, "report")
    writers.write_report(op_counts(layer_tables(spark, sf)[0]), path)
    return readers.read_reports(spark, path).withColumn("layer_id", F.coalesce("layer_id", F.lit(-1)))


@query(
    "s7_xml_report",
    """SELECT p_brand AS report, p_name AS instance, r AS resource, CASE r WHEN 'LUT' THEN sum(p_size * 10)::BIGINT WHEN 'FF' THEN sum(p_size * 21)::BIGINT ELSE sum(p_size % 3)::BIGINT END AS value
FROM part, (VALUES ('LUT'), ('FF'), ('DSP')) v(r) GROUP BY 1, 2, 3""",
)
def _(spark, sf):
    parts = table(spark, sf, "part").groupBy("p_brand", "p_name").agg(F.sum("p_size").alias("s"), F.sum(F.col("p_size") % 3).alias("d"))
    rows = parts.select("p_brand", F.array(F.col("p_name"), F.lit("cell"), (F.col("s") * 10).cast("string"), (F.col("s") * 21).cast("string"), F.col("d").cast("string")).alias("c"))
    heads = parts.select("p_brand").distinct().select("p_brand", F.array(*[F.lit(h) for h in ("Instance", "Module", "Total LUTs", "FFs", "DSP Blocks")]).alias("c"))
    # a report is one file, as the tools write it
    body = rows.unionByName(heads).select("p_brand", F.transform("c", lambda x: F.struct(F.concat(F.lit("  "), x, F.lit(" ")).alias("_contents"))).alias("tablecell"))
    path = scratch_path(spark, "xml")
    body.repartition("p_brand").write.format("xml").option("rowTag", "tablerow").option("rootTag", "table").partitionBy("p_brand").save(path)
    back = readers.read_xml_report(spark, path)
    return back.select(F.url_decode(F.url_decode(F.regexp_extract("file", "p_brand=([^/]+)/", 1))).alias("report"), "instance", "resource", "value")


@query("s8_read_trace", f"WITH {STATS} SELECT iface, v, r, n, fraction FROM stats")
def _(spark, sf):
    t = trace(spark, sf).withColumn("dump", F.regexp_extract("signal", r"\d+", 0).cast("int") % 4)
    # one dump per group of interfaces: header lines, then time marks and changes in order
    code = F.concat(F.lit("s"), F.regexp_extract("signal", r"\d+", 0), F.substring("signal", -5, 1))
    head = t.select("dump", "signal").distinct().select(
        "dump", F.lit(-1).cast("long").alias("t"), F.concat(F.lit("b"), "signal").alias("k"), F.format_string("$var wire 1 %s %s $end", code, F.col("signal")).alias("value")
    )
    tops = t.select("dump").distinct()
    scope = tops.select("dump", F.lit(-1).cast("long").alias("t"), F.lit("a").alias("k"), F.lit("$scope module top $end").alias("value"))
    close = tops.select("dump", F.lit(-1).cast("long").alias("t"), F.lit("c").alias("k"), F.lit("$upscope $end").alias("value"))
    marks = t.select("dump", "t").distinct().select("dump", "t", F.lit("a").alias("k"), F.format_string("#%d", "t").alias("value"))
    changes = t.select("dump", "t", F.lit("b").alias("k"), F.concat(F.col("val").cast("string"), code).alias("value"))
    lines = scope.unionByName(head).unionByName(close).unionByName(marks).unionByName(changes)
    path = scratch_path(spark, "trace")
    lines.repartition("dump").sortWithinPartitions("dump", "t", "k").select("dump", "value").write.partitionBy("dump").text(path)
    back = cut_lineage(readers.read_trace(spark, f"{path}/*/*.txt"))
    plain = back.select(F.regexp_replace("signal", r"^top\.", "").alias("signal"), "t", "val")
    return V.interface_stats(V.interface_events(plain))


@query(
    "s10_dump_activations",
    f"""WITH {VSQL} SELECT step, status, count(*) AS n, sum(list_sum(vec) * f)::BIGINT AS total FROM (SELECT 'input' AS step, 'SUCCESS' AS status, vec, 1 AS f FROM v
UNION ALL SELECT 'double', CASE WHEN row_id % 6 = 0 THEN 'FAIL' ELSE 'SUCCESS' END, vec, 2 FROM v) GROUP BY 1, 2""",
)
def _(spark, sf):
    v = vectors(spark, sf).select("row_id", "vec")
    twice = v.withColumn("vec", F.transform("vec", lambda x: x * 2))
    path = scratch_path(spark, "dump")
    status = F.when(F.col("row_id") % 6 == 0, "FAIL").otherwise("SUCCESS")
    writers.dump_activations({"input": v.withColumn("status", F.lit("SUCCESS")), "double": twice.withColumn("status", status)}, path)
    total = F.sum(F.aggregate("vec", F.lit(0).cast("long"), lambda a, x: a + x)).alias("total")
    return spark.read.parquet(path).groupBy("step", "status").agg(F.count("*").alias("n"), total)


@query("x3_steps_resumed", f"WITH {VSQL} SELECT row_id, list_sum(list_transform(vec, lambda x: CASE WHEN x >= 0 THEN 1 ELSE -1 END))::BIGINT AS total FROM v")
def _(spark, sf):
    from ...functions.scalars import sign_bipolar
    from ..runner import run_steps

    folder = scratch_path(spark, "steps")

    def signs(df):
        return df.withColumn("vec", F.transform("vec", sign_bipolar))

    def totals(df):
        return df.select("row_id", F.aggregate("vec", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))

    run_steps(vectors(spark, sf), [signs, totals], folder, stop="signs")
    return run_steps(None, [signs, totals], folder, start="totals", spark=spark)[0]


@query("x4_checksum_hook", f"WITH {WORDS} SELECT stream_id, count(*) // 16 AS n_frames, 0::BIGINT AS n_different FROM words GROUP BY 1")
def _(spark, sf):
    from ...operators.integrity import checksum_tap

    forwarded, before = checksum_tap(words(spark, sf), 16)
    after = checksum_tap(forwarded, 16)[1]
    both = before.join(after.withColumnRenamed("checksum", "again"), ["stream_id", "frame"], "full_outer")
    differs = F.count_if(~F.col("checksum").eqNullSafe(F.col("again")))
    return both.groupBy("stream_id").agg(F.count("*").alias("n_frames"), differs.alias("n_different"))
