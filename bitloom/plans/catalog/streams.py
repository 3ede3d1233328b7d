"""Structured Streaming jobs over files that Spark derives from the given tables."""

from pyspark.sql import functions as F

from ...operators import matmul as MM
from ...operators import thresholds as TH
from ...functions.scalars import whole_div
from ...operators.integrity import frame_metrics
from ...operators.ranking import label_select
from ...session import saved, scratch_path
from ...streaming import jobs as J
from .base import OUT, V, WORDS, query, step_thresholds, table, ternary_weights, vectors, words
from .joins import _PRED, predictions
from .telemetry import CHECKSUM, checksum_sql, terms_sql

PARTS = 3
EPOCH = 1_700_000_000


def as_stream(spark, df, name: str):
    """Write a table as files, one a core for each micro-batch, and read it back as a stream of ``PARTS`` micro-batches."""
    path, files = scratch_path(spark, name), spark.sparkContext.defaultParallelism
    df.repartition(PARTS * files).write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(path)


def _paths(spark, name: str) -> tuple[str, str]:
    return scratch_path(spark, f"{name}-out"), scratch_path(spark, f"{name}-state")


@query(
    "e4_score_stream",
    f"""WITH {OUT}, r AS (SELECT row_id, o, row_number() OVER (PARTITION BY row_id ORDER BY y DESC, o) AS rn FROM scored)
SELECT row_id, string_agg(o::VARCHAR, ',' ORDER BY rn) AS top FROM r WHERE rn <= 3 GROUP BY row_id""",
)
def _(spark, sf):
    layer = (MM.weight_matrix(ternary_weights(spark), (64, 10)), MM.threshold_matrix(step_thresholds(spark), 10, 15), 1, 0)

    def chain(batch):
        return MM.dense_layers(batch, [layer]).select("row_id", label_select(F.col("vec"), 3).alias("top"))

    out, state = _paths(spark, "score")
    J.score_stream(as_stream(spark, vectors(spark, sf).select("row_id", "vec"), "score"), chain, out, state).awaitTermination()
    return spark.read.parquet(out).select("row_id", "top")


@query(
    "e5_swap_params",
    f"""WITH {V}, q AS (SELECT row_id, unnest(range(64)) AS i, unnest(vec) AS x FROM v)
SELECT row_id, i, (CASE WHEN x >= CASE WHEN row_id % 2 = 0 THEN 100 ELSE 5 END THEN 1 ELSE 0 END)::BIGINT AS val, 1 + row_id % 2 AS version FROM q""",
)
def _(spark, sf):
    """Even rows come first; the second version appears while the stream stands between two micro-batches."""
    root, path = scratch_path(spark, "params"), scratch_path(spark, "swap")
    cells = vectors(spark, sf).select("row_id", F.posexplode("vec").alias("i", "val"))
    out, state = _paths(spark, "swap")

    def chain(batch, params):
        return TH.multi_threshold(batch.withColumn("version", params.agg(F.max("version")).scalar()), params, channel=None)

    for version, t in ((1, 100.0), (2, 5.0)):
        J.publish_params(spark.range(1).selectExpr("0 AS step", f"{t}D AS t"), root, version)
        cells.where(F.col("row_id") % 2 == version - 1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(cells.schema).parquet(path)
        J.score_with_params(stream, lambda: J.latest_params(spark, root), chain, out, state).awaitTermination()
    return spark.read.parquet(out).select("row_id", "i", "val", "version")


@query(
    "e5_swap_running",
    f"""WITH {V}, q AS (SELECT row_id, unnest(range(64)) AS i, unnest(vec) AS x FROM v)
SELECT row_id, i, (CASE WHEN x >= CASE WHEN row_id % 2 = 0 THEN 100 ELSE 5 END THEN 1 ELSE 0 END)::BIGINT AS val, 1 + row_id % 2 AS version, 1::BIGINT AS n_runs FROM q""",
)
def _(spark, sf):
    """One query runs all the time: even rows come, a version is published, odd rows come. All micro-batches have one run id."""
    root, path = scratch_path(spark, "params"), scratch_path(spark, "swap")
    cells = vectors(spark, sf).select("row_id", F.posexplode("vec").alias("i", "val"))
    out, state = _paths(spark, "swap")

    def chain(batch, params):
        return TH.multi_threshold(batch.withColumn("version", params.agg(F.max("version")).scalar()), params, channel=None)

    def publish(version: int, t: float) -> None:
        J.publish_params(spark.range(1).selectExpr("0 AS step", f"{t}D AS t"), root, version)

    publish(1, 100.0)
    cells.limit(0).write.parquet(path)
    stream = spark.readStream.schema(cells.schema).parquet(path)
    query = J.score_with_params(stream, lambda: J.latest_params(spark, root), chain, out, state, trigger={"processingTime": "0 seconds"})
    J.feed(query, [cells.where("row_id % 2 = 0"), lambda: publish(2, 5.0), cells.where("row_id % 2 = 1")], path)
    runs = len({p["runId"] for p in query.recentProgress})
    return spark.read.parquet(out).select("row_id", "i", "val", "version", F.lit(runs).cast("long").alias("n_runs"))


_CHUNKS = f"""WITH {WORDS}, c AS (SELECT stream_id, seq * 4 + k AS pos, (word >> (k * 8)) & 255 AS x FROM words, range(4) r(k)),
g AS (SELECT stream_id, pos // 6 AS seq, string_agg(x::VARCHAR, ',' ORDER BY pos) AS vec, count(*) AS n FROM c GROUP BY 1, 2),
b AS (SELECT stream_id, seq // 2 AS blk FROM g GROUP BY 1, 2 HAVING sum(n) = 12)
SELECT g.stream_id, g.seq, g.vec FROM g JOIN b ON b.stream_id = g.stream_id AND b.blk = g.seq // 2"""


@query("e6_rechunk_stream", _CHUNKS)
def _(spark, sf):
    w = words(spark, sf).select("stream_id", "seq", F.array(*[F.shiftright("word", k * 8).bitwiseAND(255) for k in range(4)]).alias("vec"))
    out, state = _paths(spark, "rechunk")
    return J.run_to_end(J.rechunk_stream(as_stream(spark, w, "rechunk"), 4, 6), out, state)


@query("e7_checksum_stream", checksum_sql(16, 1, 64))
def _(spark, sf):
    out, state = _paths(spark, "checksum")
    return J.run_to_end(J.checksum_stream(as_stream(spark, words(spark, sf).drop("ts"), "checksum"), 16), out, state)


def _in_order(df, idle: str):
    """Words in parts by number, one second of event time each, and a last row without a word, long after, that closes what is open."""
    df = saved(df, "in-order")
    timed = df.withColumn("ts", F.timestamp_seconds(F.col("seq") + EPOCH))
    span = df.agg(F.max("seq")).scalar() + 1
    parts = [timed.where(whole_div(F.col("seq") * PARTS, span) == p) for p in range(PARTS)]
    end = timed.groupBy().agg(F.max("seq").alias("seq")).select(F.lit("").alias("stream_id"), "seq", F.lit(None).cast(df.schema[idle].dataType).alias(idle), F.timestamp_seconds(F.col("seq") + EPOCH + 86400).alias("ts"))
    return [*parts, end.select(*timed.columns)]


_LOST = f"{WORDS}, kept AS (SELECT * FROM words WHERE seq % 50 <> 7)"


@query(
    "e7_checksum_lost_words",
    f"WITH {_LOST}, t AS ({terms_sql(16, 1, 64, 'kept')}) SELECT stream_id, frame, CASE WHEN count(*) = 16 THEN {CHECKSUM} END AS checksum, count(*) AS n_words FROM t GROUP BY 1, 2",
)
def _(spark, sf):
    """Every fiftieth word is lost: its frame leaves the state by the watermark and is reported without a checksum."""
    kept = words(spark, sf).select("stream_id", "seq", "word").where("seq % 50 <> 7")
    parts, path = _in_order(kept, "word"), scratch_path(spark, "lost-words")
    out, state = _paths(spark, "lost-words")
    parts[0].limit(0).write.parquet(path)
    stream = spark.readStream.schema(parts[0].schema).parquet(path)
    return J.run_while_fed(J.checksum_stream(stream, 16, late="1 minute"), out, state, parts, path)[0]


@query(
    "e6_rechunk_lost_words",
    f"""WITH {_LOST}, c AS (SELECT stream_id, seq * 4 + k AS pos, (word >> (k * 8)) & 255 AS x FROM kept, range(4) r(k)),
g AS (SELECT stream_id, pos // 6 AS seq, string_agg(x::VARCHAR, ',' ORDER BY pos) AS vec FROM c GROUP BY 1, 2),
b AS (SELECT stream_id, pos // 12 AS blk, count(*) AS n FROM c GROUP BY 1, 2)
SELECT g.stream_id, g.seq, g.vec, 6::BIGINT AS n_elements FROM g JOIN b ON b.stream_id = g.stream_id AND b.blk = g.seq // 2 WHERE n = 12
UNION ALL SELECT stream_id, blk * 2, NULL, n FROM b WHERE n < 12""",
)
def _(spark, sf):
    kept = words(spark, sf).where("seq % 50 <> 7").select("stream_id", "seq", F.array(*[F.shiftright("word", k * 8).bitwiseAND(255) for k in range(4)]).alias("vec"))
    parts, path = _in_order(kept, "vec"), scratch_path(spark, "lost-elements")
    out, state = _paths(spark, "lost-elements")
    parts[0].limit(0).write.parquet(path)
    stream = spark.readStream.schema(parts[0].schema).parquet(path)
    return J.run_while_fed(J.rechunk_stream(stream, 4, 6, late="1 minute"), out, state, parts, path)[0]


@query("x4_observed_stream", f"WITH {WORDS}, t AS ({terms_sql(16, 1, 64)}) SELECT count(*) AS n_words, sum(term)::BIGINT AS terms FROM t")
def _(spark, sf):
    """A stream that is observed while it is written; a listener adds up what each micro-batch reports."""
    watch = J.StepWatch("words")
    spark.streams.addListener(watch)
    try:
        out, state = _paths(spark, "observed")
        stream = as_stream(spark, words(spark, sf).select("stream_id", "seq", "word"), "observed")
        J.run_to_end(stream.observe("words", *frame_metrics(16)), out, state)
        if not watch.ended.wait(60):
            raise TimeoutError("the listener was not told of the end")
    finally:
        spark.streams.removeListener(watch)
    return spark.createDataFrame([(watch.totals["n_words"], watch.totals["terms"])], "n_words bigint, terms bigint")


@query("e8_accuracy_stream", _PRED + " SELECT label % 3 AS run_id, count(*) FILTER (predicted = label) AS ok, count(*) FILTER (predicted <> label) AS nok, count(*) FILTER (predicted = label) * 100.0::DOUBLE / count(*) AS accuracy FROM p GROUP BY 1")
def _(spark, sf):
    p = predictions(spark, sf).withColumn("run_id", F.col("label") % 3)
    out, state = _paths(spark, "accuracy")
    running = J.accuracy_stream(as_stream(spark, p, "accuracy"))
    J.keep_latest(running, out, state, ("run_id",), every=2).awaitTermination()
    return J.read_latest(spark, out, ("run_id",))


_WINDOWS = """SELECT (epoch_us(ts) // 3600000000) * 3600000000 AS start_us, event_type, count(*) AS n_items, count(*) / 3600.0::DOUBLE AS items_per_s, round(sum(octet_length(encode(props))) / 3600.0::DOUBLE, 9) AS bytes_per_s FROM events GROUP BY 1, 2"""


@query("e9_throughput_windows", _WINDOWS)
def _(spark, sf):
    w = J.throughput_windows(table(spark, sf, "events"), "ts", "1 hour", ("event_type",), size=F.octet_length("props"))
    return w.withColumn("bytes_per_s", F.round("bytes_per_s", 9))


@query("e9_throughput_stream", "SELECT (epoch_us(ts) // 86400000000) * 86400000000 AS start_us, count(*) AS n_items, count(*) / 86400.0::DOUBLE AS items_per_s, 0.0::DOUBLE AS bytes_per_s FROM events GROUP BY 1")
def _(spark, sf):
    windows = J.throughput_windows(as_stream(spark, table(spark, sf, "events").select("ts"), "throughput"), "ts", "1 day", late="60 days")
    out, state = _paths(spark, "throughput")
    J.keep_latest(windows, out, state, ("start_us",)).awaitTermination()
    return J.read_latest(spark, out, ("start_us",))


DAY_US = 86_400_000_000


@query(
    "e9_late_rows",
    f"""WITH e AS (SELECT epoch_us(ts) AS us, event_id % 4 = 0 AS after FROM events), m AS (SELECT (max(us) // 1000) * 1000 - 10 * {DAY_US} AS mark FROM e WHERE NOT after)
SELECT (us // {DAY_US}) * {DAY_US} AS start_us, count(*) AS n_given, count(*) FILTER (NOT after OR (us // {DAY_US} + 1) * {DAY_US} > mark) AS n_kept,
  count(*) FILTER (after AND (us // {DAY_US} + 1) * {DAY_US} <= mark) AS n_late FROM e, m GROUP BY 1""",
)
def _(spark, sf):
    """Three quarters of the events come in time; the last quarter comes after them, when windows that ended ten days before the newest event are closed."""
    path = scratch_path(spark, "late")
    events = table(spark, sf, "events").select("event_id", "ts")
    out, state = _paths(spark, "late")
    for part in ("event_id % 4 <> 0", "event_id % 4 = 0"):
        events.where(part).select("ts").write.mode("append").parquet(path)
        stream = spark.readStream.schema(events.select("ts").schema).parquet(path)
        J.keep_latest(J.throughput_windows(stream, "ts", "1 day", late="10 days"), out, state, ("start_us",)).awaitTermination()
    return J.late_rows(spark.read.parquet(path), J.read_latest(spark, out, ("start_us",)), "ts", "1 day")


@query("j8_fan_out_stream", "SELECT copy, count(*) AS n, sum(event_id)::BIGINT AS ids FROM events, range(2) r(copy) GROUP BY 1")
def _(spark, sf):
    paths = [scratch_path(spark, "fan-a"), scratch_path(spark, "fan-b")]
    J.fan_out(as_stream(spark, table(spark, sf, "events").select("event_id"), "fan"), paths, scratch_path(spark, "fan-state")).awaitTermination()
    parts = [spark.read.parquet(p).select("event_id", F.lit(i).alias("copy")) for i, p in enumerate(paths)]
    return parts[0].unionByName(parts[1]).groupBy("copy").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))
