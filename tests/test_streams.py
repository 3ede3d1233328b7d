"""State that ends, bases that bound what is read, observers."""

from datetime import datetime, timezone

from pyspark.sql import functions as F

from bitloom.operators import integrity, spatial
from bitloom.plans.catalog import streams
from bitloom.streaming import jobs


def words_of(spark, rows):
    at = [(s, i, w, datetime.fromtimestamp(1_700_000_000 + t, timezone.utc)) for s, i, w, t in rows]
    return spark.createDataFrame(at, "stream_id string, seq bigint, word bigint, ts timestamp").coalesce(1)


def test_incomplete_frames_leave_the_state(spark, tmp_path):
    """Frame 1 never ends, frame 2 ends in a later micro-batch but in time."""
    parts = [
        words_of(spark, [("a", i, i + 1, i) for i in (0, 1, 2, 3, 4, 6, 8, 9)]),
        words_of(spark, [("a", i, i + 1, i) for i in (10, 11)] + [("b", 0, 5, 11)]),
        words_of(spark, [("", 0, None, 10_000)]),
    ]
    source = str(tmp_path / "in")
    parts[0].limit(0).write.parquet(source)
    stream = spark.readStream.schema(parts[0].schema).parquet(source)
    out, query = jobs.run_while_fed(jobs.checksum_stream(stream, 4, late="5 seconds", wait_ms=60_000), str(tmp_path / "out"), str(tmp_path / "state"), parts, source)
    got = {(r.stream_id, r.frame): (r.checksum is not None, r.n_words) for r in out.collect()}
    assert got == {("a", 0): (True, 4), ("a", 1): (False, 2), ("a", 2): (True, 4), ("b", 0): (False, 1)}
    whole = {(r.stream_id, r.frame): r.checksum for r in integrity.frame_checksum(parts[0].union(parts[1]), 4).collect()}
    assert {k: v for k, v in whole.items()} == {(r.stream_id, r.frame): r.checksum for r in out.where("checksum is not null").collect()}
    assert query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] == 0


def test_reads_are_bounded_by_the_base(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    batches = 23
    for n in range(batches):
        spark.range(6).select(F.pmod(F.col("id") + n, F.lit(8)).alias("k"), F.lit(n).cast("long").alias("v")).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema("k bigint, v bigint").option("maxFilesPerTrigger", 1).parquet(source)
    counted = stream.groupBy("k").agg(F.max("v").alias("v"), F.count("*").alias("n"))
    jobs.keep_latest(counted, out, str(tmp_path / "state"), ("k",), every=4, buckets=2).awaitTermination()
    latest = jobs.read_latest(spark, out, ("k",))
    given = [((i + n) % 8, n) for n in range(batches) for i in range(6)]
    assert {(r.k, r.v, r.n) for r in latest.collect()} == {(k, max(n for q, n in given if q == k), sum(q == k for q, _ in given)) for k in range(8)}
    # the base of 20 micro-batches in at most 2 files, and three micro-batches since
    assert spark.read.parquet(f"{out}/published").agg(F.max("epoch")).first()[0] == 4
    assert sum("/bases/" in f for f in latest.inputFiles()) <= 2
    assert {f.split("/changes/")[1].split("/")[0] for f in latest.inputFiles() if "/changes/" in f} == {"epoch=5"}


def test_a_repeated_micro_batch_gives_the_same_base(spark, tmp_path):
    out = str(tmp_path / "out")
    row = spark.createDataFrame([(1, 5)], "k int, v int")
    for batch in (0, 1):
        jobs._replace_batch(row.withColumn("v", F.lit(batch)), f"{out}/changes/epoch=0", batch)
    once = jobs._latest_rows(spark, out, ("k",), 0).collect()
    jobs._replace_batch(row.withColumn("v", F.lit(1)), f"{out}/changes/epoch=0", 1)
    assert jobs._latest_rows(spark, out, ("k",), 0).collect() == once and once[0].v == 1


def test_differences_of_a_step(spark):
    words = spark.range(64).selectExpr("concat('s', id % 2) AS stream_id", "id DIV 2 AS seq", "id * 1000 AS word")
    changed = words.withColumn("word", F.when((F.col("stream_id") == "s1") & (F.col("seq") == 9), F.lit(-1)).otherwise(F.col("word")))
    lost = words.where("NOT (stream_id = 's0' AND seq >= 16)")
    assert sorted(map(tuple, integrity.frame_differences(words, words, 8).collect())) == [("s0", 4, 0), ("s1", 4, 0)]
    assert sorted(map(tuple, integrity.frame_differences(words, changed, 8).collect())) == [("s0", 4, 0), ("s1", 4, 1)]
    assert sorted(map(tuple, integrity.frame_differences(words, lost, 8).collect())) == [("s0", 4, 2), ("s1", 4, 0)]


def test_frames_of_a_run_share_one_state(spark, tmp_path):
    """Half of the words come first, so most frames are open; they are a row of the state a run, and not one each."""
    words = spark.range(6000).selectExpr("concat('s', id % 2) AS stream_id", "id DIV 2 AS seq", "id * 977 AS word", "array(id, -id, NULL, id * 3) AS vec")
    parts = [words.where(F.pmod(F.xxhash64("seq"), F.lit(2)) == p).coalesce(1) for p in range(2)]
    for name, job, wanted in (
        ("sums", lambda s: jobs.checksum_stream(s.drop("vec"), 4), integrity.frame_checksum(words, 4)),
        ("chunks", lambda s: jobs.rechunk_stream(s.drop("word"), 4, 6), spatial.rechunk(words, 6, n=4)),
    ):
        source = str(tmp_path / name)
        words.limit(0).write.parquet(source)
        stream = spark.readStream.schema(words.schema).parquet(source)
        out, query = jobs.run_while_fed(job(stream), str(tmp_path / f"{name}-out"), str(tmp_path / f"{name}-state"), parts, source)
        assert out.exceptAll(wanted).isEmpty() and out.count() == wanted.count()
        held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
        assert max(held) == 2 and held[-1] == 0


def test_words_of_a_run_leave_at_their_own_times(spark, tmp_path):
    """Of one run block 0 leaves incomplete while block 2 waits and ends in time, as block 1 did; nulls inside a word stay, and large numbers beside them."""
    big = (1 << 62) + 1

    def part(*rows):
        at = [(s, i, v, datetime.fromtimestamp(1_700_000_000 + t, timezone.utc)) for s, i, v, t in rows]
        return spark.createDataFrame(at, "stream_id string, seq bigint, vec array<bigint>, ts timestamp").coalesce(1)

    parts = [
        part(("a", 0, [1, 2], 0), ("a", 3, [big, None], 0), ("a", 4, [9, 10], 0)),
        part(("a", 5, [11, 12], 40), ("a", 6, [13, 14], 45), ("a", 7, [15, 16], 45)),
        part(("", 0, None, 70)),
        part(("a", 8, [None, 18], 70)),
        part(("b", 0, [0, 0], 71)),
        part(("", 0, None, 10_000)),
    ]
    source = str(tmp_path / "in")
    parts[0].limit(0).write.parquet(source)
    stream = spark.readStream.schema(parts[0].schema).parquet(source)
    out, query = jobs.run_while_fed(jobs.rechunk_stream(stream, 2, 3, late="5 seconds", wait_ms=60_000), str(tmp_path / "out"), str(tmp_path / "state"), parts, source)
    got = {(r.stream_id, r.seq): (r.vec, r.n_elements) for r in out.collect()}
    whole = {("a", 2): [big, None, 9], ("a", 3): [10, 11, 12], ("a", 4): [13, 14, 15], ("a", 5): [16, None, 18]}
    assert got == {k: (v, 3) for k, v in whole.items()} | {("a", 0): (None, 2), ("b", 0): (None, 2)}
    assert query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] == 0


def test_words_in_order_are_worked_out_once(spark):
    """The range, the parts and the last row read the saved words and not what they were made from."""
    words = spark.range(100).selectExpr("'a' AS stream_id", "id AS seq", "id * 3 AS word")
    parts = streams._in_order(words, "word")
    assert all("/in-order-" in f for p in parts for f in p.inputFiles()) and all(p.inputFiles() for p in parts)
    assert sorted(r.seq for p in parts[:-1] for r in p.collect()) == list(range(100))
    assert [(r.seq, r.word) for r in parts[-1].collect()] == [(99, None)]


def test_frames_of_a_run_leave_at_their_own_times(spark, tmp_path):
    """Three frames of a run are open: one leaves, one ends in time, one leaves later; they are one row of the state."""
    parts = [
        words_of(spark, [("a", 0, 1, 0), ("a", 4, 5, 20), ("a", 8, 9, 25)]),
        words_of(spark, [("a", i, i, 30) for i in (5, 6)]),
        words_of(spark, [("", 0, None, 70)]),
        words_of(spark, [("a", 7, 8, 70)]),
        words_of(spark, [("", 0, None, 10_000)]),
    ]
    source = str(tmp_path / "in")
    parts[0].limit(0).write.parquet(source)
    stream = spark.readStream.schema(parts[0].schema).parquet(source)
    out, query = jobs.run_while_fed(jobs.checksum_stream(stream, 4, late="5 seconds", wait_ms=60_000), str(tmp_path / "out"), str(tmp_path / "state"), parts, source)
    assert {(r.frame, r.checksum is not None, r.n_words) for r in out.collect()} == {(0, False, 1), (1, True, 4), (2, False, 1)}
    whole = integrity.frame_checksum(parts[0].union(parts[1]).union(parts[3]), 4)
    assert [r.checksum for r in whole.collect()] == [r.checksum for r in out.where("checksum is not null").collect()]
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert max(held) == 1 and held[-1] == 0, held


def test_a_stream_of_files_has_a_file_for_each_core(spark, tmp_path):
    rows = spark.range(4000).selectExpr("id")
    stream = streams.as_stream(spark, rows, "files")
    query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    cores = spark.sparkContext.defaultParallelism
    read = [p["numInputRows"] for p in query.recentProgress if p["numInputRows"]]
    assert len(read) == streams.PARTS and sum(read) == 4000
    assert all(abs(n - 4000 / streams.PARTS) <= 2 * cores for n in read)
    source = spark.read.parquet(query.lastProgress["sources"][0]["description"].removeprefix("FileStreamSource[").removesuffix("]"))
    assert len(source.inputFiles()) == streams.PARTS * cores
