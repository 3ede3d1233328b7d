"""Structured Streaming jobs.

Rows carry their sequence number, so frames and words are cut by number and not by arrival. State
is keyed by a run of consecutive frames or blocks of words, which spreads one busy stream over all tasks, and
holds what is open of them: a frame or word leaves it when it is complete.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from itertools import compress
from math import gcd
from threading import Event

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener
from pyspark.sql.streaming.query import StreamingQuery

from ..functions.scalars import clock_micros, whole_div
from ..operators.integrity import MODULUS, frame_terms

Chain = Callable[[DataFrame, DataFrame], DataFrame]

#: micro-batches between two bases of ``keep_latest``, and files of a base
COMPACT_EVERY = 16
COMPACT_BUCKETS = 8
#: words, and elements, of the frames and blocks that share one state: a call of Python and a write of the state serve so many
RUN_WORDS = 1 << 12
RUN_ELEMENTS = 1 << 14


def score_stream(stream: DataFrame, chain: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, order: str = "row_id", keys: tuple[str, ...] = (), trigger: dict | None = None) -> StreamingQuery:
    """Score each micro-batch and append it, ordered per key inside every file."""

    def write(batch: DataFrame, batch_id: int) -> None:
        scored = chain(batch).withColumn("batch", F.lit(batch_id))
        _replace_batch(scored.sortWithinPartitions(*keys, order), out, batch_id)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**_when(trigger)).start()


def _when(trigger: dict | None) -> dict:
    """The given trigger, such as ``{"processingTime": "1 minute"}``; by default a query ends with what is there."""
    return {"availableNow": True} if trigger is None else trigger


def _replace_batch(df: DataFrame, out: str, batch_id: int) -> None:
    """Write a micro-batch to its own partition; a repeated batch replaces itself."""
    df.drop("batch").write.mode("overwrite").parquet(f"{out}/batch={batch_id}")


def score_with_params(stream: DataFrame, read_params: Callable[[], DataFrame], chain: Chain, out: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """As ``score_stream`` with parameters read anew for every micro-batch, so they can be swapped."""

    def write(batch: DataFrame, batch_id: int) -> None:
        _replace_batch(chain(batch, read_params()), out, batch_id)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**_when(trigger)).start()


def publish_params(params: DataFrame, root: str, version: int) -> None:
    """Write a version, compare what was written with what was given, and only then name it as readable.

    Readers go by the list of published versions, so a version that is still being written, or
    whose writing failed, is never read. The same version must not be published twice.
    """
    spark, path = params.sparkSession, f"{root}/rows/version={version}"
    params.write.mode("overwrite").parquet(path)
    written = spark.read.schema(params.schema).parquet(path)
    if not params.exceptAll(written).isEmpty() or not written.exceptAll(params).isEmpty():
        raise ValueError(f"version {version} is not as given")
    spark.range(1).select(F.lit(version).cast("long").alias("version")).write.mode("append").parquet(f"{root}/published")


def latest_params(spark, root: str) -> DataFrame:
    """The newest published version, read when this is called; its number is the column ``version``."""
    newest = spark.read.parquet(f"{root}/published").agg(F.max("version")).first()[0]
    return spark.read.parquet(f"{root}/rows/version={newest}").withColumn("version", F.lit(newest))


class _Open(StatefulProcessor):
    """What waits until it is complete: the open frames, or the words, of one run. With ``wait_ms`` they leave, incomplete, that long after their first rows.

    The state is a table by columns; ``due`` says when a row of it leaves. A run has one timer, at the earliest of them (``armed``).
    """

    def __init__(self, columns: tuple[str, ...], per_run: int, wait_ms: int | None) -> None:
        self.columns, self.per_run, self.wait_ms = (*columns, "due"), per_run, wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        fields = [f"{c} ARRAY<BIGINT>" for c in self.columns]
        self.handle, self.state = handle, handle.getValueState("open", ", ".join([*fields, "armed BIGINT"]))

    def held(self) -> tuple[list, int | None]:
        """The columns of what waits, and when the timer ends."""
        if not self.state.exists():
            return [[] for _ in self.columns], None
        *columns, armed = self.state.get()
        return columns, armed

    def keep(self, columns: list[list], armed: int | None) -> None:
        """Hold this and move the timer from ``armed`` to the earliest ``due``."""
        until = min(columns[-1]) if self.wait_ms is not None and columns[-1] else None
        if until != armed:
            if armed is not None:
                self.handle.deleteTimer(armed)
            if until is not None:
                self.handle.registerTimer(until)
        if columns[-1]:
            self.state.update((*columns, until))
        elif self.state.exists():
            self.state.clear()

    def due(self, clock: np.ndarray) -> np.ndarray:
        """When rows leave whose newest event time is ``clock``."""
        if self.wait_ms is None:
            return np.zeros(len(clock), np.int64)
        if np.isnan(clock).any():
            raise ValueError("a row that has to wait has no event time")
        return clock.astype(np.int64) + self.wait_ms

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        columns, armed = self.held()
        if not columns[-1]:
            return
        ended, due = expiredTimerInfo.getExpiryTimeInMs(), np.array(columns[-1], np.int64)
        leave = (due <= ended) | (due <= timerValues.getCurrentWatermarkInMs())
        gone, rest = (self.where(columns, mask) for mask in (leave, ~leave))
        # the timer that has just ended is removed by Spark
        self.keep(rest, None if armed == ended else armed)
        if gone[-1]:
            yield self.left(key, gone)

    def where(self, columns: list[list], mask: np.ndarray) -> list[list]:
        """The rows of the state for which ``mask`` holds."""
        return [list(compress(c, mask)) for c in columns]

    def number(self, key, at) -> pd.Series:
        """Numbers of frames or blocks from their places in the run; null where the rows have no number."""
        numbers = pd.Series(np.asarray(at, np.int64), dtype="Int64")
        return numbers + int(key[1]) * self.per_run if not pd.isna(key[1]) else numbers.mask(numbers.notna())

    def left(self, key, columns: list[list]) -> pd.DataFrame:
        raise NotImplementedError

    def close(self) -> None:
        pass


class _OpenFrames(_Open):
    """Sums of the frames of a run until all their words have come."""

    def __init__(self, n_words: int, per_run: int, wait_ms: int | None) -> None:
        super().__init__(("place", "s", "n"), per_run, wait_ms)
        self.n_words = n_words

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        came = pd.concat([self._sums(part) for part in rows]).groupby("place", as_index=False).agg({"s": "sum", "n": "sum", "clock": "max"})
        whole = came["n"] >= self.n_words
        # a frame that is whole within the micro-batch never touches the state
        done, came = came[whole], came[~whole]
        if len(came):
            columns, armed = self.held()
            before = pd.DataFrame(dict(zip(self.columns, columns)), dtype="int64")
            met = before["place"].isin(came["place"])
            totals = pd.concat([before[met], came]).groupby("place", as_index=False).agg({"s": "sum", "n": "sum", "due": "first", "clock": "last"})
            whole = totals["n"] >= self.n_words
            done, waits = pd.concat([done, totals[whole]]), totals[~whole].copy()
            fresh = waits["due"].isna().to_numpy()
            waits.loc[fresh, "due"] = self.due(waits["clock"].to_numpy("float64")[fresh])
            after = pd.concat([before[~met], waits])
            self.keep([after[c].astype("int64").tolist() for c in self.columns], armed)
        if len(done):
            frame = self.number(key, done["place"])
            yield self._rows(key, frame, frame % 256 * MODULUS + (done["s"] % MODULUS).astype("int64").to_numpy(), done["n"])

    @staticmethod
    def _sums(part: pd.DataFrame) -> pd.DataFrame:
        part = part.assign(clock=part["clock"] if "clock" in part else np.nan, n=1)
        sums = part.groupby("place", as_index=False).agg({"term": "sum", "n": "sum", "clock": "max"})
        return sums.rename(columns={"term": "s"}).astype({"s": "int64", "clock": "float64"}).assign(due=np.nan)

    def left(self, key, columns: list[list]) -> pd.DataFrame:
        at, _, n, _ = columns
        return self._rows(key, self.number(key, at), None, n)

    def _rows(self, key, frame: pd.Series, checksum, n) -> pd.DataFrame:
        rows = pd.DataFrame({"stream_id": [key[0]] * len(frame), "frame": frame, "checksum": pd.array([None] * len(frame), "Int64") if checksum is None else checksum})
        return rows if self.wait_ms is None else rows.assign(n_words=np.asarray(n, np.int64))


def _clocked(words: DataFrame, late: str | None) -> tuple[DataFrame, list[str], str]:
    """Rows with ``ts`` as event time, the columns that go with it, and the time mode. A row without a word only moves the watermark."""
    if late is None:
        return words, [], "None"
    # the filter names ts, so that it stays above the watermark and does not hide such a row from it
    timed = words.withWatermark("ts", late).where((~F.col("idle")) | F.col("ts").isNull())
    return timed.withColumn("clock", F.unix_millis("ts")), ["ts", "clock"], "EventTime"


def _in_run(number: Column, per_run: int) -> list[Column]:
    """The run of a frame or block, and its place there."""
    run = whole_div(number, per_run)
    return [run.alias("run"), F.coalesce(number - run * per_run, F.lit(0)).cast("long").alias("place")]


def checksum_stream(words: DataFrame, n_words: int, k: int = 1, bits: int = 64, late: str | None = None, wait_ms: int = 60_000) -> DataFrame:
    """Frame checksums of a stream; frames may span micro-batches.

    With ``late`` the words have an event time ``ts``. A frame that is incomplete ``wait_ms`` after its first words, by the
    watermark, leaves the state as a row without checksum; ``n_words`` says how many words had come. Rows whose word is null move the watermark only.
    """
    timed, more, mode = _clocked(words.withColumn("idle", F.col("word").isNull()), late)
    per_run = max(1, RUN_WORDS // n_words)
    terms = frame_terms(timed, n_words, k, bits).select("stream_id", *_in_run(F.col("frame"), per_run), "term", *more)
    schema = "stream_id STRING, frame BIGINT, checksum BIGINT" + (", n_words BIGINT" if late else "")
    return terms.groupBy("stream_id", "run").transformWithStateInPandas(
        statefulProcessor=_OpenFrames(n_words, per_run, wait_ms if late else None), outputStructType=schema, outputMode="Append", timeMode=mode
    )


class _OpenWords(_Open):
    """Words of the blocks of a run until all have come; a block has one common multiple of both widths. All elements are in one column, ``size`` of them a word."""

    def __init__(self, span: int, m: int, per_run: int, wait_ms: int | None) -> None:
        super().__init__(("x", "size", "block", "at"), per_run, wait_ms)
        self.span, self.m = span, m

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        words = pd.concat(list(rows), ignore_index=True)
        columns, armed = self.held()
        old, new = len(columns[-1]), len(words)
        gap = np.array([x is None for x in columns[0]], bool)
        x = np.concatenate([np.array([0 if v is None else v for v in columns[0]] if gap.any() else columns[0], np.int64), *words["vec"]])
        if words["gaps"].notna().any():
            gaps = [np.zeros(len(v), bool) if g is None else np.asarray(g, bool) for v, g in zip(words["vec"], words["gaps"])]
        else:
            gaps = [np.zeros(len(x) - len(gap), bool)]
        gap = np.concatenate([gap, *gaps])
        size = np.concatenate([np.array(columns[1], np.int64), words["vec"].map(len).to_numpy(np.int64)])
        block, at = (np.concatenate([np.array(c, np.int64), words[name].to_numpy(np.int64)]) for c, name in ((columns[2], "place"), (columns[3], "at")))
        came = np.arange(old + new) >= old
        blocks, of = np.unique(block, return_inverse=True)

        # a block that is whole within the micro-batch never touches the state
        alone = np.bincount(of[came], size[came], len(blocks)) >= self.span
        whole = alone | (np.bincount(of, size, len(blocks)) >= self.span)
        done = np.where(alone[of], came, whole[of])
        wait = np.flatnonzero(~done)
        clock = np.full(len(blocks), np.nan)
        if self.wait_ms is not None:
            np.fmax.at(clock, of[came], words["clock"].to_numpy("float64"))
        due = np.zeros(len(blocks), np.int64)
        due[of[:old]] = columns[-1]
        fresh = ~whole & (np.bincount(of[:old], minlength=len(blocks)) == 0)
        due[fresh] = self.due(clock[fresh])
        cells = _cells_of(wait, size)
        kept = x[cells].tolist()
        for i in np.flatnonzero(gap[cells]).tolist():
            kept[i] = None
        if len(wait) or old:
            self.keep([kept, *(c[wait].tolist() for c in (size, block, at, due[of]))], armed)

        order = np.flatnonzero(done)
        if len(order):
            order = order[np.lexsort((at[order], of[order]))]
            cells, owner = _cells_of(order, size), np.repeat(of[order], size[order])
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            within = np.arange(len(owner)) - np.repeat(first, np.diff(np.r_[first, len(owner)]))
            cells = cells[within < self.span].reshape(-1, self.m)
            vecs = list(x[cells])
            for i in np.flatnonzero(gap[cells].any(axis=1)).tolist():
                vecs[i] = [None if g else v for v, g in zip(vecs[i].tolist(), gap[cells[i]])]
            each = self.span // self.m
            seq = self.number(key, np.repeat(blocks[owner[first]], each)) * each + np.tile(np.arange(each), len(first))
            done = pd.DataFrame({"stream_id": [key[0]] * len(vecs), "seq": seq, "vec": pd.Series(vecs, dtype=object)})
            yield done if self.wait_ms is None else done.assign(n_elements=self.m)

    def where(self, columns: list[list], mask: np.ndarray) -> list[list]:
        x, *rest = columns
        return [list(compress(x, np.repeat(mask, rest[0]))), *super().where(rest, mask)]

    def left(self, key, columns: list[list]) -> pd.DataFrame:
        _, size, block, _, _ = columns
        n = pd.DataFrame({"block": block, "size": size}).groupby("block", as_index=False)["size"].sum()
        first = self.number(key, n["block"]) * (self.span // self.m)
        return pd.DataFrame({"stream_id": [key[0]] * len(n), "seq": first, "vec": pd.Series([None] * len(n), dtype=object), "n_elements": n["size"]})


def _cells_of(words: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Where the elements of the given words lie, word by word."""
    start = np.cumsum(size) - size
    n = size[words]
    return np.repeat(start[words] - (np.cumsum(n) - n), n) + np.arange(n.sum())


def rechunk_stream(words: DataFrame, n: int, m: int, late: str | None = None, wait_ms: int = 60_000) -> DataFrame:
    """Words of ``n`` elements to words of ``m``; left-over elements wait for the next micro-batch.

    With ``late`` the words have an event time ``ts``. Elements that cannot be completed leave ``wait_ms`` after the first of
    them, by the watermark, as one row without a vector at the first of their words; ``n_elements`` says how many there were.
    Rows whose vector is null move the watermark only.
    """
    span = n * m // gcd(n, m)
    per_run = max(1, RUN_ELEMENTS // span)
    timed, more, mode = _clocked(words.withColumn("idle", F.col("vec").isNull()), late)
    vec = F.col("vec").cast("array<bigint>")
    # an array with a null comes to Python as floats, so nulls go beside the numbers
    numbers = F.transform(vec, lambda x: F.coalesce(x, F.lit(0).cast("long"))).alias("vec")
    gaps = F.when(F.exists(vec, lambda x: x.isNull()), F.transform(vec, lambda x: x.isNull())).alias("gaps")
    at = F.coalesce(F.pmod(F.col("seq") * n, F.lit(span)), F.lit(0)).cast("long")
    placed = timed.select("stream_id", *_in_run(whole_div(F.col("seq") * n, span), per_run), at.alias("at"), numbers, gaps, *more)
    schema = "stream_id STRING, seq BIGINT, vec ARRAY<BIGINT>" + (", n_elements BIGINT" if late else "")
    return placed.groupBy("stream_id", "run").transformWithStateInPandas(
        statefulProcessor=_OpenWords(span, m, per_run, wait_ms if late else None), outputStructType=schema, outputMode="Append", timeMode=mode
    )


def accuracy_stream(predictions: DataFrame, by: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """Running OK and NOK per run; use output mode ``update`` or ``complete``."""
    ok = F.count_if(F.col("predicted") == F.col("label"))
    return predictions.groupBy(*by).agg(ok.alias("ok"), (F.count("*") - ok).alias("nok"), (ok * 100.0 / F.count("*")).alias("accuracy"))


def throughput_windows(events: DataFrame, ts: str, width: str, by: tuple[str, ...] = (), late: str | None = None, size=None) -> DataFrame:
    """Items and bytes per second in time windows; with ``late`` a watermark drops later rows.

    A timestamp without time zone counts as UTC, so windows are the same in every session.
    """
    source = events
    if isinstance(events.schema[ts].dataType, T.TimestampNTZType):
        source = events.withColumn(ts, F.timestamp_micros(clock_micros(F.col(ts))))
    source = source.withWatermark(ts, late) if late else source
    bytes_ = F.sum(size) if size is not None else F.lit(0)
    start = F.unix_micros("window.start")
    seconds = (F.unix_micros("window.end") - start) / 1e6
    grouped = source.groupBy(F.window(ts, width), *by).agg(F.count("*").alias("n_items"), bytes_.alias("n_bytes"))
    return grouped.select(
        start.alias("start_us"), *by, "n_items", (F.col("n_items") / seconds).alias("items_per_s"), (F.col("n_bytes") / seconds).alias("bytes_per_s")
    )


def keep_latest(df: DataFrame, out: str, checkpoint: str, key: tuple[str, ...], trigger: dict | None = None, every: int = COMPACT_EVERY, buckets: int = COMPACT_BUCKETS) -> StreamingQuery:
    """Write the changed rows of a running aggregate, one partition per micro-batch.

    After each ``every`` micro-batches the newest row of each key goes to a new base of at most ``buckets`` files. A reader takes the
    newest base that was published whole and the changes since, however long the stream has run. A repeated
    micro-batch replaces its changes and its base.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        epoch = batch_id // every
        _replace_batch(batch, f"{out}/changes/epoch={epoch}", batch_id)
        if batch_id % every == every - 1:
            spark = batch.sparkSession
            _latest_rows(spark, out, key, epoch).repartition(buckets, *key).write.mode("overwrite").parquet(f"{out}/bases/epoch={epoch}")
            spark.range(1).select(F.lit(epoch).cast("long").alias("epoch")).coalesce(1).write.mode("append").parquet(f"{out}/published")

    return df.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**_when(trigger)).start()


def _if_there(spark, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _latest_rows(spark, out: str, key: tuple[str, ...], epoch: int) -> DataFrame:
    """The newest row of each key up to an epoch, from the base before it and its changes."""
    changes = _if_there(spark, f"{out}/changes/epoch={epoch}")
    base = spark.read.parquet(f"{out}/bases/epoch={epoch - 1}").withColumn("batch", F.lit(-1)) if epoch else None
    if base is None or changes is None:
        rows = base if changes is None else changes
        if rows is None:
            raise ValueError(f"no micro-batch was written to {out}")
    else:
        rows = base.unionByName(changes.withColumn("batch", F.col("batch").cast("int")))
    value = F.struct(*[c for c in rows.columns if c not in (*key, "batch")])
    return rows.groupBy(*key).agg(F.max_by(value, "batch").alias("_v")).select(*key, "_v.*")


def read_latest(spark, out: str, key: tuple[str, ...]) -> DataFrame:
    """The newest row of each key from ``keep_latest``."""
    published = _if_there(spark, f"{out}/published")
    newest = -1 if published is None else published.agg(F.max("epoch")).first()[0]
    return _latest_rows(spark, out, key, newest + 1)


def dropped_rows(query: StreamingQuery) -> int:
    """Rows a finished or running query left out because they came after the watermark."""
    return sum(op.get("numRowsDroppedByWatermark", 0) for p in query.recentProgress for op in p["stateOperators"])


def late_rows(given: DataFrame, latest: DataFrame, ts: str, width: str) -> DataFrame:
    """Rows of each window that were given, that the windows of ``throughput_windows`` hold, and that came after the watermark."""
    n = throughput_windows(given, ts, width).select("start_us", F.col("n_items").alias("n_given"))
    kept = latest.groupBy("start_us").agg(F.sum("n_items").alias("n_kept"))
    counted = n.join(kept, "start_us", "left").select("start_us", "n_given", F.coalesce("n_kept", F.lit(0).cast("long")).alias("n_kept"))
    return counted.withColumn("n_late", F.col("n_given") - F.col("n_kept"))


def fan_out(stream: DataFrame, paths: list[str], checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """The same micro-batch for several consumers."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        for p in paths:
            _replace_batch(batch, p, batch_id)
        batch.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**_when(trigger)).start()


@contextmanager
def keyed_state_store(spark) -> Iterator[None]:
    """State of the stateful processors needs the RocksDB store; a running query keeps its setting."""
    key, wanted = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(key, None)
    spark.conf.set(key, wanted)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def run_to_end(df: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Process what is there, append to Parquet, and read the result back."""
    with keyed_state_store(df.sparkSession):
        query = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(out)


def run_while_fed(df: DataFrame, out: str, checkpoint: str, parts: Iterable[DataFrame], source: str) -> tuple[DataFrame, StreamingQuery]:
    """One query that keeps running while the parts are appended to the folder it reads, each as a micro-batch of its own or several in order."""
    with keyed_state_store(df.sparkSession):
        query = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").start()
    feed(query, parts, source)
    return df.sparkSession.read.schema(df.schema).parquet(out), query


def feed(query: StreamingQuery, parts: Iterable[DataFrame | Callable[[], None]], source: str) -> None:
    """Append each part to the folder a query reads and wait until it is processed; a part may also be an action between two of them."""
    try:
        for part in parts:
            if callable(part):
                part()
                continue
            part.write.mode("append").parquet(source)
            query.processAllAvailable()
    finally:
        query.stop()


class StepWatch(StreamingQueryListener):
    """Adds up what ``DataFrame.observe`` reports under a name, over the micro-batches of a query."""

    def __init__(self, name: str) -> None:
        self.name, self.totals, self.ended = name, {}, Event()

    def onQueryStarted(self, event) -> None:
        self.ended.clear()

    def onQueryProgress(self, event) -> None:
        row = event.progress.observedMetrics.get(self.name)
        for k, v in ({} if row is None else row.asDict()).items():
            self.totals[k] = self.totals.get(k, 0) + (v or 0)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.set()
