"""Trace statistics, throughput and buffer sizing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import whole_div
from ..session import cut_lineage
from ..sizing import param_join
from .ranking import rank_by
from .scans import block_scan

# Signal name endings of a streaming interface, and the parts of a queue counter's name.
VALID, READY = "TVALID", "TREADY"
QUEUE, COUNTER = "StreamingFIFO", "count"

#: a recorded clock cycle spans 4 samples of 5 time units
TICKS = 20


def list_interfaces(signals: DataFrame) -> DataFrame:
    """Base names that have both a valid and a ready signal."""
    name = F.col("signal")
    base = F.when(name.endswith(VALID), F.expr(f"left(signal, length(signal) - {len(VALID)})")).when(
        name.endswith(READY), F.expr(f"left(signal, length(signal) - {len(READY)})")
    )
    kinds = signals.select(base.alias("iface"), name.endswith(VALID).alias("v")).where(F.col("iface").isNotNull())
    both = kinds.groupBy("iface").agg(F.max("v").alias("has_v"), F.max(~F.col("v")).alias("has_r"))
    return both.where("has_v AND has_r").select("iface")


def list_queue_counters(signals: DataFrame) -> DataFrame:
    return signals.where(F.col("signal").contains(QUEUE) & F.col("signal").contains(COUNTER)).select("signal").distinct()


def interface_events(trace: DataFrame) -> DataFrame:
    """``(iface, kind, t, val)`` from raw signals, for complete interfaces only."""
    name = F.col("signal")
    kind = F.when(name.endswith(VALID), "V").when(name.endswith(READY), "R")
    tagged = trace.select(kind.alias("kind"), F.expr(f"left(signal, length(signal) - {len(VALID)})").alias("iface"), "t", "val").where(
        F.col("kind").isNotNull()
    )
    return param_join(tagged, cut_lineage(list_interfaces(trace.select("signal"))), ["iface"], "left_semi", spread=["t"])


def interface_stats(events: DataFrame, end_time: int | None = None, block_bits: int = 20) -> DataFrame:
    """Clock edges and fraction of time per interface and state ``(v, r)``.

    ``events(iface, kind, t, val)`` holds changes, at most one per signal and time. Each change
    closes an interval that counts for the state before it; the count is cut to whole clock
    cycles per interval. Long interfaces are scanned block by block of time.
    """
    ifaces = cut_lineage(events.groupBy("iface").agg(F.max("t").alias("last")))
    end = F.lit(end_time).cast("long") if end_time is not None else ifaces.agg(F.max("last")).scalar()
    marks = ifaces.select("iface", F.explode(F.array(F.lit("V"), F.lit("R"))).alias("kind"))
    marks = marks.select("iface", "kind", end.alias("t"), F.lit(0).alias("val"), F.lit(1).alias("mark"))
    every = events.select("iface", "kind", "t", F.col("val").cast("int"), F.lit(0).alias("mark")).unionByName(marks)
    every = every.withColumn("k", F.when(F.col("kind") == "V", 0).otherwise(1))
    seen = block_scan(
        every,
        ["iface"],
        ["t", "k", "mark"],
        lasts={
            "v": F.when(F.col("kind") == "V", F.col("val")),
            "r": F.when(F.col("kind") == "R", F.col("val")),
            "since": F.col("t"),
        },
        inclusive=False,
        block_bits=block_bits,
    )
    edges = whole_div(F.col("t") - F.coalesce("since", F.lit(0)), TICKS)
    v, r = F.coalesce("v", F.lit(0)), F.coalesce("r", F.lit(0))
    sums = seen.groupBy("iface").agg(
        *[F.sum(F.when((v == a) & (r == b), edges).otherwise(0)).alias(f"s{a}{b}") for a in (0, 1) for b in (0, 1)]
    )
    states = F.array(*[F.struct(F.lit(a).alias("v"), F.lit(b).alias("r"), F.col(f"s{a}{b}").alias("n")) for a in (0, 1) for b in (0, 1)])
    total = sum((F.col(f"s{a}{b}") for a in (0, 1) for b in (0, 1)), F.lit(0))
    long = sums.select("iface", total.alias("total"), F.explode(states).alias("s"))
    return long.select("iface", "s.v", "s.r", "s.n", F.when(F.col("total") > 0, F.col("s.n") / F.col("total")).alias("fraction"))


def rank_interfaces(stats: DataFrame, v: int = 1, r: int = 0) -> DataFrame:
    """Interfaces by the fraction of one state, ascending; the default state is back-pressure."""
    return rank_by(stats.where((F.col("v") == v) & (F.col("r") == r)), "fraction", ["iface"])


def peak_fill(trace: DataFrame) -> DataFrame:
    """Largest value per counter, 0 when never above."""
    return trace.groupBy("signal").agg(F.greatest(F.max("val"), F.lit(0)).alias("peak"))


def cumulative_flow(txns: DataFrame, period: int, block_bits: int = 20) -> DataFrame:
    """Transfers so far at each of ``2 * period`` cycles; the second period repeats the first.

    ``txns(stream_id, cycle)`` lists cycles with a transfer; a cycle outside the period fails.
    """
    inside = F.when(F.col("cycle") >= period, F.raise_error(F.lit("cycle outside the period"))).otherwise(F.col("cycle"))
    moved = txns.select("stream_id", inside.cast("long").alias("t"), F.lit(1).alias("x"))
    grid = txns.select("stream_id").distinct().select("stream_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(period - 1).cast("long"))).alias("t"))
    dense = moved.unionByName(grid.withColumn("x", F.lit(0))).groupBy("stream_id", "t").agg(F.max("x").alias("x"))
    level = block_scan(dense, ["stream_id"], ["t"], sums={"level": F.col("x").cast("long")}, block_bits=block_bits, order_bits=int(period).bit_length())
    totals = moved.distinct().groupBy("stream_id").agg(F.count("*").alias("total"))
    both = param_join(level, totals, ["stream_id"], spread=["t"]).withColumn("rep", F.explode(F.array(F.lit(0), F.lit(1))))
    return both.select("stream_id", (F.col("t") + F.col("rep") * period).alias("t"), (F.col("level") + F.col("rep") * F.col("total")).alias("level"))


def buffer_depth(prod: DataFrame, cons: DataFrame, period: int) -> DataFrame:
    """Smallest phase shift and buffer depth per edge; flows ``(edge_id, t, level)`` over two periods.

    Flows rise by at most one per cycle, so the first cycle at which the producer reaches a level
    is an equality join on the level; no pair of cycles is compared.
    """
    prod, cons = cut_lineage(prod), cut_lineage(cons)
    early_p, early_c = prod.where(F.col("t") < period), cons.where(F.col("t") < period)
    reach = early_p.groupBy("edge_id", "level").agg(F.min("t").alias("tau"))
    need = early_c.groupBy("edge_id", "level").agg(F.min("t").alias("t0"))
    start = early_p.where("t = 0").select("edge_id", F.col("level").alias("base"))
    joined = param_join(need.join(reach, ["edge_id", "level"], "left"), start, ["edge_id"], "left", spread=["level"])
    tau = F.when(F.col("level") <= F.col("base"), F.lit(0)).otherwise(F.coalesce("tau", F.lit(period)))
    wait = F.greatest(tau - F.col("t0"), F.lit(0))
    shift = joined.groupBy("edge_id").agg(F.least(F.max(wait), F.lit(period - 1)).alias("shift"))
    late = param_join(early_c, shift, ["edge_id"], spread=["t"]).select("edge_id", "shift", (F.col("t") + F.col("shift")).alias("t"), F.col("level").alias("c"))
    gaps = late.join(prod.select("edge_id", "t", F.col("level").alias("p")), ["edge_id", "t"])
    return gaps.groupBy("edge_id").agg(F.max("shift").alias("shift"), F.max(F.col("p") - F.col("c")).alias("depth"))


def transfer_depth(prod: DataFrame, cons: DataFrame, period: int, block_bits: int = 20) -> DataFrame:
    """As ``buffer_depth`` from the transfers ``(edge_id, cycle)`` themselves: a row per transfer and none per idle cycle.

    The n-th transfer of the consumer waits for the n-th of the producer. The fill level rises with
    transfers of the producer only, so its peak is among the levels after each cycle that has one.
    """
    inside = F.when(F.col("cycle") >= period, F.raise_error(F.lit("cycle outside the period"))).otherwise(F.col("cycle"))
    prod, cons = [df.select("edge_id", inside.cast("long").alias("t")).distinct() for df in (prod, cons)]
    bits = int(period).bit_length()
    nth_p, nth_c = [block_scan(df, ["edge_id"], ["t"], sums={"n": F.lit(1).cast("long")}, block_bits=block_bits, order_bits=bits) for df in (prod, cons)]
    met = nth_c.join(nth_p.withColumnRenamed("t", "tau"), ["edge_id", "n"], "left")
    wait = F.greatest(F.coalesce("tau", F.lit(period)) - F.col("t"), F.lit(0))
    shift = met.groupBy("edge_id").agg(F.least(F.max(wait), F.lit(period - 1)).cast("int").alias("shift"))
    # cycles of the consumer's period; what the producer moved before it is there at its first cycle
    twice = prod.select("edge_id", F.explode(F.array(F.col("t"), F.col("t") + period)).alias("t")).join(shift, "edge_id")
    later = twice.select("edge_id", F.greatest(F.col("t") - F.col("shift"), F.lit(0)).alias("t"), F.lit(1).alias("d"), "shift").where(F.col("t") < period)
    taken = [F.struct(F.col("t"), F.lit(-1).alias("d")), F.struct(F.lit(0).cast("long").alias("t"), F.lit(0).alias("d"))]
    taken = cons.select("edge_id", F.explode(F.array(*taken)).alias("m")).select("edge_id", "m.*", F.lit(None).cast("int").alias("shift"))
    moves = later.unionByName(taken).groupBy("edge_id", "t").agg(F.sum("d").alias("d"), F.max("shift").alias("shift"))
    fill = block_scan(moves, ["edge_id"], ["t"], sums={"fill": F.col("d")}, block_bits=block_bits, order_bits=bits)
    peaks = fill.groupBy("edge_id").agg(F.max("shift").alias("shift"), F.max("fill").alias("depth"))
    return peaks.where(F.col("shift").isNotNull())


def edge_depths(edges: DataFrame, depths: DataFrame, default: int = 32) -> DataFrame:
    """Depth of every edge; edges at the rim of a graph, without flows, get the default."""
    return edges.join(depths, ["edge_id"], "left").withColumn("depth", F.coalesce("depth", F.lit(default)))


def round_depth(depth):
    """2 up to 2, 32 up to 32, above that as it is."""
    return F.when(depth <= 2, F.lit(2)).when(depth <= 32, F.lit(32)).otherwise(depth)


def throughput(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Runtime, items/s and MB/s per group of runs ``(n_items, runtime_s, bytes_in, bytes_out)``."""
    t = F.sum("runtime_s")
    return df.groupBy(*by).agg(
        F.sum("n_items").alias("batch_size"),
        (t * 1000).alias("runtime_ms"),
        (F.sum("n_items") / t).alias("items_per_s"),
        (F.sum("bytes_in") * 0.000001 / t).alias("mb_in_per_s"),
        (F.sum("bytes_out") * 0.000001 / t).alias("mb_out_per_s"),
    )


def steady_state(runs: DataFrame) -> DataFrame:
    """Throughput without the first item's latency; ``runs(run_id, batch, cycles, clk_ns)``.

    Each run has a row for batch 1 and one for its full batch; both meet in one aggregate.
    """
    big = F.max("batch")
    total, first = F.max_by("cycles", "batch"), F.min_by("cycles", "batch")
    per = runs.groupBy("run_id").agg(big.alias("batch"), total.alias("cycles"), first.alias("latency_cycles"), F.max("clk_ns").alias("clk_ns"))
    used = F.when(F.col("batch") == 1, F.col("cycles")).otherwise(F.col("cycles") - F.col("latency_cycles"))
    return per.withColumn("stable_items_per_s", F.col("batch") / (used * F.col("clk_ns") * 1e-9))


def batch_regression(runs: DataFrame, by: tuple[str, ...] = ("run_group",)) -> DataFrame:
    """Fixed overhead and time per item from runtime over batch size."""
    return runs.groupBy(*by).agg(
        F.regr_intercept("runtime_ms", "batch").alias("overhead_ms"), F.regr_slope("runtime_ms", "batch").alias("ms_per_item"), F.count("*").alias("n_runs")
    )
