"""Jobs on parameter tables of many models at once, keyed by ``model_id, layer_id``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..sizing import param_join
from .elementwise import smallest_type_name

LAYER = ("model_id", "layer_id")

# Constants of the SELU activation.
SELU_ALPHA = 1.6732632423543772
SELU_LAMBDA = 1.0507009873554805


def derive_thresholds(spec: DataFrame, channels: int | None = None) -> DataFrame:
    """Threshold steps of quantized activations.

    ``spec(model_id, layer_id, kind, bits, narrow, channel, scale)`` with kind ``relu identity selu
    bipolar``. One scale per channel; with ``channels`` a single row is repeated for all channels.
    """
    s, b = F.abs("scale"), F.col("bits").cast("int")
    full = F.call_function("shiftleft", F.lit(1), b) - 1
    signed = F.when(F.col("narrow"), full - 1).otherwise(full)
    # a signed 1-bit activation has the single threshold 0, as bipolar has
    one_bit = (F.col("kind") == "bipolar") | ((F.col("kind") == "identity") & (b == 1))
    n = F.when(one_bit, F.lit(1)).when(F.col("kind") == "identity", signed).otherwise(full)
    rows = spec.where(n > 0).withColumn("_n", n).withColumn("step", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    t = F.col("step").cast("double")
    relu = s / 2 + s * t
    half = F.floor(F.col("_n") / 2).cast("double")
    first = -s / 2 - s * (half - 1)
    first = F.when(F.col("narrow"), first).otherwise(first - s)
    u = F.lit(-1.0) + s / 2 + s * t
    selu = F.when(u <= 0, F.ln(F.when(u <= 0, u / (SELU_ALPHA * SELU_LAMBDA) + 1))).otherwise(u / SELU_LAMBDA)
    value = (
        F.when(one_bit, F.lit(0.0))
        .when(F.col("kind") == "relu", relu)
        .when(F.col("kind") == "selu", selu)
        .when(F.col("kind") == "identity", first + s * t)
    )
    out = rows.select(*LAYER, "channel", "step", value.alias("t"))
    return tile_channels(out.drop("channel"), channels) if channels else out


def act_bias(kind: Column, bits: Column, narrow: Column) -> Column:
    """Bias added to the step count: 0 for unsigned, -0.5 for one bit, else the lowest code."""
    low = F.pow(F.lit(2.0), (bits - 1).cast("double"))
    signed = F.when(bits == 1, F.lit(-0.5)).when(narrow, -(low - 1)).otherwise(-low)
    return F.when(kind.isin("relu", "selu"), F.lit(0.0)).when(kind == "bipolar", F.lit(-0.5)).otherwise(signed)


def act_bias_scale(spec: DataFrame) -> DataFrame:
    """Output scale and fused bias; bias is added before the scale, so ``out_bias = bias * scale``."""
    bias = act_bias(F.col("kind"), F.col("bits"), F.col("narrow"))
    scale = F.when(F.col("kind") == "bipolar", F.abs("scale") * 2).otherwise(F.abs("scale"))
    return spec.select(*LAYER, "channel", bias.alias("bias"), scale.alias("out_scale"), (bias * scale).alias("out_bias"))


def validate_quant_spec(spec: DataFrame) -> DataFrame:
    """Unsupported specs with the reason."""
    unsigned = F.col("kind").isin("relu", "selu")
    reason = (
        F.when(F.col("zero_point") != 0, "zero point is not 0")
        .when(unsigned & F.col("signed"), "signed output on an unsigned activation")
        .when(unsigned & F.col("narrow"), "narrow range on an unsigned activation")
        .when((F.col("kind") == "identity") & ~F.col("signed"), "unsigned identity")
        .when((F.col("kind") == "bipolar") & (F.col("scale") != 1), "bipolar needs scale 1")
    )
    return spec.withColumn("reason", reason).where(F.col("reason").isNotNull())


def convertible(spec: DataFrame, max_bits: int = 8) -> DataFrame:
    """Activations narrow enough to become thresholds; wider ones stay as they are."""
    return spec.where(F.col("bits") <= max_bits)


def fold_weights(weights: DataFrame, scales: DataFrame) -> DataFrame:
    """``w_int = round_half_even(q / scale)``; the scale moves behind the next operator."""
    joined = param_join(weights, scales.select(*LAYER, "out_idx", "scale"), [*LAYER, "out_idx"], spread=["in_idx"])
    return joined.withColumn("w_int", S.half_even(F.col("q") / F.col("scale")))


def absorb_add(thresholds: DataFrame, adds: DataFrame) -> DataFrame:
    """``T' = T - a``; ``adds(model_id, layer_id, channel, val)``, missing channels unchanged."""
    a = adds.select(*LAYER, "channel", F.col("val").alias("_a"))
    out = param_join(thresholds, a, [*LAYER, "channel"], "left", spread=["step"])
    return out.withColumn("t", F.col("t") - F.coalesce("_a", F.lit(0.0))).drop("_a").select(*thresholds.columns)


def absorb_mul(thresholds: DataFrame, muls: DataFrame) -> DataFrame:
    """``T' = T / m`` for layers whose multipliers are all positive; other layers stay as they are."""
    usable = muls.groupBy(*LAYER).agg(F.min("val").alias("_low")).where("_low > 0").select(*LAYER)
    m = param_join(muls, usable, LAYER, spread=["channel"]).select(*LAYER, "channel", F.col("val").alias("_m"))
    out = param_join(thresholds, m, [*LAYER, "channel"], "left", spread=["step"])
    return out.withColumn("t", F.when(F.col("_m").isNotNull(), F.col("t") / F.col("_m")).otherwise(F.col("t"))).select(*thresholds.columns)


def split_sign(muls: DataFrame) -> DataFrame:
    """A multiplier as sign (-1, 0, +1) and magnitude."""
    return muls.withColumn("sign", F.signum("val").cast("int")).withColumn("magnitude", F.abs("val"))


def absorb_sign(weights: DataFrame, signs: DataFrame) -> DataFrame:
    """``w' = w * s[out_idx]`` for multipliers of -1 and +1."""
    s = signs.select(*LAYER, F.col("channel").alias("out_idx"), F.col("sign").alias("_s"))
    out = param_join(weights, s, [*LAYER, "out_idx"], "left", spread=["in_idx"])
    return out.withColumn("w", F.col("w") * F.coalesce("_s", F.lit(1))).select(*weights.columns)


def collapse_affine(chain: DataFrame) -> DataFrame:
    """Consecutive adds and muls to one ``x * mul + add`` per channel.

    ``chain(model_id, layer_id, channel, pos, op, val)``; a group is one channel's chain.
    """
    ops = F.array_sort(F.collect_list(F.struct("pos", "op", F.col("val").cast("double").alias("val"))))
    start = F.struct(F.lit(1.0).alias("m"), F.lit(0.0).alias("a"))
    step = lambda acc, o: F.when(o["op"] == "add", F.struct(acc["m"].alias("m"), (acc["a"] + o["val"]).alias("a"))).otherwise(
        F.struct((acc["m"] * o["val"]).alias("m"), (acc["a"] * o["val"]).alias("a"))
    )
    folded = chain.groupBy(*LAYER, "channel").agg(F.aggregate(ops, start, step).alias("f"))
    return folded.select(*LAYER, "channel", F.col("f.m").alias("mul"), F.col("f.a").alias("add"))


def push_affine_past_matmul(affine: DataFrame, weights: DataFrame) -> DataFrame:
    """Scalar ``x*m + a`` before a product becomes ``y*m + a*colsum(W)`` after it, per output."""
    sums = weights.groupBy(*LAYER, "out_idx").agg(F.sum("w").alias("colsum"))
    joined = param_join(sums, affine.select(*LAYER, "mul", "add"), LAYER, spread=["out_idx"])
    return joined.select(*LAYER, "out_idx", "mul", (F.col("add") * F.col("colsum")).alias("add"))


def round_thresholds(thresholds: DataFrame, types: DataFrame) -> DataFrame:
    """For integer inputs: ceil, no negatives for unsigned, clip to ``[min-1, max+1]``.

    ``types(model_id, layer_id, type_min, type_max)``.
    """
    joined = param_join(thresholds, types.select(*LAYER, "type_min", "type_max"), LAYER, spread=["channel", "step"])
    up = F.ceil("t").cast("long")
    up = F.when(F.col("type_min") >= 0, F.greatest(up, F.lit(0))).otherwise(up)
    return joined.withColumn("t", F.greatest(F.col("type_min") - 1, F.least(F.col("type_max") + 1, up))).select(*thresholds.columns)


def absorb_out_bias(layers: DataFrame, adds: DataFrame) -> DataFrame:
    """Fold a scalar add after thresholds into the output bias and derive the output type.

    ``layers(model_id, layer_id, steps, out_scale, out_bias)``.
    """
    joined = layers.join(adds.select(*LAYER, F.col("val").alias("_a")), list(LAYER), "left")
    bias = F.col("out_bias") + F.coalesce("_a", F.lit(0.0))
    low, high = bias, bias + F.col("steps") * F.col("out_scale")
    whole = (low == F.floor(low)) & (high == F.floor(high))
    kind = F.when((low == -1) & (high == 1) & (F.col("steps") == 1), F.lit("BIPOLAR")).when(whole, smallest_type_name(low, high)).otherwise(F.lit("FLOAT32"))
    return joined.withColumn("out_type", kind).withColumn("out_bias", bias).drop("_a")


def validate_thresholds(thresholds: DataFrame, steps: DataFrame, integral: bool = True) -> DataFrame:
    """Channels with descending steps, a wrong step count, or values the input type cannot meet.

    ``steps(model_id, layer_id, steps, unsigned)``.
    """
    order = Window.partitionBy(*LAYER, "channel").orderBy("step")
    checked = thresholds.withColumn("_drop", F.col("t") < F.lag("t").over(order)).groupBy(*LAYER, "channel").agg(
        F.count_if("_drop").alias("n_descending"),
        F.count("*").alias("n_steps"),
        F.count_if(F.col("t") < 0).alias("n_negative"),
        F.count_if(F.col("t") != F.floor("t")).alias("n_fractional"),
    )
    joined = param_join(checked, steps.select(*LAYER, "steps", "unsigned"), LAYER, spread=["channel"])
    bad = (F.col("n_descending") > 0) | (F.col("n_steps") != F.col("steps")) | (F.col("unsigned") & (F.col("n_negative") > 0))
    return joined.where(bad | (F.col("n_fractional") > 0) if integral else bad)


def tile_channels(thresholds: DataFrame, channels: int) -> DataFrame:
    """Repeat a single row of thresholds for every channel."""
    return thresholds.withColumn("channel", F.explode(F.sequence(F.lit(0), F.lit(channels - 1))))


def accumulator_width(low: Column, high: Column) -> Column:
    return F.when(low >= 0, S.unsigned_width(high)).otherwise(S.signed_width(low, high))


def min_accumulator(
    weights: DataFrame, types: DataFrame, thresholds: DataFrame | None = None, columns: Sequence[str] = ("out_idx",)
) -> DataFrame:
    """Range and width of each layer's accumulator.

    ``types(model_id, layer_id, x_min, x_max, w_min, w_max, runtime, last)``. ``runtime`` layers use
    the worst case of the weight type; the last layer's width is rounded up to 8 bits. Thresholds
    are clipped to the range of the sums, so they can touch but not widen it.
    For depthwise layers pass the channel as ``columns``.
    """
    keyed = param_join(weights, types, LAYER, spread=["in_idx"] if "in_idx" in weights.columns else list(columns))
    w, lo, hi = F.col("w").cast("long"), F.col("x_min"), F.col("x_max")

    def extreme(value: Column, low: bool) -> Column:
        pick = F.least if low else F.greatest
        return F.sum(pick(value * lo, value * hi))

    per_out = keyed.groupBy(*LAYER, *columns).agg(
        extreme(w, True).alias("c_min"),
        extreme(w, False).alias("c_max"),
        F.least(extreme(F.col("w_min"), True), extreme(F.col("w_max"), True)).alias("r_min"),
        F.greatest(extreme(F.col("w_min"), False), extreme(F.col("w_max"), False)).alias("r_max"),
    )
    sums = per_out.groupBy(*LAYER).agg(F.min("c_min").alias("c_min"), F.max("c_max").alias("c_max"), F.min("r_min").alias("r_min"), F.max("r_max").alias("r_max"))
    flags = sums.join(types.select(*LAYER, "runtime", "last"), list(LAYER))
    out = flags.withColumn("acc_min", F.when(F.col("runtime"), F.col("r_min")).otherwise(F.col("c_min"))).withColumn(
        "acc_max", F.when(F.col("runtime"), F.col("r_max")).otherwise(F.col("c_max"))
    )
    out = out.withColumn("thresholds_clipped", F.lit(False))
    if thresholds is not None:
        t = thresholds.groupBy(*LAYER).agg(F.min("t").alias("t_min"), F.max("t").alias("t_max"))
        out = out.join(t, list(LAYER), "left").withColumn(
            "thresholds_clipped", F.coalesce((F.col("t_max") > F.col("acc_max")) | (F.col("t_min") < F.col("acc_min")), F.lit(False))
        )
    width = accumulator_width(F.col("acc_min"), F.col("acc_max"))
    width = F.when(F.col("last"), (F.ceil(width / 8) * 8).cast("int")).otherwise(width)
    return out.select(*LAYER, "acc_min", "acc_max", width.alias("width"), (F.col("acc_min") < 0).alias("signed"), "thresholds_clipped")


def clip_thresholds(thresholds: DataFrame, ranges: DataFrame) -> DataFrame:
    """Clip thresholds to the accumulator range of their layer."""
    joined = param_join(thresholds, ranges.select(*LAYER, "acc_min", "acc_max"), LAYER, spread=["channel", "step"])
    return joined.withColumn("t", F.greatest("acc_min", F.least("acc_max", "t"))).select(*thresholds.columns)


def sign_rule(low: Column, high: Column) -> Column:
    """Type for a range by its dominating side."""
    below = F.when(F.abs(low) > high, low).otherwise(-high - 1)
    return F.when(low < 0, smallest_type_name(below, below)).otherwise(smallest_type_name(high, high))


def min_weight_width(weights: DataFrame) -> DataFrame:
    """Narrowest weight type per layer."""
    ranges = weights.groupBy(*LAYER).agg(F.min("w").cast("long").alias("w_min"), F.max("w").cast("long").alias("w_max"))
    return ranges.withColumn("w_type", sign_rule(F.col("w_min"), F.col("w_max")))


def min_threshold_type(thresholds: DataFrame, types: DataFrame) -> DataFrame:
    """Narrowest type holding all thresholds and the input type's own range, with a fit check."""
    ranges = thresholds.groupBy(*LAYER).agg(
        F.min("t").alias("t_min"), F.max("t").alias("t_max"), F.bool_and(F.col("t") == F.floor("t")).alias("integral")
    )
    joined = ranges.join(types.select(*LAYER, "type_min", "type_max"), list(LAYER))
    low, high = F.least("t_min", "type_min"), F.greatest("t_max", "type_max")
    return joined.select(*LAYER, low.cast("long").alias("lo"), high.cast("long").alias("hi"), sign_rule(low, high).alias("t_type"), "integral")
