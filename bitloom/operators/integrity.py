"""Frame checksums and frame marks on ordered words ``(stream_id, seq, word)``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import whole_div

SLICE = 23
MODULUS = 1 << 24


def _unsigned_shift(c: Column, n: int) -> Column:
    return F.shiftrightunsigned(c, n) if n else c


def subwords(word: Column, k: int, bits: int) -> list[Column]:
    """The ``k`` subwords of a word of ``bits`` bits, lowest first."""
    if bits % k or bits > 64:
        raise ValueError("word width must divide by k and fit 64 bits")
    w = bits // k
    mask = F.lit((1 << w) - 1).cast("long") if w < 64 else None
    parts = [_unsigned_shift(word.cast("long"), j * w) for j in range(k)]
    return [p.bitwiseAND(mask) if mask is not None else p for p in parts]


def xor_fold(v: Column, bits: int) -> Column:
    """XOR of the 23-bit slices of an unsigned value."""
    mask = F.lit((1 << SLICE) - 1).cast("long")
    slices = [_unsigned_shift(v, s).bitwiseAND(mask) for s in range(0, bits, SLICE)]
    return reduce(lambda a, b: a.bitwiseXOR(b), slices)


def word_term(word: Column, at: Column, k: int, bits: int) -> Column:
    """Weighted contribution of the word at position ``at`` of its frame; weights run 1, 2, 3."""
    terms = [((F.pmod(at * k + j, F.lit(3)) + 1) * xor_fold(v, bits // k)) for j, v in enumerate(subwords(word, k, bits))]
    return reduce(lambda a, b: a + b, terms)


def frame_terms(words: DataFrame, n_words: int, k: int = 1, bits: int = 64) -> DataFrame:
    frame = whole_div(F.col("seq"), n_words)
    at = F.pmod(F.col("seq"), F.lit(n_words))
    return words.withColumn("frame", frame).withColumn("term", F.pmod(word_term(F.col("word"), at, k, bits), F.lit(MODULUS)))


def frame_checksum(words: DataFrame, n_words: int, k: int = 1, bits: int = 64) -> DataFrame:
    """One checksum per complete frame: frame number mod 256 above 24 bits of sum.

    A plain sum, so words are summed where they lie and one row per frame part is shuffled.
    """
    sums = frame_terms(words, n_words, k, bits).groupBy("stream_id", "frame").agg(F.sum("term").alias("s"), F.count("*").alias("n"))
    value = F.pmod("frame", F.lit(256)) * MODULUS + F.pmod("s", F.lit(MODULUS))
    return sums.where(F.col("n") == n_words).select("stream_id", "frame", value.cast("long").alias("checksum"))


def checksum_tap(words: DataFrame, n_words: int, k: int = 1, bits: int = 64, drain: bool = False) -> tuple[DataFrame | None, DataFrame]:
    """The forwarded words (none when draining) and the checksums."""
    return (None if drain else words), frame_checksum(words, n_words, k, bits)


def mark_frames(words: DataFrame, n: int, default: int = 1, direction: str = "out") -> DataFrame:
    """Flag the last word of each n; ``n = 0`` takes the default. Direction ``in`` strips the flag."""
    if direction == "in":
        return words.drop("last")
    if direction != "out":
        raise ValueError(direction)
    size = n or default
    return words.withColumn("last", F.pmod(F.col("seq") + 1, F.lit(size)) == 0)


def frame_metrics(n_words: int, k: int = 1, bits: int = 64) -> list[Column]:
    """Metrics of the words that pass a step, for ``DataFrame.observe``: their number, and the sum of their checksum terms.

    The same for a batch (``Observation``) and for a stream (``StepWatch``); two steps that pass the same words report the same.
    """
    at = F.pmod(F.col("seq"), F.lit(n_words))
    term = F.pmod(word_term(F.col("word"), at, k, bits), F.lit(MODULUS))
    return [F.count(F.lit(1)).alias("n_words"), F.coalesce(F.sum(term), F.lit(0)).cast("long").alias("terms")]


def frame_differences(before: DataFrame, after: DataFrame, n_words: int, k: int = 1, bits: int = 64) -> DataFrame:
    """Frames of two steps compared by checksum, per stream: ``(stream_id, n_frames, n_different)``; a frame that only one step has is different."""
    first, second = (frame_checksum(w, n_words, k, bits) for w in (before, after))
    both = first.join(second.withColumnRenamed("checksum", "again"), ["stream_id", "frame"], "full_outer")
    differs = F.count_if(~F.col("checksum").eqNullSafe(F.col("again")))
    return both.groupBy("stream_id").agg(F.count("*").alias("n_frames"), differs.alias("n_different"))
