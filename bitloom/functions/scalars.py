"""Scalar expressions. Null in, null out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

def whole_div(c: Column, n) -> Column:
    """Whole-number quotient, exact for any BIGINT; cut towards zero."""
    return F.call_function("div", c, n if isinstance(n, Column) else F.lit(n))


def to_binary(c: Column) -> Column:
    """-1/+1 to 0/1."""
    return ((c + 1) / 2).cast("int")


def to_bipolar(c: Column) -> Column:
    """0/1 to -1/+1."""
    return (c * 2 - 1).cast("int")


def to_fixed(c: Column, scale: float) -> Column:
    """Value to whole steps of ``scale``."""
    return F.round(c.cast("double") / F.lit(scale)).cast("long")


def from_fixed(c: Column, scale: float) -> Column:
    return c.cast("double") * F.lit(scale)


def sign_bipolar(c: Column) -> Column:
    """+1 for zero and above, else -1."""
    return F.when(c >= 0, F.lit(1)).when(c < 0, F.lit(-1))


def right_shift(c: Column, n: int) -> Column:
    """Arithmetic shift: floors for negative values."""
    return F.shiftright(c, n)


def half_up(c: Column) -> Column:
    """0.5 -> 1, 1.5 -> 2, 2.45 -> 2 (values from 0 up)."""
    low = F.floor(c)
    return (low + (c - low >= 0.5).cast("int")).cast("long")


def half_even(c: Column) -> Column:
    """0.5 -> 0, 1.5 -> 2."""
    return F.rint(c).cast("long")


def clip(c: Column, low, high) -> Column:
    return F.when(c.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), c)))


def quantize_u32(c: Column) -> Column:
    """Clip to 0..2^32-1, then round half up."""
    return half_up(clip(c.cast("double"), 0.0, 4294967295.0))


def quantize_int8(c: Column) -> Column:
    return clip(F.floor(c.cast("double") * 127 + 0.5), -128, 127).cast("int")


def bits_needed(peak: Column) -> Column:
    """Smallest b with ``peak + 1 <= 2^b``, by comparing with powers: a floating-point log2 is inexact."""
    short = F.size(F.filter(F.sequence(F.lit(0), F.lit(63)), lambda b: F.pow(F.lit(2.0), b.cast("double")) < peak.cast("double") + 1))
    return F.when(peak.isNotNull(), short).cast("int")


def scale_255(c: Column) -> Column:
    return c.cast("double") / 255.0


def bit_array(c: Column, n: int) -> Column:
    """Most significant bit first."""
    steps = F.sequence(F.lit(n - 1), F.lit(0), F.lit(-1))
    return F.transform(steps, lambda i: F.call_function("shiftright", c.cast("long"), i).bitwiseAND(1).cast("int"))


def bit_string(c: Column, n: int) -> Column:
    """Most significant bit first, as text."""
    return F.lpad(F.bin(c.cast("long")), n, "0")


def sigmoid_positive(c: Column) -> Column:
    """``sigmoid(x) > 0.5``, which is ``x > 0``."""
    return (c > 0).cast("int")


def unsigned_width(peak: Column) -> Column:
    """Width of the unsigned type for values 0..peak, at least 1."""
    return F.greatest(bits_needed(peak), F.lit(1))


def signed_width(low: Column, high: Column) -> Column:
    """Smallest b with ``-2^(b-1) <= low`` and ``high <= 2^(b-1) - 1``."""
    reach = F.greatest(-low.cast("double"), high.cast("double") + 1)
    return (bits_needed(reach - 1) + 1).cast("int")


def clock_micros(ts: Column) -> Column:
    """Microseconds of a timestamp's wall clock since 1970, the same in every session time zone."""
    days = F.date_diff(ts.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    seconds = (days * 24 + F.hour(ts)) * 3600 + F.minute(ts) * 60
    return seconds * 1000000 + (F.extract(F.lit("SECOND"), ts) * 1000000).cast("long")
