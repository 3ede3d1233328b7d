"""Fixed-width bit packing of arrays, as JVM-side expressions.

Element 0 takes the most significant place. Values are masked to their width first, so negative
values appear in two's complement. Text is built byte by byte; no number wider than one element
is ever formed, so the packed width has no limit.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..types import QuantType


def _float_bits(x: Column) -> Column:
    """IEEE-754 single precision bits of a float as a BIGINT."""
    d = x.cast("double")
    a = F.abs(d)
    guess = F.floor(F.log2(F.when(a > 0, a).otherwise(F.lit(1.0)))).cast("int")
    m0 = a / F.pow(F.lit(2.0), guess.cast("double"))
    exp = F.when(m0 >= 2, guess + 1).when(m0 < 1, guess - 1).otherwise(guess)
    normal = F.greatest(exp, F.lit(-126))
    mant = a * F.pow(F.lit(2.0), (23 - normal).cast("double"))
    body = F.when(
        exp >= -126, (normal + 127).cast("long") * 8388608 + (mant.cast("long") - 8388608)
    ).otherwise(mant.cast("long"))
    body = (
        F.when(F.isnan(d), F.lit(0x7FC00000).cast("long"))
        .when(a == float("inf"), F.lit(0x7F800000).cast("long"))
        .when(a == 0, F.lit(0).cast("long"))
        .otherwise(body)
    )
    sign = F.when((d < 0) | (d.cast("string") == "-0.0"), F.lit(2147483648).cast("long")).otherwise(F.lit(0).cast("long"))
    return body + sign


def _float_value(bits: Column) -> Column:
    sign = F.when(bits >= 2147483648, F.lit(-1.0)).otherwise(F.lit(1.0))
    exp = F.shiftright(bits, 23).bitwiseAND(255)
    mant = bits.bitwiseAND(8388607)
    normal = (mant + 8388608).cast("double") * F.pow(F.lit(2.0), (exp - 150).cast("double"))
    small = mant.cast("double") * F.pow(F.lit(2.0), F.lit(-149.0))
    special = F.when(mant == 0, F.lit(float("inf"))).otherwise(F.lit(float("nan")))
    return (sign * F.when(exp == 255, special).when(exp == 0, small).otherwise(normal)).cast("float")


def _code(v: Column, q: QuantType) -> Column:
    """An element as a non-negative BIGINT of ``q.bits`` bits (64-bit types keep their sign)."""
    if q.name == "FLOAT32":
        return _float_bits(v)
    if q.name == "BIPOLAR":
        return ((v + 1) / 2).cast("long")
    if q.name.startswith("FIXED"):
        v = F.round(v.cast("double") / F.lit(q.scale))
    v = v.cast("long")
    return v if q.bits == 64 else v.bitwiseAND(F.lit((1 << q.bits) - 1).cast("long"))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluate a value once per row and use it inside lambdas."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _nibbles_up(bits: Column) -> Column:
    """Bit text whose length divides by 8 to hex text."""
    return _once(bits, _octets_to_hex)


def _octets_to_hex(bits: Column) -> Column:
    starts = F.sequence(F.lit(0), (F.length(bits) / 8).cast("int") - 1)
    chunk = F.transform(starts, lambda i: F.lpad(F.conv(F.substring(bits, i * 8 + 1, F.lit(8)), 2, 16), 2, "0"))
    return F.when(F.length(bits) == 0, F.lit("")).otherwise(F.array_join(chunk, ""))


def pack_hex(
    vec: Column, q: QuantType, nbits: int, reverse_inner: bool = False, reverse_endian: bool = False, check: bool = True
) -> Column:
    """Pack an array into ``nbits`` bits as lower-case hex digits without a prefix.

    ``nbits`` must divide by 4; with ``reverse_endian`` by 8. Too many elements, or a value outside
    the type, fail the query.
    """
    if nbits < 4 or nbits % 4:
        raise ValueError("packed width must be a multiple of 4")
    digits = nbits // 4
    source = F.reverse(vec) if reverse_inner else vec
    if q.bits % 4 == 0:
        parts = F.transform(source, lambda v: F.lpad(F.hex(_code(v, q)), q.bits // 4, "0"))
        text = F.lpad(F.array_join(parts, ""), digits, "0")
    else:
        parts = F.transform(source, lambda v: F.lpad(F.bin(_code(v, q)), q.bits, "0"))
        whole = F.lpad(F.array_join(parts, ""), (nbits + 7) // 8 * 8, "0")
        text = F.substring(_nibbles_up(whole), ((nbits + 7) // 8 * 8 - nbits) // 4 + 1, digits)
    text = F.lower(text)
    if reverse_endian:
        if nbits % 8:
            raise ValueError("byte order needs whole bytes")
        text = F.array_join(F.reverse(hex_to_bytes(text)), "")
    guard = F.when(F.size(vec) * q.bits > nbits, F.raise_error(F.lit(f"more than {nbits} bits to pack")))
    if check:
        bad = F.exists(vec, lambda v: ~F.coalesce(q.allowed(v), F.lit(False)))
        guard = guard.when(bad, F.raise_error(F.lit(f"value outside {q.name}")))
    return guard.otherwise(text)


def pack_bytes(vec: Column, q: QuantType, nbits: int | None = None, n: int | None = None, **options) -> Column:
    """Pack into a ``BINARY`` value; the width defaults to ``n`` elements rounded up to bytes."""
    if nbits is None:
        if n is None:
            raise ValueError("give nbits or n")
        nbits = n * q.bits
    return F.unhex(pack_hex(vec, q, (nbits + 7) // 8 * 8, **options))


def hex_to_bytes(text: Column) -> Column:
    """Hex digits to an array of two-digit texts, first byte first."""
    return F.filter(F.split(F.regexp_replace(text, "(..)", "$1,"), ","), lambda s: s != "")


def hex_to_byte_values(text: Column) -> Column:
    """``0x`` text to an array of 0..255."""
    clean = F.lower(F.regexp_replace(text, "^0[xX]", ""))
    even = F.when(F.length(clean) % 2 == 1, F.concat(F.lit("0"), clean)).otherwise(clean)
    return F.transform(hex_to_bytes(even), lambda b: F.conv(b, 16, 10).cast("int"))


def byte_values_to_hex(values: Column) -> Column:
    """An array of 0..255 to ``0x`` text."""
    return F.concat(F.lit("0x"), F.lower(F.array_join(F.transform(values, lambda v: F.lpad(F.hex(v), 2, "0")), "")))


def _element(bits: Column, q: QuantType) -> Column:
    """One element's bit text to its value."""
    u = F.conv(bits, 2, 10)
    if q.bits == 64:
        return u.cast("decimal(20,0)") if not q.signed else F.conv(bits, 2, -10).cast("long")
    u = u.cast("long")
    if q.name == "BIPOLAR":
        return u * 2 - 1
    if q.name == "FLOAT32":
        return _float_value(u)
    if not q.signed:
        return u
    half = F.lit(1 << (q.bits - 1)).cast("long")
    value = u.bitwiseAND(F.lit((1 << (q.bits - 1)) - 1).cast("long")) - u.bitwiseAND(half)
    return value * F.lit(q.scale) if q.name.startswith("FIXED") else value


def unpack_hex(text: Column, q: QuantType, n: int, reverse_inner: bool = False, reverse_endian: bool = False) -> Column:
    """Inverse of ``pack_hex``; ``n`` elements are read from the low end, padding is dropped."""
    clean = F.regexp_replace(text, "^0[xX]", "")
    if reverse_endian:
        clean = F.array_join(F.reverse(hex_to_bytes(clean)), "")
    even = F.when(F.length(clean) % 2 == 1, F.concat(F.lit("0"), clean)).otherwise(clean)
    octets = F.transform(hex_to_bytes(even), lambda b: F.lpad(F.conv(b, 16, 2), 8, "0"))
    width = n * q.bits

    def cut(bits: Column) -> Column:
        return F.when(F.length(bits) >= width, F.right(bits, F.lit(width))).otherwise(F.lpad(bits, width, "0"))

    def elements(body: Column) -> Column:
        at = F.sequence(F.lit(0), F.lit(n - 1))
        return F.transform(at, lambda i: _once(F.substring(body, i * q.bits + 1, F.lit(q.bits)), lambda b: _element(b, q)))

    out = _once(_once(F.array_join(octets, ""), cut), elements)
    return F.reverse(out) if reverse_inner else out


def unpack_bytes(data: Column, q: QuantType, n: int, **options) -> Column:
    return unpack_hex(F.hex(data), q, n, **options)


def lanes(vec: Column, width: int) -> Column:
    """0/1 elements to BIGINT words of up to 63 bits, element 0 lowest."""
    words = F.sequence(F.lit(0), F.lit((width + 62) // 63 - 1))
    return F.transform(
        words,
        lambda w: F.aggregate(
            F.transform(F.slice(vec, w * 63 + 1, 63), lambda v, i: F.call_function("shiftleft", v.cast("long"), i)),
            F.lit(0).cast("long"),
            lambda acc, v: acc.bitwiseOR(v),
        ),
    )
