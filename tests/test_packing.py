import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from bitloom.functions import packing as P
from bitloom.types import QuantType

FIXED = [
    ("BINARY", [1, 1, 1, 0], 4, False, "e"),
    ("BINARY", [1, 1, 1, 0], 8, False, "0e"),
    ("BINARY", [1, 1, 0, 1], 4, True, "b"),
    ("BINARY", [1, 1, 1, 0], 8, True, "07"),
    ("UINT2", [3, 3], 8, False, "0f"),
    ("UINT2", [1, 3], 8, False, "07"),
    ("UINT2", [3, 1], 8, False, "0d"),
]


@pytest.mark.parametrize("kind,values,width,reverse,expected", FIXED)
def test_fixed_values(spark, kind, values, width, reverse, expected):
    df = spark.createDataFrame([(values,)], "v array<bigint>")
    assert df.select(P.pack_hex(F.col("v"), QuantType.parse(kind), width, reverse_inner=reverse)).first()[0] == expected


def code(v, q):
    if q.name == "FLOAT32":
        return struct.unpack(">I", struct.pack(">f", v))[0]
    if q.name == "BIPOLAR":
        return (v + 1) // 2
    return (int(v / q.scale) if q.scale != 1 else v) & ((1 << q.bits) - 1)


@pytest.mark.parametrize("kind", ["BINARY", "BIPOLAR", "TERNARY", "INT2", "INT7", "INT8", "INT22", "INT32", "INT64", "UINT7", "UINT8", "UINT15", "FIXED<9,6>", "FLOAT32"])
@pytest.mark.parametrize("reverse_inner,reverse_endian", [(False, False), (True, True)])
def test_round_trip(spark, kind, reverse_inner, reverse_endian):
    q, rng, n = QuantType.parse(kind), np.random.default_rng(3), 65
    if kind == "FLOAT32":
        special = [0.0, -0.0, 1e-40, 3e38, float("inf"), -1.5]
        data = [[float(np.float32(v)) for v in special + list(rng.uniform(-9, 9, n - 6))] for _ in range(4)]
    elif kind == "BIPOLAR":
        data = [[int(v) for v in rng.choice([-1, 1], n)] for _ in range(4)]
    elif kind.startswith("FIXED"):
        data = [[float(v) * q.scale for v in rng.integers(-256, 256, n)] for _ in range(4)]
    else:
        data = [[int(v) for v in rng.integers(int(q.min), int(q.max), n, endpoint=True)] for _ in range(4)]
    width = (n * q.bits + 7) // 8 * 8 + 8
    kind_sql = "double" if kind == "FLOAT32" or kind.startswith("FIXED") else "bigint"
    df = spark.createDataFrame([(i, v) for i, v in enumerate(data)], f"i int, v array<{kind_sql}>")
    text = P.pack_hex(F.col("v"), q, width, reverse_inner, reverse_endian)
    for r in df.withColumn("h", text).withColumn("u", P.unpack_hex(F.col("h"), q, n, reverse_inner, reverse_endian)).collect():
        whole = 0
        for v in reversed(data[r.i]) if reverse_inner else data[r.i]:
            whole = (whole << q.bits) | code(v, q)
        expected = format(whole, f"0{width // 4}x")
        if reverse_endian:
            expected = bytes.fromhex(expected)[::-1].hex()
        assert r.h == expected
        assert list(r.u) == data[r.i]


def test_errors(spark):
    df = spark.createDataFrame([([1, 2, 3],)], "v array<bigint>")
    for kind, width in (("UINT2", 4), ("BINARY", 8)):
        with pytest.raises(Exception, match="bits to pack|value outside"):
            df.select(P.pack_hex(F.col("v"), QuantType.parse(kind), width)).collect()
    assert df.select(P.pack_bytes(F.col("v"), QuantType.parse("UINT2"), n=3)).first()[0] == bytes([0x1B])


def test_type_ranges():
    assert QuantType.parse("INT4").min == -8 and QuantType.parse("UINT9").max == 511
    assert QuantType.parse("FIXED<9,6>").scale == 0.125
    with pytest.raises(ValueError):
        QuantType.parse("INT65")
