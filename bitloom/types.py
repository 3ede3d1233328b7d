"""Logical number types carried by plain Spark columns."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class QuantType:
    """A logical type: ``BINARY BIPOLAR TERNARY INTn UINTn FIXED<n,i> FLOAT32``."""

    name: str
    bits: int
    signed: bool
    min: float
    max: float
    scale: float = 1.0

    @staticmethod
    def parse(name: str) -> "QuantType":
        fixed_names = {
            "BINARY": QuantType("BINARY", 1, False, 0, 1),
            "BIPOLAR": QuantType("BIPOLAR", 1, True, -1, 1),
            "TERNARY": QuantType("TERNARY", 2, True, -1, 1),
            "FLOAT32": QuantType("FLOAT32", 32, True, float("-inf"), float("inf")),
        }
        if name in fixed_names:
            return fixed_names[name]
        if m := re.fullmatch(r"(U?)INT(\d+)", name):
            n = int(m.group(2))
            if not 1 <= n <= 64:
                raise ValueError(f"width out of range: {name}")
            if m.group(1):
                return QuantType(name, n, False, 0, 2**n - 1)
            return QuantType(name, n, True, -(2 ** (n - 1)), 2 ** (n - 1) - 1)
        if m := re.fullmatch(r"FIXED<(\d+),(\d+)>", name):
            n, whole = int(m.group(1)), int(m.group(2))
            s = 2.0 ** (whole - n)
            return QuantType(name, n, True, -(2 ** (n - 1)) * s, (2 ** (n - 1) - 1) * s, s)
        raise ValueError(f"unknown type {name}")

    @property
    def is_integer(self) -> bool:
        return self.name != "FLOAT32" and not self.name.startswith("FIXED")

    def allowed(self, c: Column) -> Column:
        """True where a value belongs to the type; null stays null."""
        if self.name == "FLOAT32":
            return F.when(c.isNotNull(), F.lit(True))
        if self.name == "BIPOLAR":
            return c.isin(-1, 1)
        if self.name.startswith("FIXED"):
            steps = c.cast("double") / F.lit(self.scale)
            return c.between(self.min, self.max) & (steps == F.floor(steps))
        whole = c == F.floor(c)
        if self.name == "UINT64":
            return (c >= 0) & whole
        if self.name == "INT64":
            return whole
        return c.between(int(self.min), int(self.max)) & whole

    def storage(self) -> T.DataType:
        """The narrowest Spark type that holds the values."""
        if self.name == "FLOAT32":
            return T.FloatType()
        if self.name.startswith("FIXED"):
            return T.DoubleType()
        for limit, kind in ((7, T.ByteType()), (15, T.ShortType()), (31, T.IntegerType()), (63, T.LongType())):
            if self.bits - (1 if self.signed else 0) <= limit:
                return kind
        return T.DecimalType(20, 0)

    def metadata(self) -> dict:
        return {"quant_type": self.name, "bits": self.bits, "signed": self.signed, "scale": self.scale}


def annotate(c: Column, alias: str, qtype: QuantType) -> Column:
    """Name a column and keep its logical type in the column metadata."""
    return c.alias(alias, metadata=qtype.metadata())


def type_of(schema: T.StructType, col: str) -> QuantType | None:
    name = schema[col].metadata.get("quant_type")
    return QuantType.parse(name) if name else None
