"""Named operators: ``DataFrame -> DataFrame`` functions looked up at run time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Operator = Callable[..., DataFrame]
_OPERATORS: dict[str, Operator] = {}


def register_operator(name: str, fn: Operator | None = None):
    """Register a function, directly or as a decorator."""
    if fn is None:
        return lambda f: register_operator(name, f)
    _OPERATORS[name] = fn
    return fn


def get_operator(name: str) -> Operator:
    if name not in _OPERATORS:
        raise KeyError(f"no operator named {name}; known: {sorted(_OPERATORS)}")
    return _OPERATORS[name]


def operator_names() -> list[str]:
    return sorted(_OPERATORS)


def apply(df: DataFrame, name: str, *args, **options) -> DataFrame:
    return df.transform(get_operator(name), *args, **options)


def register_function(spark: SparkSession, name: str, fn) -> None:
    """Make a pandas or Arrow UDF callable from SQL; prefer expressions where they exist."""
    spark.udf.register(name, fn)


def register_builtin() -> None:
    from ..operators import elementwise, evaluation, integrity, inventory, matmul, parameters, spatial, telemetry, thresholds

    for module in (elementwise, thresholds, matmul, spatial, evaluation, integrity, telemetry, parameters, inventory):
        for key, value in vars(module).items():
            if callable(value) and not key.startswith("_") and getattr(value, "__module__", "") == module.__name__:
                _OPERATORS.setdefault(key, value)


register_builtin()
