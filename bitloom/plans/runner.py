"""Ordered steps with saved intermediates, resume and timings."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .registry import get_operator

Step = str | Callable[[DataFrame], DataFrame]


class StepFailed(RuntimeError):
    """A step failed; ``timings`` holds what ran before it."""

    def __init__(self, step: str, timings: list[tuple[str, float, str]]) -> None:
        super().__init__(f"step {step} failed")
        self.step, self.timings = step, timings


def _name(step: Step) -> str:
    return step if isinstance(step, str) else step.__name__


def run_steps(
    df: DataFrame | None, steps: Sequence[Step], folder: str, start: str | None = None, stop: str | None = None, spark=None, hooks: dict[str, Callable[[DataFrame], None]] | None = None
) -> tuple[DataFrame, list[tuple[str, float, str]]]:
    """Run steps by name or function, each saved as Parquet below ``folder``.

    ``start`` resumes from the table saved before that step; ``stop`` ends after a step. A hook
    sees the saved result of its step. Returns the last table and ``(step, seconds, status)``.
    """
    names = [_name(s) for s in steps]
    first = names.index(start) if start else 0
    last = names.index(stop) if stop else len(names) - 1
    spark = spark or df.sparkSession
    if first > 0:
        df = spark.read.parquet(f"{folder}/{first - 1:03d}_{names[first - 1]}")
    timings: list[tuple[str, float, str]] = []
    for i in range(first, last + 1):
        path, begun = f"{folder}/{i:03d}_{names[i]}", time.time()
        try:
            fn = get_operator(steps[i]) if isinstance(steps[i], str) else steps[i]
            fn(df).write.mode("overwrite").parquet(path)
            df = spark.read.parquet(path)
            if hooks and names[i] in hooks:
                hooks[names[i]](df)
        except Exception as error:
            timings.append((names[i], time.time() - begun, "FAIL"))
            raise StepFailed(names[i], timings) from error
        timings.append((names[i], time.time() - begun, "SUCCESS"))
    return df, timings


def step_times(spark, timings: Sequence[tuple[str, float, str]]) -> DataFrame:
    """Timings as a table."""
    return spark.createDataFrame([(i, *t) for i, t in enumerate(timings)], "pos INT, step STRING, seconds DOUBLE, status STRING")


def watch(df: DataFrame, name: str, **metrics) -> DataFrame:
    """Plain metrics of a step, gathered while it runs."""
    exprs = [F.expr(e).alias(k) for k, e in metrics.items()] or [F.count(F.lit(1)).alias("n_rows")]
    return df.observe(name, *exprs)
