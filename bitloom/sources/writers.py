"""Writers of reports, packed rows and activations."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pa_fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import whole_div


def write_report(metrics: DataFrame, path: str) -> None:
    """``(model_id, layer_id, metric, value)`` with model totals, as JSON lines."""
    from ..operators.inventory import layers_and_totals

    layers_and_totals(metrics).write.mode("errorifexists").option("ignoreNullFields", "false").json(path)


def hex_line(vec: Column) -> Column:
    """Bytes of a row as upper-case hex, last element first."""
    return F.array_join(F.transform(F.reverse(vec), lambda v: F.lpad(F.hex(v.cast("long").bitwiseAND(255)), 2, "0")), "")


def label_line(label: Column, width: int) -> Column:
    """A label padded with ``ff`` to the length of a row of ``width`` bytes."""
    return F.concat(F.lit("ff" * (width - 1)), F.lpad(F.hex(label), 2, "0"))


def hex_lines(df: DataFrame, width: int, item: str = "row_id", vec: str = "vec", label: str = "label") -> DataFrame:
    """``(item, line_no, line)``: rows of ``width`` bytes, then one label line per item."""
    rows = F.transform(F.sequence(F.lit(0), (F.size(vec) / width).cast("int") - 1), lambda i: hex_line(F.slice(F.col(vec), i * width + 1, width)))
    lines = F.concat(rows, F.array(label_line(F.col(label), width)))
    return df.select(item, F.posexplode(lines).alias("line_no", "line"))


def write_hex_lines(df: DataFrame, path: str, width: int, item: str = "row_id", vec: str = "vec", label: str = "label") -> None:
    """One text per item order: items are range-partitioned, so part files follow each other."""
    whole = hex_lines(df, width, item, vec, label)
    whole.repartitionByRange(item).sortWithinPartitions(item, "line_no").select("line").write.mode("errorifexists").text(path)


def weight_lines(weights: DataFrame, bits: int, per_word: int) -> DataFrame:
    """Weights packed to hex words, lowest input index in the lowest bits: ``(out_idx, pos, word)``."""
    from ..functions.packing import pack_hex
    from ..types import QuantType

    width = (bits * per_word + 3) // 4 * 4
    grouped = weights.groupBy("out_idx", whole_div(F.col("in_idx"), per_word).cast("int").alias("pos")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("in_idx", "w"))), lambda s: s["w"]).alias("vec")
    )
    return grouped.select("out_idx", "pos", pack_hex(F.col("vec"), QuantType.parse(f"INT{bits}"), width, reverse_inner=True).alias("word"))


def write_hex_words(words: DataFrame, path: str) -> None:
    """``(part, layer, line, word array)`` to ``path/part_layer_words.dat``-style files, one line each.

    A line starts with its number, so order does not depend on files.
    """
    named = words.select(
        F.format_string("%d_%d_words", "part", "layer").alias("name"),
        F.concat(F.col("line").cast("string"), F.lit(":"), F.array_join(F.transform("words", lambda w: F.lower(F.hex(w))), " ")).alias("value"),
    )
    named.write.partitionBy("name").mode("errorifexists").text(path)


def dump_activations(stages: dict[str, DataFrame], path: str) -> None:
    """Activations of each step ``(item, vec, status)`` in one table, partitioned by step and status."""
    for step, df in stages.items():
        df.withColumn("step", F.lit(step)).write.mode("append").partitionBy("step", "status").parquet(path)


def write_npy(df: DataFrame, path: str, vec: str = "vec", label: str | None = None) -> int:
    """Vectors as ``.npy`` files, one per Arrow batch, written by the tasks; gives the number of rows.

    With ``label`` it becomes the last column. File names come from partition and batch, so a
    repeated task replaces its own files.
    """

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pa_fs.FileSystem.from_uri(path)
        fs.create_dir(root, recursive=True)
        part = TaskContext.get().partitionId()
        for i, batch in enumerate(batches):
            if batch.num_rows == 0:
                continue
            rows = np.stack([np.asarray(v.as_py(), dtype=np.float64) for v in batch.column("vec")])
            if label is not None:
                rows = np.column_stack([rows, batch.column("label").to_numpy(zero_copy_only=False)])
            data = io.BytesIO()
            np.save(data, rows)
            with fs.open_output_stream(f"{root}/part-{part:05d}-{i:05d}.npy") as sink:
                sink.write(data.getvalue())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    cols = [F.col(vec).alias("vec")] + ([F.col(label).alias("label")] if label is not None else [])
    return df.select(*cols).mapInArrow(save, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
