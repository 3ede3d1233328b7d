"""Readers for parameters, labelled data, arrays, weight words, reports and traces."""

from __future__ import annotations

import io
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.features import label_vocabulary
from ..operators.ranking import sample_items
from ..operators.scans import block_scan
from ..sizing import param_join

PARAM_SCHEMAS = {
    "vectors": "row_id BIGINT, vec ARRAY<INT>",
    "cells": "row_id BIGINT, h INT, w INT, c INT, val BIGINT",
    "weights": "model_id STRING, layer_id INT, in_idx INT, out_idx INT, w INT",
    "conv_weights": "model_id STRING, layer_id INT, kh INT, kw INT, c INT, out_idx INT, w INT",
    "thresholds": "model_id STRING, layer_id INT, channel INT, step INT, t DOUBLE",
    "quant_spec": "model_id STRING, layer_id INT, kind STRING, bits INT, signed BOOLEAN, narrow BOOLEAN, "
    "zero_point DOUBLE, channel INT, scale DOUBLE",
    "affine": "model_id STRING, layer_id INT, pos INT, op STRING, channel INT, val DOUBLE",
    "embeddings_q": "idx BIGINT, vec ARRAY<INT>",
    "stream": "stream_id STRING, seq BIGINT, word BIGINT, ts TIMESTAMP",
    "trace": "signal STRING, t BIGINT, val BIGINT",
    "layers": "model_id STRING, layer_id INT, op_type STRING, attrs MAP<STRING,STRING>",
    "edges": "model_id STRING, src INT, dst INT",
    "predictions": "run_id STRING, item BIGINT, label INT, scores ARRAY<BIGINT>",
}


def read_params(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """A parameter or feature table in Parquet, with the schema of its kind when given."""
    reader = spark.read if kind is None else spark.read.schema(PARAM_SCHEMAS[kind])
    return reader.parquet(path)


def read_labelled_csv(
    spark: SparkSession, train: str, test: str, schema: str | T.StructType, drop: Sequence[str] = ("id", "attack_cat")
) -> DataFrame:
    """Train and test CSV as one table; column ``split`` says where a row came from."""
    parts = [spark.read.csv(p, header=True, schema=schema).withColumn("split", F.lit(s)) for p, s in ((train, "train"), (test, "test"))]
    return parts[0].unionByName(parts[1]).drop(*drop)


def _array_rows(name: str, content: bytes) -> Iterator[tuple[str, np.ndarray]]:
    loaded = np.load(io.BytesIO(content), allow_pickle=False)
    if isinstance(loaded, np.ndarray):
        yield "", loaded
    else:
        for key in loaded.files:
            yield key, loaded[key]


def read_npy(spark: SparkSession, glob: str, labelled: bool = False, batch_rows: int = 8192) -> DataFrame:
    """``.npy`` and ``.npz`` files as ``(path, array, row, vec[, label])``, one row per innermost vector.

    Files are decoded in the tasks and leave them in batches; a labelled file keeps its label in
    the last column.
    """

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                for key, loaded in _array_rows(path, content.as_py()):
                    rows = loaded.reshape(-1, loaded.shape[-1]) if loaded.ndim > 1 else loaded.reshape(1, -1)
                    for start in range(0, len(rows), batch_rows):
                        part = rows[start : start + batch_rows].astype(np.float64)
                        n = len(part)
                        values = part[:, :-1] if labelled else part
                        offsets = np.arange(0, values.size + 1, max(values.shape[1], 1), dtype=np.int32)
                        columns = [
                            pa.array([path] * n),
                            pa.array([key] * n),
                            pa.array(np.arange(start, start + n, dtype=np.int64)),
                            pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.ravel())),
                        ]
                        names = ["path", "array", "row", "vec"]
                        if labelled:
                            columns.append(pa.array(part[:, -1].astype(np.int64)))
                            names.append("label")
                        yield pa.RecordBatch.from_arrays(columns, names=names)

    files = spark.read.format("binaryFile").load(glob).select("path", "content")
    schema = "path string, array string, row bigint, vec array<double>" + (", label bigint" if labelled else "")
    return files.mapInArrow(decode, schema)


def read_hex_words(spark: SparkSession, glob: str) -> DataFrame:
    """Whitespace-separated hex words from files ``a_b_*`` as ``(part, layer, line, pos, word)``.

    Words are numbered through the whole file with ``line`` 0. Where lines carry their own number
    in front of ``:``, ``line`` is that number and ``pos`` counts within it.
    """
    name = r"[/=](\d+)_(\d+)_[^/]*(?:/part-[^/]*)?$"
    lines = _numbered_lines(spark, glob).select(
        "file",
        "at",
        F.nullif(F.regexp_extract("line", r"^(\d+):", 1), F.lit("")).cast("long").alias("own"),
        F.filter(F.split(F.trim(F.regexp_replace("line", r"^\d+:", "")), r"\s+"), lambda s: s != "").alias("hex"),
    )
    size = F.when(F.col("own").isNull(), F.size("hex")).otherwise(0).cast("long")
    placed = block_scan(lines, ["file"], ["at"], sums={"before": size}, inclusive=False)
    words = placed.select(
        F.regexp_extract("file", name, 1).cast("int").alias("part"),
        F.regexp_extract("file", name, 2).cast("int").alias("layer"),
        F.coalesce("own", F.lit(0).cast("long")).alias("line"),
        F.when(F.col("own").isNull(), F.col("before")).otherwise(0).alias("before"),
        F.posexplode("hex").alias("i", "hex"),
    )
    return words.select("part", "layer", "line", (F.col("before") + F.col("i")).alias("pos"), F.conv("hex", 16, 10).cast("long").alias("word"))


def verify_words(written: DataFrame, read: DataFrame) -> DataFrame:
    """Words that differ, or exist on one side only."""
    key = ["part", "layer", "line", "pos"]
    a, b = written.select(*key, F.col("word").alias("written")), read.select(*key, F.col("word").alias("read"))
    return a.join(b, key, "full_outer").where(~F.col("written").eqNullSafe(F.col("read")))


def read_labelled_files(spark: SparkSession, root: str) -> DataFrame:
    """Files below class folders as ``(label, folder, name, path, length, content)``.

    The class id is the position of the folder in sorted order. ``sample_labelled_files`` reads
    a part of them.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    named = files.select(
        F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("folder"), F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "path", "length", "content"
    )
    classes = label_vocabulary(named.select("folder"), ["folder"]).select(F.col("value").alias("folder"), F.col("code").alias("label"))
    return param_join(named, classes, ["folder"], spread=["name"]).select("label", "folder", "name", "path", "length", "content")


#: longest sample whose names are given to the reader one by one
LISTED_FILES = 10_000


def sample_labelled_files(spark: SparkSession, root: str, n: int, interleave: bool) -> DataFrame:
    """``sample_items`` of the files below class folders, as ``read_labelled_files``.

    Names alone are listed and sampled, and only chosen files are opened. Up to ``LISTED_FILES`` names go by the driver; a longer
    sample is joined to all files.
    """
    names = read_labelled_files(spark, root).select("label", "folder", "name", "path")
    chosen, wanted = sample_items(names, n, interleave), [root]
    if n <= LISTED_FILES:
        rows = chosen.collect()
        chosen = spark.createDataFrame(rows, names.schema)
        wanted = [re.sub(r"([{}\[\]*?\\])", r"\\\1", r["path"]) for r in rows] or wanted
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(wanted)
    joined = param_join(files.select("path", "length", "content"), chosen, ["path"], spread=["path"])
    return joined.select("label", "folder", "name", "path", "length", "content")


def read_reports(spark: SparkSession, glob: str) -> DataFrame:
    """JSON reports as ``(model_id, layer_id, metric, value)``."""
    return spark.read.schema("model_id STRING, layer_id INT, metric STRING, value DOUBLE").json(glob)


# Headings of a utilisation report and their short names.
RESOURCES = {
    "Total LUTs": "LUT",
    "SRLs": "SRL",
    "FFs": "FF",
    "RAMB36": "BRAM_36K",
    "RAMB18": "BRAM_18K",
    "URAM": "URAM",
    "DSP Blocks": "DSP",
}


def read_xml_report(spark: SparkSession, glob: str, instances: Sequence[str] | None = None) -> DataFrame:
    """Utilisation tables as ``(file, instance, resource, value)``; instance ``(top)`` is the total.

    The row holding a cell ``Instance`` gives the position of each heading.
    """
    rows = (
        spark.read.format("xml")
        .option("rowTag", "tablerow")
        .schema("tablecell ARRAY<STRUCT<_contents: STRING>>")
        .load(glob)
        .select(F.col("_metadata.file_path").alias("file"), F.transform("tablecell", lambda c: F.trim(c["_contents"])).alias("cells"))
    )
    heads = rows.where(F.array_contains("cells", "Instance"))
    position = heads.select("file", F.posexplode("cells").alias("pos", "heading")).where(F.col("heading").isin(*RESOURCES))
    position = position.groupBy("file", "heading").agg(F.min("pos").alias("pos"))
    names = F.map_from_arrays(F.array(*[F.lit(k) for k in RESOURCES]), F.array(*[F.lit(v) for v in RESOURCES.values()]))
    body = rows.where(~F.array_contains("cells", "Instance"))
    body = body.withColumn("instance", F.element_at("cells", 1))
    if instances is not None:
        body = body.where(F.arrays_overlap("cells", F.array(*[F.lit(i) for i in instances])))
        body = body.withColumn("instance", F.element_at(F.array_intersect("cells", F.array(*[F.lit(i) for i in instances])), 1))
    joined = param_join(body, position, ["file"], spread=["instance"])
    return joined.select("file", "instance", names[F.col("heading")].alias("resource"), F.try_element_at("cells", F.col("pos") + 1).cast("int").alias("value")).where(
        F.col("value").isNotNull()
    )


def read_area_estimates(spark: SparkSession, glob: str) -> DataFrame:
    """Second report format: numbers below ``AreaEstimates/Resources`` as ``(file, resource, value)``."""
    kinds = ("BRAM_18K", "DSP", "DSP48E", "FF", "LUT", "URAM")
    schema = T.StructType([T.StructField("Resources", T.StructType([T.StructField(k, T.StringType()) for k in kinds]))])
    area = spark.read.format("xml").option("rowTag", "AreaEstimates").schema(schema).load(glob)
    pairs = F.array(*[F.struct(F.lit(k).alias("resource"), F.col(f"Resources.{k}").cast("long").alias("value")) for k in kinds])
    return area.select(F.col("_metadata.file_path").alias("file"), F.explode(pairs).alias("p")).select("file", "p.*").where(F.col("value").isNotNull())


def read_trace(spark: SparkSession, glob: str) -> DataFrame:
    """Change dumps as ``(file, signal, t, val)``; vectors are read as binary numbers, unknown states skipped.

    A line takes the last time mark before it. Marks are carried over blocks of lines, so one long
    dump is shared by many tasks.
    """
    raw = _numbered_lines(spark, glob)
    line = F.trim("line")
    mark = F.when(line.rlike(r"^#\d+$"), F.substring(line, 2, 30).cast("long"))
    scalar, vector = r"^([01xXzZ])(\S+)$", r"^[bB]([01xXzZ]+)\s+(\S+)$"
    is_vector = line.rlike(vector)
    code = F.when(is_vector, F.regexp_extract(line, vector, 2)).otherwise(F.regexp_extract(line, scalar, 2))
    digits = F.when(is_vector, F.regexp_extract(line, vector, 1)).otherwise(F.regexp_extract(line, scalar, 1))
    marked = block_scan(raw.withColumn("mark", mark), ["file"], ["at"], lasts={"t": F.col("mark")})
    changes = marked.select("file", "t", "at", code.alias("code"), digits.alias("digits")).where((F.col("code") != "") & F.col("t").isNotNull())
    known = changes.where(~F.col("digits").rlike("[xXzZ]"))
    joined = param_join(known, _signal_names(raw), ["file", "code"], spread=["at"])
    return joined.select("file", "signal", "t", F.conv("digits", 2, 10).cast("long").alias("val"))


def _signal_names(raw: DataFrame) -> DataFrame:
    """``(file, code, signal)`` with scopes joined by dots.

    Each variable looks up the last scope opened at every depth above it.
    """
    line = F.trim("line")
    variable = r"^\$var\s+\S+\s+\d+\s+(\S+)\s+(\S+)"
    head = raw.where(line.rlike(r"^\$(scope|upscope|var)\b")).select(
        "file",
        "at",
        F.when(line.startswith("$scope"), 1).when(line.startswith("$upscope"), -1).otherwise(0).alias("move"),
        F.regexp_extract(line, r"^\$scope\s+\S+\s+(\S+)", 1).alias("scope"),
        F.regexp_extract(line, variable, 1).alias("code"),
        F.regexp_extract(line, variable, 2).alias("name"),
    )
    deep = block_scan(head, ["file"], ["at"], sums={"depth": F.col("move").cast("long")})
    opened = deep.where("move = 1").select("file", F.col("depth").alias("k"), "at", F.col("scope").alias("part"), F.lit("").alias("code"), F.lit("").alias("name"))
    variables = deep.where("code <> ''").select(
        "file", F.explode(F.sequence(F.lit(0).cast("long"), F.col("depth"))).alias("k"), "at", F.lit(None).cast("string").alias("part"), "code", "name"
    )
    found = block_scan(opened.unionByName(variables), ["file", "k"], ["at"], lasts={"scope": F.col("part")}).where("code <> ''")
    path = F.array_sort(F.collect_list(F.when(F.col("scope").isNotNull(), F.struct("k", "scope"))))
    named = found.groupBy("file", "at", "code", "name").agg(path.alias("path"))
    full = F.array_join(F.concat(F.transform("path", lambda p: p["scope"]), F.array("name")), ".")
    return named.select("file", "code", full.alias("signal")).distinct()


def _numbered_lines(spark: SparkSession, glob: str) -> DataFrame:
    """``(file, at, line)`` where ``at`` orders the lines of a file.

    Text splits of a file start at known byte positions, and rows of a split keep their order.
    """
    lines = spark.read.text(glob).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("id"),
        F.col("value").alias("line"),
    )
    row = F.col("id").bitwiseAND(F.lit((1 << 33) - 1))
    return lines.select("file", (F.shiftleft(F.col("start"), 20) + row).alias("at"), "line")
