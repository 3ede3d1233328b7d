"""N-gram Jaccard join by MinHash banding.

A text's words are its lower-case runs of non-white-space; its n-grams are hashed to 64 bits and form a set (a text of fewer words
has one gram, all its words). Texts with one set are a class and join as one node with a weight. Band and row counts
follow from the threshold and the target recall. Band hashes are shuffled; what shares a band is compared by the
full sets, block against block, with a boolean matrix product over the grams that occur twice.

Signatures stay in the shared folder as (id, node, keys); sets are made again from the text for those texts that share a band,
so only these move.

Defined results: texts without a word (null, empty, blank) link with nothing, also not with each other; repeated rows
are copies; a null id is no class id unless all ids of the class are null; columns besides id and text are not read by
``ngram_links`` and all kept by ``near_dedup``.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks
from .common import stored
from .components import components

NGRAM = 5
THRESHOLD = 0.8
RECALL = 0.9999
MAX_HASHES = 128
SEED = 11
ROWS = 512  # sets held by a task at once


def choose_bands(threshold: float, recall: float, max_hashes: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows, so the fewest false candidates, whose bands reach the recall at the threshold within
    ``max_hashes``. If no number of rows does, bands of one row, as many as the recall asks for."""
    best = (math.ceil(math.log(1 - recall) / math.log1p(-threshold)), 1)
    for rows in range(1, max_hashes + 1):
        bands = math.ceil(math.log(1 - recall) / math.log1p(-(threshold**rows)))
        if bands * rows > max_hashes:
            break
        best = (bands, rows)
    return best


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    """Hash of each word, remembered for a bounded number of words."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 1 << 17:
            self.clear()
        out = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "replace"))
        return out


def gram_set(text: str | None, n: int, words: _Words) -> np.ndarray:
    """Sorted distinct hashes of the n-grams of words."""
    found = (text or "").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(words.__getitem__, found), np.uint64, len(found))
    k = min(n, len(w))
    h = np.full(len(w) - k + 1, k, np.uint64)
    for i in range(k):
        h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + w[i : len(w) - k + 1 + i])
    return np.unique(h)


def set_id(grams: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(grams.tobytes()) - (1 << 63)


def signature(grams: np.ndarray, factors: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    low = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(grams), 1024):
        low = np.minimum(low, (grams[at : at + 1024, None] * factors + offsets).min(0))
    return low


def band_keys(low: np.ndarray, bands: int, rows: int) -> np.ndarray:
    h = np.arange(1, bands + 1, dtype=np.uint64)
    for col in low[: bands * rows].reshape(bands, rows).T:
        h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + col)
    return h.view(np.int64)


def _signatures(n: int, bands: int, rows: int):
    rng = np.random.default_rng(SEED)
    factors = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    offsets = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64)

    def run(batches):
        words = _Words()
        for batch in batches:
            nodes, sizes, keys = [], [], []
            for text in batch.column(1):
                grams = gram_set(text.as_py(), n, words)
                sizes.append(len(grams))
                nodes.append(set_id(grams) if len(grams) else None)
                keys.append(band_keys(signature(grams, factors, offsets), bands, rows) if len(grams) else np.empty(0, np.int64))
            flat = pa.array(np.concatenate([*keys, np.empty(0, np.int64)]))
            offset = pa.array(np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(offset, flat), *batch.columns[2:]], ["id", "node", "grams", "keys", *batch.schema.names[2:]])

    return run


def _sets(n: int):
    def run(batches):
        words = _Words()
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                sets = [gram_set(t.as_py(), n, words) for t in part.column(1)]
                nodes = pa.array([set_id(s) if len(s) else None for s in sets], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), nodes, pa.array([s.tobytes() for s in sets], pa.binary()), *part.columns[2:]], ["id", "made", "payload", "node", "weight", "seats"])

    return run


def jaccard_links(threshold: float):
    """Kernel for ``blocks.link``: pairs of sets with at least this similarity."""

    def kernel(payloads: list[bytes]) -> np.ndarray:
        sets = [np.frombuffer(p, np.uint64) for p in payloads]
        sizes = np.array([len(s) for s in sets], np.float64)
        grams = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        order = np.argsort(grams, kind="stable")
        grams, owner = grams[order], owner[order]
        same = grams[1:] == grams[:-1]
        twice = np.zeros(len(grams), bool)  # a gram of one set alone is in no intersection
        twice[1:] |= same
        twice[:-1] |= same
        grams, owner = grams[twice], owner[twice]
        column = np.cumsum(np.concatenate([[0], grams[1:] != grams[:-1]])) if len(grams) else np.empty(0, np.int64)
        common = np.zeros((len(sets), len(sets)))
        width = 4096
        for at in range(0, int(column[-1]) + 1 if len(column) else 0, width):
            b, e = np.searchsorted(column, [at, at + width])
            has = np.zeros((len(sets), width), np.float32)
            has[owner[b:e], column[b:e] - at] = 1
            common += has @ has.T
        return common >= threshold * (sizes[:, None] + sizes[None, :] - common) - 1e-9

    return kernel


def _linked(texts: DataFrame, n: int, threshold: float, recall: float) -> DataFrame:
    """texts: id, t, h (hash of the text) and further columns. One row per row: id, h, the further columns, root (of its class,
    null without a word), class_id, n_links, n_grams."""
    more = texts.columns[2:]
    bands, rows = choose_bands(threshold, recall)
    kind = texts.schema["id"].dataType.simpleString()
    further = "".join(f", {c} {texts.schema[c].dataType.simpleString()}" for c in more)
    signed = stored(texts.mapInArrow(_signatures(n, bands, rows), f"id {kind}, node bigint, grams bigint, keys array<bigint>{further}"), "bands")

    # an id and a text hash name one text of the class, to find it again, whatever ids are null or repeated
    classes = signed.filter("node is not null").groupBy("node").agg(
        F.count(F.lit(1)).alias("weight"),
        F.min("id").alias("first_id"),
        F.min(F.struct("id", "h")).alias("head"),
        F.first("grams").alias("grams"),
        F.first("keys").alias("keys"),
    )
    classes = stored(classes, "classes")
    seats = blocks.seats(classes.select("node", (F.col("grams") * 8).alias("size"), "keys"))
    wanted = seats.join(classes.select("node", "weight", F.col("head.id").alias("head_id"), F.col("head.h").alias("head_h")), "node")
    found = texts.join(wanted, texts["id"].eqNullSafe(wanted["head_id"]) & (texts["h"] == wanted["head_h"])).select("id", "t", "node", "weight", "seats")
    if not signed.groupBy("id", "h").count().filter("count > 1").isEmpty():
        found = found.dropDuplicates(["node"])  # rows given more than once are found more than once
    seat = found.schema["seats"].dataType.simpleString()
    sets = found.mapInArrow(_sets(n), f"id {kind}, made bigint, payload binary, node bigint, weight bigint, seats {seat}")
    links = blocks.link(sets.filter("made = node").drop("id", "made"), jaccard_links(threshold), "links")

    roots = components(links.select(F.col("node").alias("a"), F.col("root").alias("b")))
    counts = links.groupBy("node").agg(F.sum("links").alias("links"))
    nodes = classes.select("node", "weight", "first_id").join(counts, "node", "left").join(roots, "node", "left")
    nodes = nodes.withColumn("root", F.coalesce("root", "node"))
    named = nodes.groupBy("root").agg(F.min("first_id").alias("class_id"))
    nodes = nodes.join(named, "root").select("node", "root", "class_id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    return signed.join(nodes, "node", "left").select(
        "id",
        *more,
        "root",
        F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        F.col("grams").alias("n_grams"),
    )


def ngram_links(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    n: int = NGRAM,
    threshold: float = THRESHOLD,
    recall: float = RECALL,
) -> DataFrame:
    """One row per row: id, class_id (smallest id reachable by links), n_links (other rows directly linked), n_grams."""
    texts = docs.select(docs[id_col].alias("id"), docs[text_col].alias("t"), F.xxhash64(docs[text_col]).alias("h"))
    return _linked(texts, n, threshold, recall).select(F.col("id").alias(id_col), "class_id", "n_links", "n_grams")


def near_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    n: int = NGRAM,
    threshold: float = THRESHOLD,
    recall: float = RECALL,
) -> DataFrame:
    """One row of each class, the one with the smallest id, with all its columns. Rows that repeat an id with the same
    text are one document; of texts of a class that share its smallest id one stays; rows with a null id stay. Texts
    are told apart by a 64-bit hash."""
    texts = docs.select(docs[id_col].alias("id"), docs[text_col].alias("t"), F.xxhash64(docs[text_col]).alias("h"))
    rows = _linked(texts, n, threshold, recall).filter(F.col("id").isNotNull())
    first = rows.filter(F.col("root").isNotNull() & (F.col("id") == F.col("class_id")))
    first = first.groupBy("root").agg(F.min("id").alias("kept_id"), F.min("h").alias("kept_h")).drop("root")
    stay = first.unionByName(rows.filter(F.col("root").isNull()).select(F.col("id").alias("kept_id"), F.col("h").alias("kept_h")))
    row = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    row_id = F.col(f"row.{id_col}")
    named = row.filter(row_id.isNotNull()).withColumn("row_h", F.xxhash64(f"row.{text_col}"))
    kept = named.join(stay, (row_id == F.col("kept_id")) & (F.col("row_h") == F.col("kept_h")), "left_semi").select("row")
    return kept.unionByName(row.filter(row_id.isNull())).select("row.*")
