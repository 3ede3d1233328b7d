"""A corpus pipeline: language, exact copies, near copies, mixture, tokens. Each stage works on what the one before it kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitloom.llm import exact_dedup, lang_id, ngram_join, queries
from bitloom.llm.common import stored, table

MIN_SCORE = 0.1


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: a text without a letter, or unlike all languages, goes."""
    profiles = lang_id.train(docs.filter(~lang_id.held_out(F.col("doc_id"))))
    return lang_id.identified(docs, profiles, min_score=MIN_SCORE)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(docs, keep="max")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.near_dedup(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each copy of a document, so what follows sees it in as many epochs as the mixture gives it."""
    chosen = queries.mixture(spark, docs).select(F.col("doc_id").alias("chosen_id"), F.struct(*queries.TREE).alias("leaf"), "copies")
    tree = {"domain": queries.domain_of(docs["source"]), "lang": docs["lang"], "source": docs["source"]}
    leaf = F.struct(*[F.coalesce(F.nullif(tree[c], F.lit("")), F.lit("(none)")).alias(c) for c in queries.TREE])
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), leaf.alias("at"))
    rows = rows.join(chosen, rows["row.doc_id"].eqNullSafe(chosen["chosen_id"]) & (F.col("at") == F.col("leaf")))
    return rows.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return queries.token_digests(spark, docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("exact_copies", exact_copies),
    ("near_copies", near_copies),
    ("mixture", mixture),
    ("tokens", tokens),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
