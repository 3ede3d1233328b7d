"""URL rules by a sort-merge range join.

A host is turned round, ``www.example.com`` into ``com.example.www.``, so a rule's host and all its subdomains are one
interval of keys. Urls and the ends of the rules' intervals are sorted together, and the sweep keeps the stack of nested
rules that are open at each url; the paths of these rules decide which fit. Sampled splitters cut the sweep into
ranges; the splitters hold a tie-break, so one host that has a third of all urls lies in many ranges. Each range opens
with the stack that is open at its splitter.

Defined results: a null url or one without ``://`` has empty host and path and no rule; a host without rule, or a path that
does not start with a rule's path, gets the default verdict; the longest rule wins (host before path; of equal rules the
smaller verdict); repeated rows stay repeated; columns besides id and url are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import UPPER, shuffle_partitions

STACK = "array<struct<host:string,path:string,verdict:string>>"
SAMPLE = 64  # sampled urls per range
FINE = 64  # splitters looked through in the second step of a search
FIRST = -(2**63)


def host_of(url: Column) -> Column:
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, UPPER.lower())
    return F.when(F.instr(url, "://") > 0, host).otherwise(F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


def host_key(host: Column) -> Column:
    """Labels from the last to the first, each with its dot; empty for an empty host."""
    key = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))
    return F.when(host == "", F.lit("")).otherwise(key)


def _stacks(points: DataFrame, rules: DataFrame) -> DataFrame:
    """points with the rules open at their key, outermost first; each key has as many candidates as labels."""
    labels = F.split(F.expr("substring(key, 1, length(key) - 1)"), r"\.")
    prefixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda n: F.concat(F.array_join(F.slice(labels, F.lit(1), n), "."), F.lit(".")),
    )
    open_at = points.select("key", F.explode(F.array_distinct(prefixes)).alias("lo")).distinct().join(rules, "lo")
    open_at = open_at.groupBy("key").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(F.length("lo").alias("n"), "own"))), lambda s: s["own"])).alias("stack")
    )
    return points.join(open_at, "key", "left").withColumn("stack", F.coalesce("stack", F.expr(f"cast(array() as {STACK})")))


def _splitters(urls: DataFrame, ranges: int) -> list[tuple[str, int]]:
    """At most ranges - 1 of SAMPLE * ranges urls, drawn by a hash of the row."""
    drawn = urls.select("key", "tie").orderBy(F.xxhash64("tie", F.lit(7)), "key").limit(SAMPLE * ranges).collect()
    drawn = sorted(((r["key"].encode(), r["tie"]) for r in drawn))
    cuts = dict.fromkeys(drawn[i] for i in range(SAMPLE, len(drawn), SAMPLE))
    return [(k.decode(), t) for k, t in cuts]


def _range_of(splitters: list[tuple[str, int]], key: Column, tie: Column) -> Column:
    """Number of splitters that are not above (key, tie): every FINE-th first, then those in between."""
    if not splitters:
        return F.lit(0)
    point = F.struct(key.alias("key"), tie.alias("tie"))
    below = lambda some: F.size(F.filter(some, lambda s: s <= point))
    as_array = lambda some: F.array(*[F.struct(F.lit(k).alias("key"), F.lit(t).cast("long").alias("tie")) for k, t in some])
    coarse = splitters[FINE - 1 :: FINE]
    if not coarse:
        return below(as_array(splitters))
    skipped = below(as_array(coarse)) * FINE
    return skipped + below(F.slice(as_array(splitters), skipped + 1, F.lit(FINE)))


def judge_urls(
    pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow"
) -> DataFrame:
    """pages: id and url; rules: host, path, verdict. Gives id, host, path, rule, verdict."""
    spark = pages.sparkSession
    urls = pages.select(pages[id_col].alias("id"), pages[url_col].alias("url"))
    urls = urls.select("id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    urls = urls.fillna("", ["host", "path"])
    urls = urls.withColumns({"key": host_key(F.col("host")), "tie": F.xxhash64("id", "path")})

    own = F.struct(F.col("host"), F.col("path"), F.col("verdict"))
    rules = rules.select(F.translate("host", UPPER, UPPER.lower()).alias("host"), "path", "verdict")
    rules = rules.dropna().dropDuplicates().withColumn("lo", host_key(F.col("host"))).filter("lo <> ''")
    rules = rules.groupBy("lo").agg(F.array_sort(F.collect_list(own)).alias("own"))

    splitters = _splitters(urls, shuffle_partitions(spark))
    begins = rules.select(F.col("lo").alias("key"))
    opened = _stacks(begins, rules)
    # the byte after "." ends the interval; what is open then is the stack without its last host
    last = F.element_at("stack", -1)["host"]
    closed = opened.select(
        F.expr("concat(substring(key, 1, length(key) - 1), '/')").alias("key"),
        F.filter("stack", lambda s: s["host"] != last).alias("stack"),
    )
    bounds = opened.select("key", "stack").unionByName(closed).withColumn("tie", F.lit(FIRST))
    bounds = bounds.withColumns({"part": _range_of(splitters, F.col("key"), F.col("tie")), "later": F.lit(1)})
    if splitters:
        cuts = [(i + 1, k, t) for i, (k, t) in enumerate(splitters)]
        cuts = spark.createDataFrame(cuts, "part int, key string, tie long")
        bounds = bounds.unionByName(_stacks(cuts, rules).withColumn("later", F.lit(0)))

    urls = urls.withColumns({"part": _range_of(splitters, F.col("key"), F.col("tie")), "later": F.lit(1)})
    both = urls.withColumn("is_url", F.lit(True)).unionByName(bounds, allowMissingColumns=True)
    sweep = W.partitionBy("part").orderBy("later", "key", "tie").rowsBetween(W.unboundedPreceding, W.currentRow)
    both = both.withColumn("open", F.last("stack", ignorenulls=True).over(sweep)).filter("is_url")
    fits = F.transform(
        F.filter("open", lambda s: F.col("path").startswith(s["path"])),
        lambda s: F.struct(F.length(s["host"]).alias("h"), F.length(s["path"]).alias("p"), F.concat(s["host"], s["path"]).alias("rule"), s["verdict"].alias("verdict")),
    )
    best = F.reduce(fits, F.expr("cast(null as struct<h:int,p:int,rule:string,verdict:string>)"), lambda a, s: F.when(a.isNull() | (s["h"] > a["h"]) | ((s["h"] == a["h"]) & (s["p"] > a["p"])), s).otherwise(a))
    return both.withColumn("best", best).select(
        F.col("id").alias(id_col),
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )
