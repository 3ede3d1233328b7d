"""Longest paths in many acyclic graphs at once, in rounds that grow with the logarithm of the depth.

A node is an equation in max-plus form: ``path = own + max(base, path of each source + w)``. A round puts the
equations of the sources into those of their users, so an edge comes to stand for twice as many steps, edges to solved nodes
turn into ``base``, and parallel edges merge. A source with one edge is always put in; sources with more of them only where
the user then has at most ``width`` edges, so the tables never grow beyond ``width`` edges a node. Graphs of bounded width
(chains, skips, parallel branches, layers of a few nodes) are solved in logarithmic rounds, others in at most as many rounds
as they are deep.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..session import saved

#: most edges that a node may be given by a round
WIDTH = 16
_LEVEL = 1 << 48
_NODE = ["model_id", "node", "part"]


def _split_hubs(edges: DataFrame, width: int) -> DataFrame:
    """A node with very many edges gets them over helper nodes of no cost, ``part`` > 0, each with about ``width`` of them."""
    level = 0
    while True:
        counts = edges.where("part = 0").groupBy("model_id", "node").agg(F.count("*").alias("_n"))
        if (counts.agg(F.max("_n")).first()[0] or 0) <= width:
            return edges
        wide = counts.where(F.col("_n") > width)
        level += 1
        pieces = F.ceil(F.col("_n") * 2 / width)
        piece = F.lit(level * _LEVEL + 1) + F.pmod(F.xxhash64("src", "src_part"), pieces)
        marked = edges.join(wide, ["model_id", "node"], "left").withColumn("_hub", F.col("_n").isNotNull() & (F.col("part") == 0))
        marked = saved(marked.withColumn("_piece", F.when(F.col("_hub"), piece)), "hubs")
        moved = marked.withColumn("part", F.coalesce("_piece", "part"))
        links = marked.where("_hub").select("model_id", "node", F.lit(0).cast("long").alias("part"), F.col("node").alias("src"), F.col("_piece").alias("src_part")).distinct()
        edges = moved.select(*links.columns).unionByName(links)


def _equations(cost: DataFrame, edges: DataFrame, width: int) -> DataFrame:
    """One row per node: its cost, what is known of its sources, and its edges."""
    kept = edges.select("model_id", F.col("dst").alias("node"), F.lit(0).cast("long").alias("part"), "src", F.lit(0).cast("long").alias("src_part")).distinct()
    kept = _split_hubs(saved(kept, "edges"), max(width, WIDTH))
    edge = F.struct("src", "src_part", F.lit(0).cast("long").alias("w"), F.lit(1).cast("long").alias("steps"))
    ins = kept.groupBy(*_NODE).agg(F.collect_list(edge).alias("ins"))
    own = cost.select("model_id", F.col("layer_id").alias("node"), F.lit(0).cast("long").alias("part"), "cycles")
    both = own.join(ins, _NODE, "full")
    zero = F.lit(0).cast("long")
    lost = F.raise_error(F.concat(F.lit("edge without its dst node in model "), F.col("model_id").cast("string"))).cast("long")
    helper = F.when(F.col("part") > 0, zero).otherwise(lost)
    known = F.col("cycles").isNotNull() | F.col("ins").isNull()
    return both.select(
        *_NODE,
        F.when(known, F.col("cycles")).otherwise(helper).alias("own"),
        F.when(F.col("ins").isNull(), zero).alias("base"),
        F.coalesce("ins", F.array().cast(ins.schema["ins"].dataType)).alias("ins"),
        F.lit(True).alias("moved"),
    )


def _round(nodes: DataFrame, width: int, limit: int) -> DataFrame:
    """Put the equations of all sources into those of their users."""
    open_ = nodes.where(F.size("ins") > 0)
    asked = open_.select(*_NODE, "own", "base", F.explode("ins").alias("e"))
    u = nodes.select(
        "model_id",
        F.col("node").alias("_src"),
        F.col("part").alias("_part"),
        F.struct(F.col("own").alias("own"), F.col("base").alias("base"), F.col("ins").alias("ins")).alias("u"),
    )
    met = asked.join(u, (asked["model_id"] == u["model_id"]) & (F.col("e.src") == F.col("_src")) & (F.col("e.src_part") == F.col("_part")), "left")
    lost = F.raise_error(F.concat(F.lit("edge without its src node in model "), asked["model_id"].cast("string")))
    step = F.struct("e.*", F.when(F.col("u").isNull(), lost.cast(u.schema["u"].dataType)).otherwise(F.col("u")).alias("u"))
    users = met.groupBy(asked["model_id"], "node", "part").agg(F.first("own").alias("own"), F.first("base").alias("base"), F.collect_list(step).alias("es"))
    sizes = F.aggregate("es", F.lit(0), lambda n, e: n + F.greatest(F.size(e["u"]["ins"]), F.lit(1)))
    users = users.withColumn("_fits", sizes <= width)

    def put(e: Column) -> Column:
        return (F.size(e["u"]["ins"]) <= 1) | F.col("_fits")

    def through(e: Column) -> Column:
        return F.transform(
            e["u"]["ins"],
            lambda i: F.struct(
                i["src"].alias("src"), i["src_part"].alias("src_part"), (i["w"] + e["u"]["own"] + e["w"]).alias("w"), (i["steps"] + e["steps"]).alias("steps")
            ),
        )

    same = F.transform(F.filter("es", lambda e: ~put(e)), lambda e: F.struct(e["src"].alias("src"), e["src_part"].alias("src_part"), e["w"].alias("w"), e["steps"].alias("steps")))
    known = F.array_max(F.transform(F.filter("es", put), lambda e: e["u"]["base"] + e["u"]["own"] + e["w"]))
    users = users.select(
        *_NODE,
        "own",
        F.greatest("base", known).alias("base"),
        F.array_sort(F.concat(F.flatten(F.transform(F.filter("es", put), through)), same)).alias("all"),
        F.exists("es", put).alias("moved"),
    )
    # of parallel edges the heaviest, which sorts last
    kept = F.filter("all", lambda e, i: F.coalesce((F.get("all", i + 1)["src"] != e["src"]) | (F.get("all", i + 1)["src_part"] != e["src_part"]), F.lit(True)))
    users = users.select(*_NODE, "own", "base", kept.alias("ins"), "moved")
    # a walk with more steps than there are nodes comes by a node twice
    cycle = F.raise_error(F.lit("the graph of a model has a cycle")).cast("boolean")
    walked = F.exists("ins", lambda e: (e["steps"] > limit) | ((e["src"] == F.col("node")) & (e["src_part"] == F.col("part"))))
    users = users.withColumn("moved", F.when(walked, cycle).otherwise(F.col("moved")))
    return users.unionByName(nodes.where(F.size("ins") == 0).select(*_NODE, "own", "base", "ins", F.lit(True).alias("moved")))


def _counted(nodes: DataFrame) -> tuple[DataFrame, int, int, int]:
    """The nodes written down, with how many there are, have edges left, and did not move, counted on the way."""
    seen = Observation()
    counts = F.count(F.lit(1)).alias("n"), F.count_if(F.size("ins") > 0).alias("left"), F.count_if(~F.col("moved")).alias("stuck")
    out = saved(nodes.observe(seen, *counts), "paths")
    return out, seen.get["n"], seen.get["left"], seen.get["stuck"]


def critical_path(nodes: DataFrame, edges: DataFrame, width: int = WIDTH) -> DataFrame:
    """Longest path per node ``(model_id, layer_id, path)`` in acyclic graphs; ``nodes`` carry ``cycles``.

    Repeated edges count once. An edge from or to a node that is not there, and a cycle, are errors."""
    cost = nodes.select("model_id", "layer_id", F.col("cycles").cast("long").alias("cycles"))
    table, total, left, _ = _counted(_equations(cost, edges, width))
    while left:
        table, _, left, stuck = _counted(_round(table, width, total))
        if left and left == stuck:
            raise ValueError("the graph of a model has a cycle")
    return table.where("part = 0").select("model_id", F.col("node").alias("layer_id"), (F.col("own") + F.col("base")).alias("path"))
