"""Analytics over tables of model layers ``(model_id, layer_id, op_type, attrs)`` and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, saved
from ..sizing import param_join
from .paths import critical_path

# Memory primitives as (width, depth).
MEMORY_PRIMITIVES = {
    "URAM_72x4096": (72, 4096),
    "URAM_36x8192": (36, 8192),
    "URAM_18x16384": (18, 16384),
    "URAM_9x32768": (9, 32768),
    "BRAM18_36x512": (36, 512),
    "BRAM18_18x1024": (18, 1024),
    "BRAM18_9x2048": (9, 2048),
    "LUTRAM": (1, 64),
}

SAME_SHAPE_OPS = ("add", "sub", "concat", "channelwise", "duplicate", "threshold")


def attr(name: str, default: int | None = 1) -> Column:
    """A whole-number attribute of a layer."""
    value = F.try_element_at("attrs", F.lit(name)).cast("long")
    return F.coalesce(value, F.lit(default).cast("long")) if default is not None else value


def op_counts(layers: DataFrame) -> DataFrame:
    """``(model_id, layer_id, metric, value)``: products and parameters per layer."""
    wb, ib, tb = attr("weight_bits"), attr("input_bits"), attr("acc_bits")
    mac = F.concat(F.lit("op_mac_"), F.least(ib, wb).cast("string"), F.lit("bx"), F.greatest(ib, wb).cast("string"), F.lit("b"))
    weight = F.concat(F.lit("param_weight_"), wb.cast("string"), F.lit("b"))
    threshold = F.concat(F.lit("param_threshold_"), tb.cast("string"), F.lit("b"))
    own = F.concat(F.lit("param_threshold_"), wb.cast("string"), F.lit("b"))
    active = attr("no_activation", 0) == 0

    def entry(name: Column, value: Column) -> Column:
        return F.struct(name.alias("metric"), value.cast("double").alias("value"))

    mw, mh, kk = attr("MW"), attr("MH"), attr("kh") * attr("kw")
    none = F.lit(None).cast("struct<metric:string,value:double>")
    matmul = F.array(entry(mac, mw * mh * attr("vec")), entry(weight, mw * mh), F.when(active, entry(threshold, mh)).otherwise(none))
    depthwise = F.array(
        entry(mac, kk * attr("C") * attr("H") * attr("W")), entry(weight, kk * attr("C")), F.when(active, entry(threshold, attr("C"))).otherwise(none)
    )
    alone = F.array(entry(own, attr("C") * attr("steps")))
    entries = F.when(F.col("op_type") == "matmul", matmul).when(F.col("op_type") == "depthwise", depthwise).when(F.col("op_type") == "threshold", alone)
    rows = layers.select("model_id", "layer_id", F.explode(F.filter(entries, lambda e: e.isNotNull())).alias("e"))
    return rows.select("model_id", "layer_id", "e.metric", "e.value")


def totals(metrics: DataFrame) -> DataFrame:
    """Values per model and metric; metrics named after an efficiency are not summed."""
    return metrics.where(~F.col("metric").contains("efficiency")).groupBy("model_id", "metric").agg(F.sum("value").alias("value"))


def layers_and_totals(metrics: DataFrame) -> DataFrame:
    """Per-layer values and model totals (``layer_id`` null) in one aggregate."""
    kept = metrics.where(~F.col("metric").contains("efficiency"))
    sets = [[F.col("model_id"), F.col("layer_id"), F.col("metric")], [F.col("model_id"), F.col("metric")]]
    return kept.groupingSets(sets, "model_id", "layer_id", "metric").agg(F.sum("value").alias("value"))


def _a(name: str, default: int = 1) -> str:
    """SQL for a whole-number attribute of a layer."""
    return f"coalesce(CAST(try_element_at(attrs, '{name}') AS BIGINT), {default}L)"


def _in(*ops: str) -> str:
    return "op_type IN (" + ", ".join(f"'{o}'" for o in ops) + ")"


COST = ("_base", "_work", "_by_pe", "_by_simd")


def with_cost(layers: DataFrame) -> DataFrame:
    """Add the terms of each layer's cycle estimate ``floor(base + work / factors)``.

    ``_by_pe`` and ``_by_simd`` say which factors divide the work. Attributes are read once here,
    so trying a candidate later is one division.
    """
    names = "C vec batch kh kw dh dw sh sw H W OH OW MW MH labels".split()
    flags = "is1d depthwise parallel_window".split()
    # all attributes by one lambda: read one by one, their code makes a method too long for the JVM to compile
    listed = ", ".join(f"'{n}'" for n in [*names, *flags])
    values = f"transform(array({listed}), (n, i) -> double(coalesce(CAST(try_element_at(attrs, n) AS BIGINT), if(i < {len(names)}, 1L, 0L)))) AS _l"
    read = [f"_l[{i}] AS `_l_{n}`" for i, n in enumerate(names)]
    read += [f"_l[{len(names) + i}] = 1 AS _l_{n}" for i, n in enumerate(("flat", "deep", "par"))]
    known = layers.selectExpr("*", values).selectExpr("*", *read).drop("_l")
    naive = "_l_deep AND (_l_sw * _l_sh > 2 OR _l_dw * _l_dh > 1)"  # depthwise with a stride above 2, or dilated
    window = f"""CASE WHEN NOT _l_flat THEN _l_C * (_l_W * _l_kh * _l_dh + _l_OH * greatest(_l_OW * _l_kh * _l_kw, _l_sw * _l_W))
        WHEN _l_par THEN 0 WHEN {naive} THEN _l_C * _l_OW * _l_kw + _l_C * _l_W WHEN _l_deep THEN _l_C * _l_OW * _l_kw + _l_C * (_l_kw - 1)
        ELSE _l_C * _l_OW * _l_kw END"""
    work = f"""CASE WHEN op_type = 'matmul' THEN _l_MH * _l_MW * _l_vec
        WHEN op_type = 'depthwise' THEN _l_C * _l_kh * _l_kw * _l_H * _l_W
        WHEN {_in(*SAME_SHAPE_OPS)} THEN _l_vec * _l_C
        WHEN op_type = 'sumpool' THEN _l_vec * _l_C + _l_C
        WHEN op_type = 'pool' THEN _l_C * _l_kh * _l_kw * _l_OH * _l_OW * _l_batch
        WHEN op_type = 'maxpool' THEN if(_l_flat, _l_OW * _l_C * (_l_kw + 1), 0)
        WHEN op_type = 'im2col' THEN {window}
        WHEN op_type = 'downsample' THEN _l_C * _l_batch * if(_l_flat, _l_W, _l_W * _l_W)
        WHEN {_in("pad", "pixelpad")} THEN _l_C * _l_batch * _l_OH * _l_OW
        WHEN op_type = 'upsample' THEN if(_l_flat, _l_OW, _l_OW * _l_OW * _l_batch)
        WHEN op_type = 'topk' THEN _l_labels WHEN op_type = 'lookup' THEN _l_vec END"""
    base = f"""CASE WHEN op_type = 'maxpool' AND NOT _l_flat THEN _l_W * _l_W * (1 + 1 / (_l_kw * _l_kw))
        WHEN op_type = 'im2col' AND _l_flat THEN CASE WHEN _l_par THEN _l_kw + _l_OW WHEN {naive} THEN 0 WHEN _l_deep THEN 2 - _l_kw ELSE 1 END ELSE 0 END"""
    by_pe = _in("matmul", "depthwise", "sumpool", "pool", "maxpool", "topk", *SAME_SHAPE_OPS)
    by_simd = _in("matmul", "depthwise", "im2col", "downsample", "pad", "pixelpad")
    return known.selectExpr("*", f"double({base}) AS _base", f"double({work}) AS _work", f"{by_pe} AS _by_pe", f"{by_simd} AS _by_simd").drop(*[f"_l_{n}" for n in [*names, "flat", "deep", "par"]])


def cycles_at(pe: str, simd: str) -> str:
    """SQL for the cycles per item at a given parallelism; needs the columns of ``with_cost``."""
    return f"CAST(floor(_base + _work / (if(_by_pe, {pe}, 1) * if(_by_simd, {simd}, 1))) AS BIGINT)"


def cycles(layers: DataFrame) -> DataFrame:
    """Layers with their cycle estimate."""
    return with_cost(layers).selectExpr("*", f"{cycles_at(_a('PE'), _a('SIMD'))} AS cycles").drop(*COST)


def performance(nodes: DataFrame, edges: DataFrame, clk_ns: float) -> DataFrame:
    """Slowest layer (the first on ties), critical path, rate and latency per model."""
    nodes = saved(nodes.select("model_id", "layer_id", "cycles"), "cycles")
    path = critical_path(nodes, edges).groupBy("model_id").agg(F.max("path").alias("critical_path_cycles"))
    slow = nodes.groupBy("model_id").agg(
        F.max("cycles").alias("max_cycles"), F.max_by("layer_id", F.struct("cycles", -F.col("layer_id"))).alias("max_cycles_layer")
    )
    out = slow.join(path, "model_id")
    return out.select(
        "model_id",
        "max_cycles",
        "max_cycles_layer",
        "critical_path_cycles",
        (F.lit(1e9) / clk_ns / F.col("max_cycles")).alias("items_per_s"),
        (F.col("critical_path_cycles") * clk_ns).alias("latency_ns"),
    )


def memory_fit(requests: DataFrame, primitives: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    """Each memory request on each primitive, ranked by waste; row-local, no shuffle.

    ``requests`` carry ``width`` and ``depth``. Ties keep the order of the primitives.
    """
    table = MEMORY_PRIMITIVES if primitives is None else primitives
    options = []
    for order, (name, (pw, pd)) in enumerate(table.items()):
        count = F.ceil(F.col("width") / pw) * F.ceil(F.col("depth") / pd)
        need, have = F.col("width") * F.col("depth"), count * (pw * pd)
        options.append(
            F.struct(
                (have - need).cast("long").alias("waste"),
                F.lit(order).alias("order"),
                F.lit(name).alias("primitive"),
                count.cast("long").alias("count"),
                (need / have).alias("efficiency"),
            )
        )
    ranked = requests.select("*", F.posexplode(F.array_sort(F.array(*options))).alias("rank", "o"))
    return ranked.select(*requests.columns, "o.primitive", "o.count", "o.efficiency", "o.waste", (F.col("rank") + 1).alias("rank"))


def divisors(n: str) -> str:
    """SQL for the divisors of a number in ascending order, found up to the square root."""
    small = f"filter(sequence(1L, CAST(floor(sqrt({n})) AS BIGINT)), d -> {n} % d = 0)"
    return f"array_sort(array_distinct(flatten(transform({small}, d -> array(d, {n} DIV d)))))"


def _first_meeting(options: str, cycles_for: str) -> str:
    """SQL for the first option ``v`` below the goal, else the largest."""
    return f"coalesce(try_element_at(filter({options}, v -> {cycles_for} < _goal), 1), element_at({options}, -1))"


# operators whose factor is called PE, and those whose factor is called SIMD
PE_OPS = ("add", "channelwise", "duplicate", "sumpool", "threshold")
SIMD_OPS = ("downsample", "pad", "pixelpad", "im2col")


def _one_sweep(layers: DataFrame, target: str, max_weight_bits: int) -> DataFrame:
    """Choose factors per layer; every candidate is tried inside its own row."""
    work = with_cost(layers).selectExpr("*", f"CAST({target} AS BIGINT) AS _goal", f"{_a('MW')} AS _mw", f"{_a('weight_bits')} AS _bits", f"{_a('kh')} * {_a('kw')} AS _taps", f"{_a('C')} AS _c")
    # input width of a product: stop at the first option that meets the target or is too wide
    work = work.selectExpr("*", f"if(op_type = 'matmul', {divisors('_mw')}, NULL) AS _wide")
    work = work.selectExpr("*", f"try_element_at(filter(_wide, v -> {cycles_at('1', 'v')} < _goal OR _bits * v > {max_weight_bits}), 1) AS _stop")
    first = f"""CASE WHEN _wide IS NULL THEN 1L WHEN _stop IS NULL THEN element_at(_wide, -1) WHEN {cycles_at("1", "_stop")} < _goal THEN _stop
        ELSE coalesce(try_element_at(filter(_wide, v -> v < _stop), -1), 1L) END"""
    limit = f"CASE WHEN op_type = 'matmul' THEN {_a('MH')} WHEN op_type = 'topk' THEN {_a('labels')} WHEN {_in(*PE_OPS, 'depthwise', 'pool')} THEN _c END"
    work = work.selectExpr("*", f"{first} AS _first", f"{limit} AS _limit")
    work = work.selectExpr("*", f"if(_limit IS NOT NULL, {divisors('_limit')}, NULL) AS _tall")
    work = work.selectExpr("*", f"if(_limit IS NOT NULL, {_first_meeting('_tall', cycles_at('v', '_first'))}, {_a('PE')}) AS _pe")
    spare = f"op_type = 'depthwise' AND _pe = _c AND {cycles_at('_pe', '1')} > _goal"
    free = f"{_in(*SIMD_OPS)} AND (op_type <> 'im2col' OR {_a('depthwise', 0)} = 0)"
    work = work.selectExpr("*", f"CASE WHEN {spare} THEN {divisors('_taps')} WHEN {free} THEN {divisors('_c')} END AS _deep")
    second = _first_meeting("_deep", cycles_at("_pe", "v"))
    chosen = f"CASE WHEN op_type = 'matmul' THEN _first WHEN _deep IS NOT NULL THEN {second} WHEN op_type = 'depthwise' THEN 1L ELSE {_a('SIMD')} END"
    out = work.selectExpr("*", "CAST(_pe AS BIGINT) AS PE", f"CAST({chosen} AS BIGINT) AS SIMD")
    return out.drop("_goal", "_mw", "_bits", "_taps", "_c", "_wide", "_stop", "_first", "_limit", "_tall", "_pe", "_deep")


def _match_windows(chosen: DataFrame, edges: DataFrame | None) -> DataFrame:
    """A window operator in front of a depthwise product or pool takes that operator's PE as SIMD."""
    if edges is None:
        return chosen
    users = chosen.where(F.col("op_type").isin("depthwise", "pool")).select("model_id", F.col("layer_id").alias("dst"), F.col("PE").alias("_user"))
    feeds = edges.join(users, ["model_id", "dst"]).groupBy("model_id", F.col("src").alias("layer_id")).agg(F.max("_user").alias("_user"))
    joined = chosen.join(feeds, ["model_id", "layer_id"], "left")
    take = (F.col("op_type") == "im2col") & F.col("_user").isNotNull()
    return joined.withColumn("SIMD", F.when(take, F.col("_user")).otherwise(F.col("SIMD"))).drop("_user")


def sweep(layers: DataFrame, target: int, edges: DataFrame | None = None, max_weight_bits: int = 36, two_pass: bool = True) -> DataFrame:
    """Least parallelism that brings every layer below ``target`` cycles.

    A model that misses the target is balanced again for the slowest layer's cycles.
    """
    def measured(d: DataFrame) -> DataFrame:
        return d.selectExpr("*", f"{cycles_at('PE', 'SIMD')} AS cycles").drop(*COST)

    first = measured(_match_windows(_one_sweep(layers, str(int(target)), max_weight_bits), edges))
    if not two_pass:
        return first
    first = cut_lineage(first)
    reached = first.groupBy("model_id").agg(F.greatest(F.max("cycles"), F.lit(target).cast("long")).alias("_reached"))
    again = param_join(first.drop("PE", "SIMD", "cycles"), reached, ["model_id"], spread=["layer_id"])
    return measured(_match_windows(_one_sweep(again, "_reached", max_weight_bits), edges)).drop("_reached")
