"""Operators against numpy, algebraic properties, and edge inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from bitloom.functions import scalars as S
from bitloom.functions import vocab
from bitloom.operators import elementwise as E
from bitloom.operators import evaluation as M
from bitloom.operators import features as X
from bitloom.operators import integrity as I
from bitloom.operators import inventory as C
from bitloom.operators import matmul as MM
from bitloom.operators import parameters as P
from bitloom.operators import ranking as R
from bitloom.operators import spatial as N
from bitloom.operators import telemetry as V
from bitloom.operators import thresholds as TH
from bitloom.plans.catalog import QUERIES
from bitloom.plans.catalog.products import MLP_COLUMNS, mlp_layers
from bitloom.types import QuantType


def cells_of(spark, images):
    rows = [(r, h, w, c, int(v)) for r, image in enumerate(images) for (h, w, c), v in np.ndenumerate(image)]
    return spark.createDataFrame(rows, "row_id bigint, h int, w int, c int, val bigint")


def conv(image, kernel, stride, pads):
    padded = np.pad(image, ((pads[0], pads[2]), (pads[1], pads[3]), (0, 0)))
    k = kernel.shape[0]
    oh, ow = ((padded.shape[a] - k) // stride + 1 for a in (0, 1))
    out = np.zeros((oh, ow, kernel.shape[3]), dtype=np.int64)
    for y in range(oh):
        for x in range(ow):
            window = padded[y * stride : y * stride + k, x * stride : x * stride + k]
            out[y, x] = np.tensordot(window, kernel, 3)
    return out


def taps_of(spark, kernel):
    return spark.createDataFrame([(*map(int, at), int(v)) for at, v in np.ndenumerate(kernel)], "kh int, kw int, c int, out_idx int, w int")


def to_array(rows, shape, keys):
    out = np.full(shape, 10**9, dtype=np.int64)
    for r in rows:
        out[tuple(r[k] for k in keys)] = r["val"]
    return out


@pytest.mark.parametrize("stride,pads", [(1, (0, 0, 0, 0)), (2, (1, 1, 2, 2)), (1, (7, 0, 8, 0))])
def test_convolution(spark, stride, pads):
    rng = np.random.default_rng(1)
    images, kernel = rng.integers(-8, 8, (2, 5, 5, 2)), rng.integers(-2, 3, (3, 3, 2, 3))
    got = N.conv2d(cells_of(spark, images), taps_of(spark, kernel), (5, 5), (3, 3), (stride, stride), pads=pads).collect()
    for r in range(2):
        want = conv(images[r], kernel, stride, pads)
        assert (to_array([g for g in got if g.row_id == r], want.shape, ("oh", "ow", "out_idx")) == want).all()


def test_transposed_convolution_with_gaps(spark):
    rng = np.random.default_rng(2)
    images, kernel, s = rng.integers(-8, 8, (1, 3, 3, 1)), rng.integers(-2, 3, (2, 2, 1, 2)), 3
    want = np.zeros(((3 - 1) * s + 2, (3 - 1) * s + 2, 2), dtype=np.int64)
    for y in range(3):
        for x in range(3):
            want[y * s : y * s + 2, x * s : x * s + 2] += images[0, y, x, 0] * kernel[:, :, 0]
    turned = N.mirrored(taps_of(spark, kernel), (2, 2))
    got = N.deconv2d(cells_of(spark, images), turned, (3, 3), (2, 2), (s, s), 0).collect()
    assert (to_array(got, want.shape, ("oh", "ow", "out_idx")) == want).all()
    with pytest.raises(ValueError):
        N.deconv2d(cells_of(spark, images), turned, (3, 3), (2, 2), (s, s), 0, groups=2)


@pytest.mark.parametrize("shape,k,s,d", [((8, 8), (3, 3), (2, 1), (1, 2)), ((1, 21), (1, 5), (1, 1), (1, 2))])
def test_window_positions(spark, shape, k, s, d):
    image = np.arange(shape[0] * shape[1]).reshape(1, *shape, 1)
    got = {(r.oh, r.ow, r.kh, r.kw): r.val for r in N.im2col(cells_of(spark, image), shape, k, s, d).collect()}
    n = [N.window_count(shape[a], k[a], s[a], d[a]) for a in (0, 1)]
    want = {
        (y, x, i, j): image[0, y * s[0] + i * d[0], x * s[1] + j * d[1], 0]
        for y in range(n[0]) for x in range(n[1]) for i in range(k[0]) for j in range(k[1])
    }
    assert got == want


def test_flow_scoring_against_numpy(spark):
    sf = "/root/testdata/sf0.001"
    li = spark.read.parquet(f"{sf}/lineitem.parquet").withColumn("label", F.when(F.col("l_linestatus") == "O", 1).otherwise(-1))
    bits, width = X.feature_job(li, MLP_COLUMNS, keep=["label"], as_text=True)
    rows = bits.collect()
    x = np.zeros((len(rows), 600))
    x[:, :width] = [[int(b) for b in r.bits] for r in rows]
    x = x * 2 - 1
    for w, t, scale, bias in mlp_layers():
        acc = x @ w
        x = (acc[:, :, None] >= np.sort(t, axis=1)[None]).sum(-1) * scale + bias
    label = np.array([r.label for r in rows])
    for r in QUERIES["mlp_flow_scoring"](spark, sf).collect():
        assert r.ok == int((x[label == r.label, 0] == r.label).sum()) and r.ok + r.nok == int((label == r.label).sum())


def test_chain_handles_many_steps_and_large_values(spark):
    df = spark.createDataFrame([(0, [5, -7]), (1, [30000, 2])], "row_id bigint, vec array<int>")
    w = np.array([[40000.0], [3.0]])
    t = np.arange(0, 100, dtype=float).reshape(1, 100)
    assert [r.vec for r in MM.dense_layers(df, [(w, None, 1, 0)]).orderBy("row_id").collect()] == [[5 * 40000 - 21], [30000 * 40000 + 6]]
    small = spark.createDataFrame([(i, [v]) for i, v in enumerate([-1, 0, 50, 99, 500])], "row_id bigint, vec array<int>")
    assert [r.vec[0] for r in MM.dense_layers(small, [(np.eye(1), t, 1, 0)]).orderBy("row_id").collect()] == [0, 1, 51, 100, 100]


def test_threshold_edges(spark):
    t = spark.createDataFrame([(0, 0, 1.0), (0, 1, 3.0)], "c int, step int, t double")
    cells = spark.createDataFrame([(0, 0, 1), (1, 0, 3), (2, 0, 0), (3, 0, None), (4, 1, 9)], "row_id bigint, c int, val bigint")
    got = {r.row_id: r.val for r in TH.multi_threshold(cells, t).collect()}
    assert got == {0: 1, 1: 2, 2: 0, 3: None, 4: 0}
    assert TH.multi_threshold(cells.where("false"), t).count() == 0


def test_absorbed_affine_keeps_threshold_output(spark):
    cells = spark.range(200).selectExpr("id AS row_id", "CAST(id % 4 AS INT) AS channel", "CAST(id * 13 % 61 - 30 AS DOUBLE) AS val")
    base = spark.range(4 * 7).selectExpr("'m' AS model_id", "0 AS layer_id", "CAST(id DIV 7 AS INT) channel", "CAST(id % 7 AS INT) step", "CAST(-20 + 6 * (id % 7) + id DIV 7 AS DOUBLE) t")
    adds = spark.range(4).selectExpr("'m' AS model_id", "0 AS layer_id", "CAST(id AS INT) channel", "id * 0.5D - 1 AS val")
    muls = spark.range(4).selectExpr("'m' AS model_id", "0 AS layer_id", "CAST(id AS INT) channel", "0.25D * (id + 1) AS val")

    def run(c, t):
        out = TH.multi_threshold(c, t.select(F.col("channel").alias("c"), "step", "t"), channel="channel")
        return {r.row_id: r.val for r in out.collect()}

    affine = cells.join(muls.selectExpr("channel", "val AS m"), "channel").join(adds.selectExpr("channel", "val AS a"), "channel")
    moved = affine.select("row_id", "channel", (F.col("val") * F.col("m") + F.col("a")).alias("val"))
    assert run(moved, base) == run(cells, P.absorb_mul(P.absorb_add(base, adds), muls))
    rounded = P.round_thresholds(P.absorb_add(base, adds), spark.createDataFrame([("m", 0, -31, 31)], "model_id string, layer_id int, type_min int, type_max int"))
    assert run(cells, P.absorb_add(base, adds)) == run(cells, rounded)
    negative = muls.withColumn("val", F.when(F.col("channel") == 2, -1.0).otherwise(F.col("val")))
    assert run(cells, base) == run(cells, P.absorb_mul(base, negative))


def test_identity_thresholds_round_like_the_quantizer(spark):
    spec = spark.createDataFrame([("m", 0, "identity", 4, False, 0, 0.3), ("m", 1, "identity", 4, True, 0, 0.3)], "model_id string, layer_id int, kind string, bits int, narrow boolean, channel int, scale double")
    t = P.derive_thresholds(spec).collect()
    bias = {r.layer_id: r.bias for r in P.act_bias_scale(spec).collect()}
    for layer, low in ((0, -8), (1, -7)):
        steps = np.array(sorted(r.t for r in t if r.layer_id == layer))
        assert len(steps) == 7 - low
        for x in np.linspace(-4, 4, 97) + 0.001:
            assert bias[layer] + (steps <= x).sum() == np.clip(np.floor(x / 0.3 + 0.5), low, 7)


def test_top_k_ties(spark):
    df = spark.createDataFrame([([3, 9, 9, 1],)], "v array<int>")
    low, high = df.select(R.label_select(F.col("v"), 3), R.topk_argsort(F.col("v"), 3)).first()
    assert (low, high) == ([1, 2, 0], [2, 1, 0])
    scaled = df.select(R.label_select(F.transform("v", lambda x: x * 5 + 2), 3)).first()[0]
    assert scaled == low


def test_rounding_kinds(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (2.3,), (2.45,), (2.5,)], "x double")
    assert [r[0] for r in df.select(S.half_up(F.col("x"))).collect()] == [1, 2, 2, 2, 3]
    assert [r[0] for r in df.select(S.half_even(F.col("x"))).collect()] == [0, 2, 2, 2, 2]
    assert df.select(S.quantize_u32(F.lit(5e9)), S.quantize_u32(F.lit(-3.0)), S.quantize_u32(F.lit(None).cast("double"))).first()[:] == (4294967295, 0, None)


def test_bits_needed_at_powers(spark):
    df = spark.createDataFrame([(b, 2.0**b - 1) for b in range(0, 50)] + [(b + 1, 2.0**b) for b in range(0, 50)], "b int, x double")
    assert df.where(S.bits_needed(F.col("x")) != F.col("b")).count() == 0
    assert all(X._width(None, 2.0**b - 1) == b for b in range(50))


def test_fixed_vocabularies(spark):
    assert (len(vocab.PROTO), len(vocab.SERVICE), len(vocab.STATE), len(vocab.RATE_OVERRIDES)) == (133, 13, 11, 14)
    df = spark.createDataFrame([("tcp", "FIN", 1), ("zero", "CLO", 2)], "proto string, state string, n int")
    hot = X.one_hot(X.one_hot(df, "state", vocab.STATE), "proto", vocab.PROTO)
    assert hot.columns[:2] == ["tcp", "udp"] and hot.columns[-2:] == ["CLO", "n"] and len(hot.columns) == 133 + 11 + 1
    with pytest.raises(Exception, match="unknown"):
        X.one_hot(df, "proto", ["tcp"]).collect()


def test_row_overrides(spark):
    o = spark.createDataFrame(list(vocab.RATE_OVERRIDES.items()), "row_id bigint, value bigint")
    df = spark.range(2000).selectExpr("id AS row_id", "7L AS rate")
    got = X.apply_overrides(df, "row_id", "rate", o)
    assert got.where("row_id = 715").first().rate == 34716 and got.where("rate <> 7").count() == 1


def test_streams_must_match(spark):
    a = spark.createDataFrame([(1, [1, 2]), (2, [3, 4])], "row_id bigint, vec array<int>")
    for b in (a.where("row_id = 1"), a.withColumn("vec", F.slice("vec", 1, 1))):
        with pytest.raises(Exception, match="without a partner"):
            E.add_streams(a, b).collect()
    with pytest.raises(ValueError):
        E.eltwise(a, a, "max")
    with pytest.raises(Exception, match="missing"):
        E.concat_streams([a, a.where("row_id = 2")]).collect()


def checksum(words, k, bits):
    """A plain walk over one frame."""
    w, total = bits // k, 0
    for i, word in enumerate(words):
        for j in range(k):
            v, folded = (word % (1 << 64)) >> (j * w) & ((1 << w) - 1), 0
            while v:
                folded ^= v & ((1 << 23) - 1)
                v >>= 23
            total += ((i * k + j) % 3 + 1) * folded
    return total % (1 << 24)


@pytest.mark.parametrize("k,bits", [(1, 64), (2, 64), (4, 32), (3, 60)])
def test_checksum(spark, k, bits):
    rng = np.random.default_rng(5)
    low = -(2**63) if bits == 64 else 0
    words = [int(v) for v in rng.integers(low, 2 ** min(bits, 63) - 1, 25)]
    df = spark.createDataFrame([("s", i, w) for i, w in enumerate(words)], "stream_id string, seq bigint, word bigint")
    got = {r.frame: r.checksum for r in I.frame_checksum(df, 7, k, bits).collect()}
    assert got == {f: f * (1 << 24) + checksum(words[f * 7 : f * 7 + 7], k, bits) for f in range(3)}


def test_golden_compare_edges(spark):
    e = spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0), (1, 0, 5.0), (2, 0, None)], "row_id bigint, i int, val double")
    g = spark.createDataFrame([(0, 0, 1.0005), (0, 1, 2.0), (1, 0, 5.5), (2, 0, 1.0), (3, 0, 1.0)], "row_id bigint, i int, val double")
    assert {r.row_id: r.status for r in M.compare(e, g).collect()} == {0: "SUCCESS", 1: "FAIL", 2: "FAIL", 3: "FAIL"}


def test_golden_compare_of_rows(spark):
    e = spark.createDataFrame([(0, [1.0, 2.0]), (1, [5.0]), (2, [None]), (4, []), (5, [1.0, 2.0])], "row_id bigint, vec array<double>")
    g = spark.createDataFrame([(0, [1.0005, 2.0]), (1, [5.5]), (2, [1.0]), (3, [1.0]), (4, []), (5, [1.0])], "row_id bigint, vec array<double>")
    got = {r.row_id: (r.n_cells, r.n_bad, r.status) for r in M.compare_rows(e, g).collect()}
    assert got == {0: (2, 0, "SUCCESS"), 1: (1, 1, "FAIL"), 2: (1, 1, "FAIL"), 3: (1, 1, "FAIL"), 4: (0, 0, "SUCCESS"), 5: (2, 1, "FAIL")}


def test_interface_states(spark):
    ev = spark.createDataFrame([("a", "V", 0, 1), ("a", "R", 40, 1), ("a", "V", 100, 0), ("a", "R", 119, 0)], "iface string, kind string, t bigint, val int")
    got = {(r.v, r.r): r.n for r in V.interface_stats(ev, end_time=200, block_bits=4).collect()}
    assert got == {(0, 0): 4, (1, 0): 2, (0, 1): 0, (1, 1): 3}


def test_buffer_depth_against_scan(spark):
    rng, period = np.random.default_rng(8), 24
    tx = {e: (rng.random(period) < 0.4, rng.random(period) < p) for e, p in ((0, 0.2), (1, 0.4), (2, 0.9))}
    for part in tx.values():
        part[0][3] = part[1][2] = True
    flows, moves = [], []
    for side in (0, 1):
        rows = [(e, int(t)) for e, p in tx.items() for t in np.flatnonzero(p[side])]
        moves.append(spark.createDataFrame(rows, "edge_id int, cycle int"))
        flows.append(V.cumulative_flow(spark.createDataFrame(rows, "stream_id int, cycle int"), period, block_bits=3).withColumnRenamed("stream_id", "edge_id"))
    got = {r.edge_id: (r.shift, r.depth) for r in V.buffer_depth(*flows, period).collect()}
    assert got == {r.edge_id: (r.shift, r.depth) for r in V.transfer_depth(*moves, period, block_bits=2).collect()}
    for e, (p, c) in tx.items():
        prod, cons = (np.cumsum(np.tile(x, 2)) for x in (p, c))
        shift = next((s for s in range(period) if (prod[s:period] >= cons[: period - s]).all()), period - 1)
        assert got[e] == (shift, (prod[shift : shift + period] - cons[:period]).max())


def test_sweep_meets_target(spark):
    attrs = "map('MW', '128', 'MH', '128', 'weight_bits', '2')"
    layers = spark.range(5).selectExpr("'m' AS model_id", "CAST(id AS INT) AS layer_id", "'matmul' AS op_type", f"{attrs} AS attrs")
    for target in (100, 3000, 20000):
        rows = C.sweep(layers, target).collect()
        assert all(r.cycles == 128 // r.PE * (128 // r.SIMD) for r in rows)
        assert all(r.cycles < target for r in rows)


def test_cycle_formulas(spark):
    def cost(op, **a):
        pairs = ", ".join(f"'{k}', '{v}'" for k, v in a.items())
        return C.cycles(spark.range(1).selectExpr("'m' AS model_id", "0 AS layer_id", f"'{op}' AS op_type", f"map({pairs}) AS attrs")).first().cycles

    assert cost("matmul", MW=600, MH=64) == 38400
    assert cost("im2col", C=4, W=8, H=8, kh=3, kw=3, OH=6, OW=6) == 8 * 3 * 4 + 6 * 6 * 9 * 4
    assert cost("im2col", is1d=1, C=4, W=21, kw=5, OW=17) == 1 + 17 * 5 * 4
    assert cost("im2col", is1d=1, depthwise=1, C=4, W=21, kw=5, OW=17) == 1 + 17 * 5 * 4 + 4 * 4 - 4
    assert cost("im2col", is1d=1, depthwise=1, C=4, W=21, kw=5, OW=6, sw=3) == 21 * 4 + 6 * 5 * 4
    assert cost("im2col", is1d=1, parallel_window=1, C=4, W=21, kw=5, OW=17) == 22
    assert cost("maxpool", W=4, kw=2) == 20
    assert cost("topk", labels=10) == 10


def test_accumulator_of_zero_weights(spark):
    w = spark.range(8).selectExpr("'m' AS model_id", "0 AS layer_id", "CAST(id AS INT) AS in_idx", "0 AS out_idx", "0 AS w")
    t = spark.createDataFrame([("m", 0, 0, 15, -8, 7, False, False)], "model_id string, layer_id int, x_min int, x_max int, w_min int, w_max int, runtime boolean, last boolean")
    r = P.min_accumulator(w, t).first()
    assert (r.acc_min, r.acc_max, r.width, r.signed) == (0, 0, 1, False)


def test_type_check_and_smallest(spark):
    df = spark.createDataFrame([(1.0,), (2.5,), (None,)], "x double")
    assert E.check_type(df, ["x"], QuantType.parse("UINT2")).first()[1:] == (2, 1)
    for low, high, name in ((0, 1, "BINARY"), (0, 2, "UINT2"), (-1, 0, "INT1"), (-3, 4, "INT4"), (0, 255, "UINT8"), (-128, 127, "INT8")):
        df = spark.createDataFrame([(low,), (high,)], "x bigint")
        assert E.smallest_type(df, ["x"]).first().type == name


def test_compare_reshaped(spark):
    golden = spark.createDataFrame([(r, i // 3, i % 3, float(i)) for r in range(4) for i in range(6)], "row_id int, h int, w int, val double")
    rows = [(0, i, float(i)) for i in range(6)] + [(1, i, float(i + (i == 4))) for i in range(6)] + [(2, i, float(i)) for i in range(5)] + [(3, i, float(i)) for i in range(7)]
    got = spark.createDataFrame(rows, "row_id int, i int, val double")
    out = {r.row_id: (r.n_cells, r.n_bad, r.status) for r in M.compare_reshaped(golden, got, {"h": 2, "w": 3}, {"i": 6}).collect()}
    assert out == {0: (6, 0, "SUCCESS"), 1: (6, 1, "FAIL"), 2: (6, 1, "FAIL"), 3: (7, 1, "FAIL")}
    with pytest.raises(ValueError):
        M.compare_reshaped(golden, got, {"h": 2, "w": 3}, {"i": 7})
