import numpy as np
import pytest
from pyspark.sql import functions as F

from bitloom.operators.ranking import sample_items
from bitloom.plans import registry, runner
from bitloom.sources import generators, readers, writers
from bitloom.streaming import jobs
from bitloom.types import QuantType

DUMP = """$date today $end
$scope module top $end
$var wire 1 ! clk $end
$scope module a $end
$var wire 1 " in_TVALID $end
$var wire 8 # StreamingFIFO_0_count [7:0] $end
$upscope $end
$scope module b $end
$var wire 1 $ in_TVALID $end
$upscope $end
$upscope $end
$enddefinitions $end
#0
0"
b0 #
1$
#20
1"
b101 #
#35
x"
0$
"""


def test_trace_with_scopes(spark, tmp_path):
    (tmp_path / "a.vcd").write_text(DUMP)
    got = {(r.signal, r.t, r.val) for r in readers.read_trace(spark, str(tmp_path / "*.vcd")).collect()}
    assert got == {
        ("top.a.in_TVALID", 0, 0), ("top.a.StreamingFIFO_0_count", 0, 0), ("top.b.in_TVALID", 0, 1),
        ("top.a.in_TVALID", 20, 1), ("top.a.StreamingFIFO_0_count", 20, 5), ("top.b.in_TVALID", 35, 0),
    }


def test_arrays(spark, tmp_path):
    x = np.arange(24).reshape(2, 3, 4)
    np.save(tmp_path / "a.npy", x)
    np.savez(tmp_path / "b.npz", train=np.arange(8).reshape(2, 4), test=np.ones((1, 4)))
    rows = readers.read_npy(spark, str(tmp_path / "a.npy"), batch_rows=4).orderBy("row").collect()
    assert [r.vec for r in rows] == x.reshape(-1, 4).tolist()
    rows = readers.read_npy(spark, str(tmp_path / "b.npz"), labelled=True).orderBy("array", "row").collect()
    assert [(r.array, r.vec, r.label) for r in rows] == [("test", [1, 1, 1], 1), ("train", [0, 1, 2], 3), ("train", [4, 5, 6], 7)]


def test_xml_reports(spark, tmp_path):
    line = lambda cells: "<tablerow>" + "".join(f'<tablecell contents=" {c} "/>' for c in cells) + "</tablerow>"
    rows = [("Instance", "Module", "Total LUTs", "FFs", "DSP Blocks"), ("(top)", "top", 50, 60, 1), ("mvau_0", "m", 20, 30, 0), ("other", "x", 1, 2, 3)]
    (tmp_path / "u.xml").write_text("<r><table>" + "\n".join(map(line, rows)) + "</table></r>")
    got = {(r.instance, r.resource, r.value) for r in readers.read_xml_report(spark, str(tmp_path / "u.xml"), ["(top)", "mvau_0"]).collect()}
    assert got == {("(top)", "LUT", 50), ("(top)", "FF", 60), ("(top)", "DSP", 1), ("mvau_0", "LUT", 20), ("mvau_0", "FF", 30), ("mvau_0", "DSP", 0)}
    (tmp_path / "h.xml").write_text("<profile><AreaEstimates><Resources><LUT>7</LUT><FF>9</FF></Resources></AreaEstimates></profile>")
    assert {(r.resource, r.value) for r in readers.read_area_estimates(spark, str(tmp_path / "h.xml")).collect()} == {("LUT", 7), ("FF", 9)}


def test_hex_words_in_one_flat_file(spark, tmp_path):
    (tmp_path / "3_1_weights.dat").write_text("ff 0a\n\n1\n2 3\n")
    got = [r[:] for r in readers.read_hex_words(spark, str(tmp_path)).orderBy("pos").collect()]
    assert got == [(3, 1, 0, i, w) for i, w in enumerate([255, 10, 1, 2, 3])]


def test_hex_line_text(spark, tmp_path):
    df = spark.createDataFrame([(1, [0, 255, 16, 1], 7), (0, [1, 2, 3, 4], 3)], "row_id bigint, vec array<int>, label int")
    writers.write_hex_lines(df, str(tmp_path / "out"), 2)
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect()] == ["0201", "0403", "ff03", "FF00", "0110", "ff07"]


def test_weight_words(spark):
    w = spark.createDataFrame([(i, 0, v) for i, v in enumerate([1, -1, 0, -2])], "in_idx int, out_idx int, w int")
    assert writers.weight_lines(w, 4, 4).first().word == "e0f1"


def test_labelled_files_and_sampling(spark, tmp_path):
    for folder in ("n02", "n01", "n03"):
        (tmp_path / folder).mkdir()
        for i in range(3):
            (tmp_path / folder / f"f{i}.bin").write_bytes(b"x" * (i + 1))
    files = readers.read_labelled_files(spark, str(tmp_path)).select("label", "folder", "name", "length")
    assert [r.folder for r in files.orderBy("label", "name").collect()] == ["n01"] * 3 + ["n02"] * 3 + ["n03"] * 3
    assert [(r.label, r.name) for r in sample_items(files, 4, True).collect()] == [(0, "f0.bin"), (1, "f0.bin"), (2, "f0.bin"), (0, "f1.bin")]
    assert [(r.label, r.name) for r in sample_items(files, 4, False).collect()] == [(0, "f0.bin"), (0, "f1.bin"), (0, "f2.bin"), (1, "f0.bin")]


@pytest.mark.parametrize("listed", [readers.LISTED_FILES, 2])
def test_only_sampled_files_are_opened(spark, tmp_path, monkeypatch, listed):
    monkeypatch.setattr(readers, "LISTED_FILES", listed)
    for folder in ("k=[b]", "k=a*"):
        (tmp_path / folder).mkdir()
        for i in range(3):
            (tmp_path / folder / f"f{{{i}}}.bin").write_bytes(f"{folder}{i}".encode())
    got = readers.sample_labelled_files(spark, str(tmp_path), 3, True)
    assert {(r.label, r.folder, r.name, bytes(r.content).decode()) for r in got.collect()} == {(0, "k=[b]", "f{0}.bin", "k=[b]0"), (1, "k=a*", "f{0}.bin", "k=a*0"), (0, "k=[b]", "f{1}.bin", "k=[b]1")}
    assert len(got.inputFiles()) == (3 if listed > 2 else 6)
    assert readers.sample_labelled_files(spark, str(tmp_path), 0, False).count() == 0


def test_generators_do_not_depend_on_partitions(spark):
    q = QuantType.parse("INT4")
    a = generators.gen_typed(spark, q, 50, 6, 3)
    assert sorted(map(str, a.collect())) == sorted(map(str, a.repartition(7).collect()))
    layers = generators.gen_layers(spark, [4, 3, 2], "m")
    assert layers.count() == 18 and layers.where("w NOT BETWEEN -1 AND 1").count() == 0
    t = generators.gen_thresholds(layers.select("layer_id").distinct(), ["layer_id"], QuantType.parse("INT8"), 7)
    assert t.count() == 14


def test_steps_resume_and_stop_at_failure(spark, tmp_path):
    @registry.register_operator("double_x")
    def double_x(df):
        return df.withColumn("x", F.col("x") * 2)

    def boom(df):
        raise ValueError("no")

    df = spark.range(3).select(F.col("id").alias("x"))
    out, times = runner.run_steps(df, ["double_x", double_x], str(tmp_path / "a"))
    assert sorted(r.x for r in out.collect()) == [0, 4, 8] and [t[2] for t in times] == ["SUCCESS"] * 2
    seen = []
    with pytest.raises(runner.StepFailed) as failure:
        runner.run_steps(df, ["double_x", boom, double_x], str(tmp_path / "b"), hooks={"double_x": lambda d: seen.append(d.count())})
    assert [t[2] for t in failure.value.timings] == ["SUCCESS", "FAIL"] and seen == [3]
    assert runner.step_times(spark, failure.value.timings).count() == 2
    assert "multi_threshold" in registry.operator_names()
    with pytest.raises(KeyError):
        registry.get_operator("nothing")


def test_late_rows_are_counted(spark, tmp_path):
    src = tmp_path / "src"
    for day in ("2024-01-05", "2024-01-20", "2024-01-01"):
        spark.createDataFrame([(day + " 01:00:00",)], "ts string").select(F.col("ts").cast("timestamp").alias("ts")).coalesce(1).write.mode("append").parquet(str(src))
    stream = spark.readStream.schema("ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(src))
    q = jobs.keep_latest(jobs.throughput_windows(stream, "ts", "1 day", late="1 day"), str(tmp_path / "out"), str(tmp_path / "state"), ("start_us",))
    q.awaitTermination()
    kept = jobs.read_latest(spark, str(tmp_path / "out"), ("start_us",)).agg(F.sum("n_items")).first()[0]
    assert kept + jobs.dropped_rows(q) == 3 and jobs.dropped_rows(q) >= 1
    late = jobs.late_rows(spark.read.parquet(str(src)), jobs.read_latest(spark, str(tmp_path / "out"), ("start_us",)), "ts", "1 day")
    assert late.agg(F.sum("n_late")).first()[0] == jobs.dropped_rows(q)
