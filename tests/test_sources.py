import numpy as np
import pytest
from pyspark.sql import functions as F

from oscilla.operators import layouts, quality
from oscilla.sources import matfile, stage, synthetic
from oscilla.streaming import features as streaming


def files(tmp_path, **named):
    for name, data in named.items():
        (tmp_path / f"{name}.mat").write_bytes(data)
    return str(tmp_path)


def test_mat_round_trip(spark, tmp_path):
    x = np.arange(50.0)
    root = files(
        tmp_path,
        two=matfile.encoded({"X1_DE_time": x, "X2_DE_time": x + 1, "X1_FE_time": x[:10], "X1RPM": np.array([[1797]])}),
        plain=matfile.encoded({"x3_de_time": x[:5]}, compressed=False),
        cut=matfile.encoded({"X1_DE_time": x}, compressed=False)[:-40],
        junk=b"nothing",
    )
    rows = matfile.recordings(spark, root)
    de = {r.path.rsplit("/", 1)[1]: r.signal for r in matfile.channel_of(rows, "_DE_time").collect()}
    assert de == {"two.mat": x.tolist()}
    assert matfile.channel_of(rows, "DE_time", "any_case").count() == 2
    seen = {r.path.rsplit("/", 1)[1]: r for r in matfile.inspected(rows).collect()}
    assert (seen["two.mat"].n_samples_DE, seen["two.mat"].n_samples_FE, seen["two.mat"].n_samples_BA, seen["two.mat"].rpm_from_file) == (50, 10, None, 1797)
    assert seen["cut.mat"].read_error and seen["junk.mat"].read_error and seen["plain.mat"].read_error is None
    matfile.register(spark)
    assert sorted(map(str, spark.read.format("matfile").load(root).collect())) == sorted(map(str, rows.withColumn("path", F.regexp_replace("path", "^file:", "")).collect()))
    assert spark.read.format("matfile").option("channel", "RPM").load(root).filter("var is not null").count() == 1
    with pytest.raises(FileNotFoundError):
        (tmp_path / "empty").mkdir()
        matfile.recordings(spark, str(tmp_path / "empty"))


def level4(name, values, number="d", order="<"):
    import struct

    kinds = {"d": (0, "f8"), "f": (1, "f4"), "h": (3, "i2"), "B": (5, "u1")}
    digit, dtype = kinds[number]
    values = np.atleast_2d(np.asarray(values))
    head = struct.pack(order + "iiiii", (0 if order == "<" else 1000) + digit * 10, *values.shape, 0, len(name) + 1)
    return head + name.encode() + b"\0" + values.astype(np.dtype(dtype).newbyteorder(order)).tobytes("F")


def test_level_4_files(spark, tmp_path):
    x = np.arange(40.0)
    whole = level4("X1_DE_time", x[:, None]) + level4("X1RPM", [[1772]], "h", ">") + level4("grid", [[1, 2, 3], [4, 5, 6]], "B") + level4("text", [[65]], "B")[:0]
    root = files(tmp_path, little=whole, big=level4("X2_DE_time", x, "f", ">"), cut=whole[:-3], odd=b"\x00\xff\xff\x7f" + bytes(40))
    rows = {}
    for r in matfile.recordings(spark, root).collect():
        rows.setdefault(r.path.rsplit("/", 1)[1], []).append((r.var, r.data, r.read_error))
    assert rows["little.mat"] == [("X1_DE_time", x.tolist(), None), ("X1RPM", [1772.0], None), ("grid", [1.0, 4.0, 2.0, 5.0, 3.0, 6.0], None)]
    assert rows["big.mat"] == [("X2_DE_time", x.tolist(), None)]
    assert rows["cut.mat"][0][2] == "truncated content" and rows["odd.mat"][0][2]
    seen = {r.path.rsplit("/", 1)[1]: (r.n_samples_DE, r.rpm_from_file) for r in matfile.inspected(matfile.recordings(spark, root)).collect()}
    assert seen["little.mat"] == (40, 1772.0)


def test_files_are_written_by_whole_jobs(spark, tmp_path):
    root = tmp_path / "out"
    root.mkdir()
    rows = [(f"{k % 3}/f{k}.mat", [("a_DE_time", [float(k)] * k), ("RPM", [1700.0 + k])]) for k in range(9)]
    df = spark.createDataFrame(rows, matfile.WRITTEN).repartition(3)
    assert matfile.write(df, f"file://{root}") == 9
    back = lambda: sorted((r.path.split("/out/")[1], r.var, r.data) for r in spark.read.format("matfile").load(f"file://{root}").collect())
    want = sorted((p, v, d) for p, vs in rows for v, d in vs)
    assert back() == want and sorted(p.name for p in root.iterdir()) == ["0", "1", "2"]
    # a task fails after others have written: nothing of the job stays
    bad = df.select(F.when(F.col("path") == "1/f4.mat", "../f4.mat").otherwise(F.concat(F.lit("x/"), "path")).alias("path"), "variables")
    with pytest.raises(Exception, match="not a path below"):
        matfile.write(bad, str(root))
    assert back() == want and sorted(p.name for p in root.iterdir()) == ["0", "1", "2"]
    assert matfile.write(df.filter("path = '0/f3.mat'"), str(root), "overwrite") == 1
    assert back() == [x for x in want if x[0] == "0/f3.mat"]


def test_synthetic_manifest(spark, tmp_path):
    assert synthetic.plan(spark).count() == 40
    m = stage.get_manifest(spark, str(tmp_path), seconds=10.0)
    assert m.count() == 40 and m.filter("has_warning").count() == 0 and m.filter("label = 'OR' and or_position = 'Centered'").count() == 12
    again = stage.get_manifest(spark, str(tmp_path))
    assert again.count() == 40
    with pytest.raises(FileNotFoundError):
        stage.get_manifest(spark, str(tmp_path), root=str(tmp_path / "missing"))


def test_planted_defects_are_found(spark, tmp_path):
    expected = synthetic.write_edge_cases(str(tmp_path / "edge"))
    checked = quality.flagged(stage.build_manifest(spark, str(tmp_path / "edge")).drop("warnings", "has_warning"))
    found = quality.expected_codes_found(checked, expected)
    assert {r.code: r.found for r in found.collect()} == {c: True for *_, c in synthetic.EDGE_CASES}
    one = {r.file_path.split("/edge/")[1]: r.warnings for r in checked.collect()}
    assert one == {p: c for p, _, _, c in synthetic.EDGE_CASES}


def test_expressions_and_numpy_make_the_same_signal(spark):
    got = [r.x for r in synthetic.signal_rows(spark, 12_000, 0.2, 1772, 105.87, noise=0.0).orderBy("i").collect()]
    assert np.allclose(got, synthetic.signal(12_000, 0.2, 1772, 105.87, 0.0, 0), atol=1e-9)


def test_layout_examples(spark):
    a = spark.createDataFrame([("0hp/Normal.mat",), ("1 HP/ir_014.mat",), ("2hp/OR_007_Centered.mat",), ("2hp/B_x.mat",), ("misc/118_0.mat",)], "p string")
    got = [tuple(r) for r in a.select(*layouts.by_load_folder("p").values()).collect()]
    assert got == [(0, "Normal", None, None), (1, "IR", 14, None), (2, "OR", 7, "Centered"), (2, "B", None, None), (None, None, 0, None)]
    b = spark.createDataFrame([("data/raw/x/IR/007/105_0.mat",), ("data/raw/Normal/98.mat",), ("data/raw/x/OR/007/@6/130@6_0.mat",), ("data/raw/x/IR/007/105.mat",)], "path string")
    assert [tuple(r)[1:] for r in layouts.resolved(b).collect()] == [(1, 0), (0, 1), (2, 0)]
    c = spark.createDataFrame([("12k/B/007/118_0.mat",), ("12k/OR/007/@12/156_0.mat",), ("Normal/97_Normal_0.mat",), ("12k/B/007/118_12.mat",), ("x.mat",)], "p string")
    p = layouts.by_type_folders("p")
    got = [tuple(r) for r in c.select(*p.values(), layouts.class_label(p["fault_type"], p["fault_size"], p["position"])).collect()]
    assert got[:3] == [("B", "007", "None", 0, "B_007"), ("OR", "007", "@12", 0, "OR_007_@12"), ("Normal", "None", "None", 0, "Normal")]
    assert got[3][3] is None and got[4][:2] == (None, None)


def test_csv_with_mark_and_stage(spark, tmp_path):
    df = spark.createDataFrame([("a", "007", None), ("b", "None", 2.0)], "name string, size string, rpm double")
    stage.write_csv(df, str(tmp_path / "c"), bom=True)
    assert sorted(map(tuple, stage.read_csv(spark, str(tmp_path / "c"), "name string, size string, rpm double").collect())) == [("a", "007", None), ("b", "None", 2.0)]
    calls = []
    build = lambda: calls.append(1) or df
    for force in (False, False, True):
        assert stage.stage_table(spark, str(tmp_path / "t"), build, force).count() == 2
    assert len(calls) == 2
    assert stage.write_features(df.filter("false"), str(tmp_path / "f")) is False
    assert stage.write_features(df.withColumn("demod", F.lit("hilbert")), str(tmp_path / "f")) is True


def test_enriched_and_repeated(spark, tmp_path):
    x = np.sin(np.arange(300.0))
    root = files(tmp_path, one=matfile.encoded({"X1_DE_time": x, "X1RPM": np.array([[1772]])}), two=matfile.encoded({"X1_DE_time": x}), none=matfile.encoded({"X1_FE_time": x}))
    rows = matfile.recordings(spark, root)
    got = {r.path.rsplit("/", 1)[1]: r for r in matfile.enriched(rows.select("path").distinct(), rows).collect()}
    assert got["one.mat"].rpm == 1772 and got["two.mat"].rpm is None and got["none.mat"].rms is None
    assert got["one.mat"].rms == pytest.approx((x * x).mean() ** 0.5) and got["one.mat"].n_samples == 300
    assert quality.repeated_content(matfile.channel_of(rows, "_DE_time"), "path", "signal").count() == 1


def test_feature_stream(spark, tmp_path):
    x = np.random.default_rng(5).standard_normal(2048).tolist()
    for k in range(2):
        spark.createDataFrame([(f"{k}.mat", k, k, x)], streaming.RECORDINGS).write.mode("append").parquet(str(tmp_path / "in"))
    stream = streaming.feature_stream(streaming.arriving(spark, str(tmp_path / "in"), 1))
    streaming.write(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 6


def test_typed_and_resolved_files_and_their_features(spark, tmp_path):
    x = np.random.default_rng(8).standard_normal(2048)
    for path in ("IR/007/105_0.mat", "OR/007/@6/130@6_1.mat", "Normal/97_Normal_0.mat", "junk/1.mat"):
        target = tmp_path / "raw" / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(b"junk" if "130" in path else matfile.encoded({"X1_DE_time": x}))
    root = str(tmp_path / "raw")
    typed = {r.filename: (r.class_label, r.position, r.load_hp) for r in stage.typed_manifest(spark, root).collect()}
    assert typed == {"105_0.mat": ("IR_007", "None", 0), "130@6_1.mat": ("OR_007_@6", "@6", 1), "97_Normal_0.mat": ("Normal", "None", 0), "1.mat": (typed["1.mat"][0], "None", None)}
    files = stage.resolved_files(spark, root)
    assert sorted((r.Label, r.Load) for r in files.collect()) == [(0, 0), (1, 0), (2, 1)]
    for demod in ("hilbert", "none"):
        table = stage.feature_stage(spark, files, root, str(tmp_path / "out"), demod)
        assert table.count() == 6 and table.filter("Label = 2").count() == 0
    assert table.agg(F.max("Env_Amp_BPFI")).first()[0] == 0
