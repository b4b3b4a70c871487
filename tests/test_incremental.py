import os

import numpy as np
import pytest

from oscilla.operators import quality
from oscilla.sources import incremental, matfile, stage


def put(root, name, n, at=None):
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(matfile.encoded({"X1_DE_time": np.arange(float(n))}))
    if at:
        os.utime(path, (at, at))


@pytest.fixture
def counted():
    """A compute function that notes which files' contents it was given."""
    reads = []

    def compute(files):
        reads.append(sorted(p.rsplit("/", 1)[1] for (p,) in files.select("path").collect()))
        return matfile.inspected(matfile.decoded(files)).select("path", "n_samples_DE")

    return compute, reads


@pytest.mark.parametrize("limit", [100, 0])
def test_only_new_and_changed_files_are_read(spark, tmp_path, counted, limit):
    compute, reads = counted
    root, out = tmp_path / "raw", str(tmp_path / "out")
    for k in range(6):
        put(root, f"{k}/f{k}.mat", 10 + k, 1_000_000)
    rows = lambda: {r.path.rsplit("/", 1)[1]: r.n_samples_DE for r in incremental.updated(spark, str(root), out, compute, buckets=4, limit=limit).collect()}
    assert rows() == {f"f{k}.mat": 10 + k for k in range(6)} and len(reads.pop()) == 6
    assert rows() == {f"f{k}.mat": 10 + k for k in range(6)} and not reads
    put(root, "new.mat", 99, 2_000_000)
    assert rows() == {**{f"f{k}.mat": 10 + k for k in range(6)}, "new.mat": 99} and reads == [["new.mat"]]
    put(root, "3/f3.mat", 50, 3_000_000)
    (root / "4/f4.mat").unlink()
    assert rows() == {"f0.mat": 10, "f1.mat": 11, "f2.mat": 12, "f3.mat": 50, "f5.mat": 15, "new.mat": 99} and reads[1:] == [["f3.mat"]]
    for path in root.rglob("*.mat"):
        path.unlink()
    assert rows() == {} and len(reads) == 2


def test_a_half_done_update_leaves_the_former_state(spark, tmp_path, counted, monkeypatch):
    compute, reads = counted
    root, out = tmp_path / "raw", str(tmp_path / "out")
    put(root, "a.mat", 5, 1_000_000)
    assert incremental.updated(spark, str(root), out, compute).count() == 1
    put(root, "b.mat", 6, 2_000_000)
    write = incremental._overwritten

    def stops(df, path):
        if path.endswith("files"):
            raise RuntimeError("lost")
        write(df, path)

    monkeypatch.setattr(incremental, "_overwritten", stops)
    with pytest.raises(RuntimeError):
        incremental.updated(spark, str(root), out, compute)
    assert [r.n_samples_DE for r in incremental.current(spark, out).collect()] == [5]
    monkeypatch.setattr(incremental, "_overwritten", write)
    assert sorted(r.n_samples_DE for r in incremental.updated(spark, str(root), out, compute).collect()) == [5, 6]
    assert reads[1:] == [["b.mat"], ["b.mat"]]


def test_no_files(spark, tmp_path, counted):
    (tmp_path / "raw").mkdir()
    with pytest.raises(FileNotFoundError):
        incremental.updated(spark, str(tmp_path / "raw"), str(tmp_path / "out"), counted[0])


def test_manifest_and_features_of_files(spark, tmp_path):
    root, out = tmp_path / "raw", str(tmp_path / "out")
    put(root, "IR/007/105_0.mat", 2048, 1_000_000)
    assert stage.updated_features(spark, str(root), out).count() == 3
    put(root, "B/007/118_1.mat", 1024, 2_000_000)
    assert stage.updated_features(spark, str(root), out).count() == 4
    put(root, "0hp/Normal.mat", 120_000, 2_000_000)
    kept, whole = stage.updated_manifest(spark, str(root), out), stage.build_manifest(spark, str(root))
    assert kept.columns == whole.columns and sorted(map(str, kept.collect())) == sorted(map(str, whole.collect()))


def test_rules_are_counted_while_writing(spark, tmp_path):
    root, out = tmp_path / "raw", str(tmp_path / "checked")
    for name, n in (("0hp/Normal.mat", 120_000), ("0hp/IR_028.mat", 120_000), ("1hp/OR_007.mat", 84_000), ("misc/x.mat", 480_000)):
        put(root, name, n)
    (root / "0hp/IR_007.mat").write_bytes(b"junk")
    manifest = stage.build_manifest(spark, str(root))
    counts = stage.write_checked(manifest, out)
    written = spark.read.parquet(out)
    assert {r.code: r.n for r in counts.collect()} == {r.code: r.n for r in quality.rule_counts(quality.flagged(written.drop("warnings", "has_warning")), spark).collect()}
    assert written.count() == 5 and sum(r.n for r in counts.collect()) > 3
    bad = stage.quarantined(spark, out).collect()
    assert [r.file_path.rsplit("/", 1)[1] for r in bad] == ["IR_007.mat"] and bad[0].read_error
