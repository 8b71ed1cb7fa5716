import numpy as np
import pytest

from hyperpanel.operators import hsne
from hyperpanel.sources import binary, files, text_formats


def _points(spark, n, dims):
    return spark.createDataFrame([(k, [float(k * dims + d) for d in range(dims)]) for k in range(n)], "id long, features array<double>")


def test_ranges_smaller_than_a_file(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "STEP", 100)
    p, path = _points(spark, 57, 3), str(tmp_path / "m")
    binary.write_matrix(p, path)
    assert sorted(binary.read_matrix(spark, path, 57, 3).collect()) == sorted(p.collect())
    files.join_parts(path, str(tmp_path / "one"))
    assert (tmp_path / "one").read_bytes() == binary.matrix_bytes(p) == np.arange(171, dtype="<f4").tobytes()
    with pytest.raises(ValueError, match="bytes"):
        binary.read_matrix(spark, path, 56, 3)


def test_empty_tables(spark, tmp_path):
    binary.write_matrix(spark.createDataFrame([], "id long, features array<double>"), str(tmp_path / "m"))
    assert binary.read_matrix(spark, str(tmp_path / "m"), 0, 3).count() == 0
    binary.write_sparse(spark.createDataFrame([], "i long, j long, w double"), 2, str(tmp_path / "s"))
    assert (tmp_path / "s").read_bytes() == np.array([2, 0, 0], "<u4").tobytes()
    assert binary.read_sparse(spark, str(tmp_path / "s")).count() == 0


def test_sparse_file_has_rows_without_entries(spark, tmp_path):
    e = spark.createDataFrame([(0, 5, 0.5), (0, 1, 0.25), (3, 0, 1.0)], "i long, j long, w double")
    binary.write_sparse(e, 5, str(tmp_path / "s"))
    assert (tmp_path / "s").read_bytes() == binary.sparse_bytes(e, 5)
    with pytest.raises(Exception, match="beyond"):
        binary.write_sparse(e, 3, str(tmp_path / "t"))


def test_nested_file(spark, tmp_path):
    binary.write_nested(spark.createDataFrame([(2, 9), (0, 4), (2, 1)], "a long, b long"), 4, str(tmp_path / "n"))
    assert (tmp_path / "n").read_bytes() == binary.nested_bytes([[4], [], [1, 9], []])


def test_lines_are_numbered_over_splits(spark, tmp_path):
    (tmp_path / "v").write_text("".join(f"{k},1\n" for k in range(5000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        rows = text_formats.read_vectors(spark, str(tmp_path / "v")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(rows) == 5000 and all(r.features[0] == r.id for r in rows)


def test_cluster_keeps_notes(spark):
    clusters = spark.createDataFrame([(1, 0, None, "kept")], "scale int, cluster_id int, parent_id int, notes string")
    assert [tuple(r) for r in hsne.add_cluster(clusters, 0, 2, 0, 1).orderBy("scale").collect()] == [(0, 2, 0, None), (1, 0, None, "kept")]
