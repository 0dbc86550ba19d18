import pickle
import struct
import zlib

import numpy as np
import pytest

from chronomesh.sources import readers, shared, writers
from chronomesh.streaming import online


def wide(df):
    return {(r.t, r.roi): r.x for r in df.collect()}


def test_tsv(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("x\ty\tz\n1\tn/a\tn/a\n\n2\t3.5\tn/a\nn/a\tn/a\tn/a\n4\t5\tn/a\n")
    assert wide(readers.load_timeseries(spark, str(tmp_path / "a.tsv"))) == {(0, "x"): 1.0, (1, "x"): 2.0, (1, "y"): 3.5, (2, "x"): 4.0, (2, "y"): 5.0}
    (tmp_path / "b.tsv").write_text("1\t2\n3\t4\n")
    assert wide(readers.read_tsv(spark, str(tmp_path / "b.tsv"))) == {(0, "0"): 1.0, (0, "1"): 2.0, (1, "0"): 3.0, (1, "1"): 4.0}


def test_txt_npy_pkl(spark, tmp_path):
    m = np.arange(6.0).reshape(3, 2)
    np.savetxt(tmp_path / "m.txt", m)
    np.save(tmp_path / "m.npy", m)
    (tmp_path / "m.pkl").write_bytes(pickle.dumps(m))
    expect = {(t, k): m[t, k] for t in range(3) for k in range(2)}
    for name in ("m.txt", "m.npy", "m.pkl"):
        assert wide(readers.load_timeseries(spark, str(tmp_path / name))) == expect
    (tmp_path / "bad.pkl").write_bytes(pickle.dumps(zlib.compress))
    with pytest.raises(pickle.UnpicklingError):
        readers.load_timeseries(spark, str(tmp_path / "bad.pkl"))
    with pytest.raises(ValueError):
        readers.load_timeseries(spark, "x.csv")
    assert readers.load_timeseries(spark, "x.nii.gz") is None


def mat5(arrays, compress):
    def element(kind, body):
        return struct.pack("<II", kind, len(body)) + body + b"\0" * (-len(body) % 8)

    out = b"MATLAB 5.0 MAT-file".ljust(124) + struct.pack("<H", 0x0100) + b"IM"
    for name, a in arrays.items():
        body = element(6, struct.pack("<II", 6, 0)) + element(5, np.array(a.shape, "<i4").tobytes()) + element(1, name.encode()) + element(9, a.astype("<f8").tobytes("F"))
        whole = element(14, body)
        packed = zlib.compress(whole)
        out += struct.pack("<II", 15, len(packed)) + packed if compress else whole
    return out


def test_mat(spark, tmp_path):
    a, b = np.arange(12.0).reshape(3, 4), np.ones((2, 2, 3))
    for compress in (False, True):
        (tmp_path / "m.mat").write_bytes(mat5({"first": a, "dfc_data": b, "last": a * 2}, compress))
        found = readers.load_timeseries(spark, str(tmp_path / "m.mat"))
        assert np.array_equal(found["first"], a) and np.array_equal(found["last"], a * 2)
        assert np.array_equal(readers.read_mat(spark, str(tmp_path / "m.mat")), b)


def test_confounds_and_scans(spark, tmp_path):
    (tmp_path / "c.csv").write_text("trans_x,csf,age\n1,2,3\n4,5,n/a\n")
    got = {(r.t, r.name): r.x for r in readers.read_confounds(spark, str(tmp_path / "c.csv"), ["csf", "age", "none"]).collect()}
    assert got == {(0, "csf"): 2.0, (0, "age"): 3.0, (1, "csf"): 5.0}
    paths = spark.createDataFrame([("/d/sub-01/func/sub-01_task-rest_run-2_bold.nii.gz",), ("/d/sub-02/func/sub-02_task-nback_bold.nii.gz",)], "path string")
    assert [(r.subject, r.task, r.run, r.suffix) for r in readers.list_scans(paths, task="rest").collect()] == [("01", "rest", "2", "bold")]


def test_panel_round_trip(spark, tmp_path):
    df = readers.array_panel(spark, np.random.default_rng(1).random((2, 5, 3)))
    writers.write_panel(df, str(tmp_path / "p"))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "p")).select(df.columns).collect())) == sorted(map(tuple, df.collect()))


def test_online_runs_over_batches(spark, tmp_path):
    rows = [(1, f"2024-01-01 00:0{k}:00", s) for k, s in enumerate("aabba")] + [(2, "2024-01-01 00:01:00", "c"), (2, "2024-01-01 00:05:00", "d")]
    for part in (rows[:3] + rows[5:6], rows[3:5] + rows[6:]):
        spark.createDataFrame(part, "user_id long, ts string, event_type string").selectExpr("user_id", "cast(ts as timestamp) ts", "event_type").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("user_id long, ts timestamp, event_type string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = online.run_available(online.online_runs(stream))
    assert sorted((r.user, r.state, r.length) for r in got.collect()) == [(1, "a", 2), (1, "b", 2), (2, "c", 1)]


def test_json_fields(spark):
    df = spark.createDataFrame([(1, '{"k": 3, "z": "x"}'), (2, "{}"), (3, None), (4, "no json")], "i int, props string")
    assert [(r.i, r.k) for r in readers.read_props(df, "props", "k long").orderBy("i").collect()] == [(1, 3), (2, None), (3, None), (4, None)]


def test_shared_folder_is_required_on_a_cluster(spark):
    class Session:
        conf, sparkContext = type("Conf", (), {"get": staticmethod(lambda *a: None)}), type("Context", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError):
        shared.shared_folder(Session())
    path = shared.fresh_path(spark, "x")
    assert path.startswith(shared.shared_folder(spark) + "/x-")


def test_notebook_cells(spark, tmp_path):
    (tmp_path / "n.ipynb").write_text('{"cells": [{"cell_type": "markdown", "source": ["# t"]}, {"cell_type": "code", "source": ["a = 1\\n", "b = 2"]}, {"cell_type": "code", "source": []}], "nbformat": 4}')
    assert [(r.cell, r.source) for r in readers.read_notebook(spark, str(tmp_path / "n.ipynb")).collect()] == [(1, "a = 1\nb = 2"), (2, "")]
