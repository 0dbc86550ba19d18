"""Queries over whole tables against brute force."""

import datetime

import numpy as np

from chronomesh.plans.catalog import QUERIES


def test_parcellate_reads_all_parts(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(int(p), datetime.date(1995, int(m), 3), float(rng.integers(1, 50))) for p in (5, 200, 299, 300, 301, 5000, 9000) for m in range(1, 6)]
    brand = {p: f"Brand#{11 + p % 2}" for p, _, _ in rows}
    spark.createDataFrame(rows, "l_partkey long, l_shipdate date, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame(list(brand.items()), "p_partkey long, p_brand string").write.parquet(str(tmp_path / "part.parquet"))
    got = {(r.parcel, r.t): r.x for r in QUERIES["parcellate_mean"](spark, str(tmp_path)).collect()}
    series = {p: np.array([x for q, _, x in rows if q == p]) for p in brand}
    z = {p: (x - x.mean()) / x.std() for p, x in series.items()}
    for parcel in (11, 12):
        expect = np.mean([z[p] for p in brand if 11 + p % 2 == parcel], axis=0)
        assert np.allclose([got[parcel, t] for t in range(5)], expect, atol=1e-6)
    assert all(got[900, t] == 0 for t in range(5))
