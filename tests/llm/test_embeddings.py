"""Whitening by block matrices against numpy on all rows at once."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from outvote.llm import whitening as wh


def vectors(n=300, width=40, seed=5):
    r = np.random.default_rng(seed)
    turn = r.normal(size=(width, width)) * np.geomspace(0.02, 1.0, width)
    return (r.normal(size=(n, width)) @ turn * 0.3).astype(np.float32)


def by_numpy(rows, most=32):
    """``{id: [deviation, row]}`` in order of the rows, components up to sign, shares."""
    x = np.floor(64 * rows.astype(float)).astype(np.int64) + 1_000_000
    n, total = len(x), x.sum(axis=0)
    centred = x - total / n
    values, turn = np.linalg.eigh(centred.T @ centred / n)
    values, turn = values[::-1][:most], turn[:, ::-1][:, :most]
    return ((n * x - total) ** 2).sum(axis=1), centred @ turn / np.sqrt(values), values / (centred**2).sum() * n


def table(df, k):
    got = df.toPandas().sort_values(["vec_id", "component"])
    return got, got["whitened"].to_numpy().reshape(-1, k)


@pytest.mark.parametrize("block", [1 << 22, 3000])
def test_whitening_equals_numpy(spark, monkeypatch, block):
    monkeypatch.setattr(wh, "BLOCK_BYTES", block)
    monkeypatch.setattr(wh, "TASK_BYTES", 4 * block)
    data = vectors()
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "vec_id long, embedding array<float>").repartition(7)
    got, y = table(wh.whitened_rows(df), 32)
    away, want, shares = by_numpy(data)
    assert np.allclose(y * np.sign((y * want).sum(axis=0)), want, atol=1e-9)
    assert (got["deviation"].to_numpy().reshape(-1, 32)[:, 0] == away).all()
    assert np.allclose(got["explained"].to_numpy()[:32], shares, rtol=1e-9)
    assert (got["n"] == 300).all() and got["identity_error"].nunique() == 1
    covariance = np.cov(y.T, bias=True)
    assert math.isclose(got["identity_error"].iloc[0], np.abs(covariance - np.eye(32)).max(), abs_tol=1e-12) and got["identity_error"].iloc[0] < 1e-9
    assert [f"{f.name} {f.dataType.simpleString()}" for f in wh.whitened_rows(df).schema] == ["vec_id bigint", "component int", "n bigint", "deviation bigint", "whitened double", "explained double", "identity_error double"]


def test_rows_without_a_whole_vector_go_and_others_stay(spark):
    data = vectors(50, 4).astype(float)
    bad = [None, [], [0.1, None, 0.2, 0.3], [0.1, float("nan"), 0.0, 0.0], [float("inf"), 0.0, 0.0, 0.0], [1e300, 0.0, 0.0, 0.0], [0.5, 0.5], [0.1] * 6]
    rows = [(i, v.tolist()) for i, v in enumerate(data)] + [(100 + i, v) for i, v in enumerate(bad)] + [(None, data[0].tolist()), (7, data[7].tolist()), (-(2**62) - 5, data[1].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    df = df.withColumns({c: F.lit("clash") for c in ("x", "id", "index", "near", "rest", "away", "known", "vector", "v", "n", "whitened")})
    got = wh.whitened_rows(df).toPandas()
    kept = np.vstack([data, data[0], data[7], data[1]])
    away, want, _ = by_numpy(kept)
    assert len(got) == 53 * 4 and (got["n"] == 53).all()
    ids = [r["vec_id"] for r in wh.whitened_rows(df).select("vec_id").filter("vec_id is not null").collect()]
    assert sorted(ids) == sorted([*range(50), 7, -(2**62) - 5] * 4)
    first = got[got["component"] == 1]
    assert sorted(first["deviation"]) == sorted(away)
    assert np.allclose(sorted(first["whitened"].abs()), sorted(np.abs(want[:, 0])), atol=1e-9)
    same = got[got["vec_id"] == 7].groupby("component")["whitened"].nunique()
    assert (same == 1).all()


def test_nothing_to_whiten_gives_no_rows(spark):
    schema = "vec_id long, embedding array<float>"
    for rows in ([], [(1, None)], [(1, [])], [(1, [0.5, 0.5])], [(1, [0.5, 0.25]), (2, [0.5, 0.25])]):
        got = wh.whitened_rows(spark.createDataFrame(rows, schema))
        assert got.count() == 0 and got.schema.simpleString() == wh.whitened_rows(spark.createDataFrame([], schema)).schema.simpleString()


def test_directions_without_variance_are_left_out(spark):
    data = vectors(80, 3).astype(float)
    flat = np.hstack([data, np.full((80, 1), 0.3)])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(flat)], "vec_id long, embedding array<double>")
    found = wh.whiten(df)
    assert found.rows.agg(F.max("component")).first()[0] == 3 and found.identity_error < 1e-9
    assert np.allclose(found.components.T @ found.components, np.eye(4))


def test_deviations_beyond_long_are_null(spark):
    df = spark.createDataFrame([(1, [1e12, 1.0]), (2, [-1e12, 0.0]), (3, [0.0, 3.0])], "vec_id long, embedding array<double>")
    got = wh.whitened_rows(df).toPandas()
    assert got[got["vec_id"] == 1]["deviation"].isna().all() and got[got["vec_id"] == 3]["deviation"].isna().sum() == 0
