import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from outvote.defaults import MODELS
from outvote.operators import reports as T
from tests.test_cards_metrics import KEYS, make, numpy_cards


@pytest.fixture(scope="module")
def data():
    return make(300)


@pytest.fixture(scope="module")
def df(spark, data):
    return spark.createDataFrame(data).repartition(3).cache()


def test_bin_names(spark):
    df = spark.createDataFrame([(v,) for v in (-5.0, 1.0, 1.99, 2.0, 3.0, 9.0)], "v double")
    got = [r.bin_val for r in T.bin_values(df, "v", (1.0, 2.0, 3.0)).orderBy("v").collect()]
    assert got == [1.0, 2.0, 2.0, 3.0, 3.0, 3.0]


def test_profile_and_regression(data, df):
    edges = np.arange(0.0, 25.0, 2.5)
    got = T.binned_error_profile(df, edges).toPandas().set_index("bin_val").sort_index()
    dist = (data[list(MODELS)].median(axis=1) - data["values"]).abs()
    at = np.digitize(data["values"], edges)
    names = [round(edges[x], 3) if 0 < x < len(edges) else round(min(edges), 3) if x == 0 else round(max(edges), 3) for x in at]
    want = dist.groupby(pd.Series(names)).agg(["size", "median"])
    assert (got.n == want["size"]).all() and np.allclose(got.median_error, want["median"])
    assert got.share.sum() == pytest.approx(1)
    fits = {r.fit: r for r in T.error_regression(df, edges).collect()}
    slope, intercept = np.polyfit(data["values"], dist, 1)
    assert fits["entries"].slope == pytest.approx(slope) and fits["entries"].intercept == pytest.approx(intercept)
    inner = want.iloc[1:-1]
    slope, intercept = np.polyfit(inner.index, inner["median"], 1)
    assert fits["bin_medians"].slope == pytest.approx(slope) and fits["bin_medians"].intercept == pytest.approx(intercept)


def test_slope_p_value(spark):
    line = spark.range(30).select(F.col("id").cast("double").alias("x"), (F.col("id") * 2 + F.pmod(F.xxhash64("id"), F.lit(5))).cast("double").alias("y"))
    assert T.slope_p_value(line, "x", "y") < 1e-6


def test_error_summary(data, df):
    got = T.model_error_summary(df, "ref_values").toPandas()
    assert set(got.ref_type) == {"mod", "noisy"}
    modified = (data["values"] - data["ref_values"]).abs() > 1e-8
    for (add, pct, mod), part in data.groupby([*KEYS, modified]):
        for m in MODELS:
            for kind, target in (("mod", "values"), ("noisy", "ref_values")):
                err = (part[m] - part[target]).abs()
                rows = got[(got.var_add == add) & (got.modified_pct == pct) & (got.modified == mod) & (got.model_name == m) & (got.ref_type == kind) & (got.delta_type == "delta_abs")]
                found = dict(zip(rows["agg"], rows["value"]))
                assert found["mean"] == pytest.approx(err.mean()) and found["median"] == pytest.approx(err.median())
    assert set(T.model_error_summary(df).toPandas().ref_type) == {"mod"}
    assert set(T.model_error_summary(df, original="ref_values").toPandas().ref_type) == {"base"}


def test_group_tables(data, df):
    cards = numpy_cards(data, MODELS, 5.0, 1.5)
    cards["mod"] = (cards["values"] - cards["ref_values"]).abs() > 1e-8
    sizes = T.group_sizes(df, "ref_values")
    want = cards.groupby([*KEYS, "mod", "a"]).size()
    got = {(r["var_add"], r["modified_pct"], r["modified"], float(r["group_no"])): r["size"] for r in sizes.collect()}
    assert got == want.to_dict()
    whole = T.group_size_histogram(T.group_sizes(df)).toPandas()
    assert len(whole) == 3 * 6 and whole["size"].sum() == len(data)

    stats = T.group_statistics(df, "ref_values").cache()
    means = T.group_means(stats, "p_std").toPandas().set_index([*KEYS, "group_no", "type"])
    spread = cards.assign(p_std=cards[list(MODELS)].std(axis=1))
    for (add, pct, g), part in spread.groupby([*KEYS, "a"]):
        assert means.loc[(add, pct, int(g), "All"), "mean"] == pytest.approx(part.p_std.mean())
        if part["mod"].any():
            assert means.loc[(add, pct, int(g), "Modified"), "mean"] == pytest.approx(part[part["mod"]].p_std.mean())
    labels = {r.group for r in T.group_labels(stats, split_last=True).select("group").distinct().collect()}
    assert "5\nMod" in labels and "5" not in labels

    density = T.clipped_density(stats, "p_std").toPandas()
    top = np.quantile(spread.p_std, 0.99)
    for g, part in spread.groupby("a"):
        kept = part.p_std[(part.p_std >= 0) & (part.p_std <= top)]
        want, _ = np.histogram(kept, bins=50, range=(0, top), density=True) if len(kept) else (np.zeros(50), None)
        rows = density[density.group_no == g].set_index("bin")
        assert np.allclose(rows.density.reindex(range(50), fill_value=0), want)

    summary = T.distribution_summary(stats, ("p_std",), (*KEYS, "group_no")).toPandas()
    for (add, pct, g), part in spread.groupby([*KEYS, "a"]):
        rows = summary[(summary.var_add == add) & (summary.modified_pct == pct) & (summary.group_no == g)].sort_values("q")
        assert np.allclose(rows["value"], np.quantile(part.p_std, T.EIGHTHS))
    notes = T.size_annotations(stats, KEYS, True).toPandas()
    assert notes["n"].sum() == len(data)
