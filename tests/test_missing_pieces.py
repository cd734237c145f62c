"""Quantile brackets, threshold grids, subset errors, fold statistics, digests, rejects, sinks and p values."""

import math
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from outvote.functions.expr import digest128
from outvote.operators import cleaning as D
from outvote.operators import ensemble as E
from outvote.operators import errors as R
from outvote.operators import features as X
from outvote.operators import metrics as M
from outvote.operators import reports as T
from outvote.plans import quantiles as Q
from outvote.plans import staging
from outvote.sources import tables as S

MODELS = ["m0", "m1", "m2"]


@pytest.fixture(scope="module")
def marked(spark):
    r = np.random.default_rng(9)
    n = 900
    y = r.normal(100, 20, n)
    data = pd.DataFrame({"entry_id": np.arange(n), "var_add": r.choice([1.0, 2.0], n), "modified_pct": 1.0, "ref_values": y})
    data["values"] = y + np.where(r.random(n) < 0.1, 40.0, 0.0)
    for i, m in enumerate(MODELS):
        data[m] = y + r.normal(0, 3 + i, n)
    df = spark.createDataFrame(data).repartition(4)
    return df.withColumn("m1", F.when(F.col("entry_id") == 5, None).otherwise(F.col("m1")))


def test_brackets_that_miss_are_searched_for_in_the_source(spark, monkeypatch):
    """With an error far too small most ranks lie outside of their brackets."""
    monkeypatch.setattr(Q, "_sketch_size", lambda wanted: 8)
    monkeypatch.setattr(Q, "_rank_error", lambda size: 0.002)
    r = np.random.default_rng(2)
    x = np.concatenate([r.normal(size=6000), np.full(3000, 0.25)])
    qs = [0.0, 0.01, 0.3, 0.5, 0.77, 0.99, 1.0]
    df = spark.createDataFrame(pd.DataFrame({"x": x})).repartition(3)
    assert Q.exact_quantiles(df, [], ["x"], qs).first()["x"] == list(np.quantile(x, qs))


def test_quantiles_and_policies_by_column(spark):
    df = spark.createDataFrame([(1.0, float(i), None if i == 3 else float(-i)) for i in range(11)], "k double, a double, b double")
    row = Q.exact_quantiles(df, ["k"], ["a", "b"], {"a": [0.5], "b": [0.0, 0.5, 1.0]}, {"a": "poison", "b": "skip"}).first()
    assert row["a"] == [5.0] and row["b"] == [-10.0, -5.5, 0.0]
    assert Q.exact_quantiles(df, ["k"], ["a", "b"], {"a": [0.5], "b": [0.5]}).first()["b"] is None
    with pytest.raises(ValueError):
        Q.exact_quantiles(df, ["k"], ["a", "b"], {"a": [0.5]})


@pytest.mark.parametrize("kind", ["abs", "both"])
def test_grid_of_group_aggregates_equals_one_by_one(marked, monkeypatch, kind):
    monkeypatch.setattr(T, "CELLS", 16)
    steps, columns = [1.0, 5.0, 20.0, 60.0], ("p_std", "d_median_a")
    keys = ["var_add", "modified_pct", "modified", "threshold_pct", "group_no", "stat", "agg"]
    one = T.group_aggregates(T.group_statistics(marked, "ref_values", MODELS, steps, group_stat=kind), columns, split_modified=True).toPandas()
    grid = T.group_aggregates_grid(marked, "ref_values", MODELS, steps, group_stat=kind, columns=columns, split_modified=True).toPandas()
    a, b = (f.sort_values(keys).reset_index(drop=True)[[*keys, "value"]] for f in (one, grid))
    assert len(a) > 20 and (a[keys] == b[keys]).all().all()
    assert np.allclose(a["value"], b["value"], rtol=1e-12, equal_nan=True)


@pytest.mark.parametrize("kind", ["rel", "both"])
def test_subsets_equal_separate_runs_with_those_models(marked, kind):
    stats = M.multi_model_stats(marked, "ref_values", MODELS, 10.0, group_stat=kind).toPandas()
    assert len(stats) == 7 * 2
    for combo, part in stats.groupby("model_combo"):
        own = combo.split(";")
        want = M.group_slice(M.classification_metrics(marked, "ref_values", own, 10.0, group_stat=kind), len(own)).toPandas()
        a, b = (f.sort_values("var_add")[["group_len", "group_pos", "precision", "recall", "f1"]].to_numpy(float) for f in (part, want))
        assert np.allclose(a, b)
    curve = M.multi_model_curve(marked, "ref_values", MODELS, [1.0, 10.0, 40.0], group_stat=kind, threshold=10.0).toPandas()
    at = curve[curve["threshold_pct"] == 10.0].merge(stats, on=["model_combo", "var_add"])
    assert len(at) == 3 * 2 and (at["group_len_x"] == at["group_len_y"]).all() and np.allclose(at["f1_x"], at["f1_y"])


def test_fold_statistics_give_the_fits_of_spark(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(400, 2)) * [1.0, 50.0] + [1000.0, 3.0]
    df = spark.createDataFrame([(i, float(a), float(b), float(3 * a - b + r.normal())) for i, (a, b) in enumerate(x)], "entry_id long, a double, b double, values double")
    own = E.oof_linear(df, ("a", "b"), k=4).select("entry_id", "fold", "linear").toPandas().sort_values("entry_id")
    fit = E.oof_predict(df, ("a", "b"), estimators={"linear": LinearRegression(regParam=0.0, solver="normal")}, k=4).toPandas().sort_values("entry_id")
    assert (own["fold"].to_numpy() == fit["fold"].to_numpy()).all() and np.allclose(own["linear"], fit["linear"], rtol=1e-9)
    flat = E.oof_linear(df.withColumn("c", F.lit(7.0)), ("a", "b", "c"), k=4).toPandas().sort_values("entry_id")
    assert np.allclose(flat["linear"], own["linear"], rtol=1e-9)
    gaps = E.oof_linear(df.withColumn("a", F.when(F.col("entry_id") == 3, None).otherwise(F.col("a"))), ("a", "b"), k=4)
    assert [r["entry_id"] for r in gaps.filter("linear is null").collect()] == [3]


def test_digests_are_not_functions_of_one_hash(spark):
    """With the number last, keys whose plain hashes agree would agree in both digests; what is hashed first keeps them apart."""
    row = spark.range(1).select(*[d.alias(n) for n, d in zip("ab", digest128(["id"]))], F.xxhash64(F.col("id").isNull(), "id").alias("plain"))
    assert len(set(row.first())) == 3
    first, second = (str(d) for d in digest128(["id"]))
    assert first.index("1") < first.index("id") and second.index("2") < second.index("id")
    rows = spark.range(2000).select((F.col("id") % 700).alias("k"), F.col("id").alias("o"), F.lit("w").alias("w"))
    assert sorted(r["o"] for r in D.dedup_keep_first(rows, "k", "o").collect()) == list(range(700))


def test_keys_that_collide_in_a_digest_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(D, "digest128", lambda key: [F.lit(1).cast("long"), F.lit(2).cast("long")])
    rows = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "k string, o int, w string")
    with pytest.raises(Exception, match="equal digests"):
        D.dedup_keep_first(rows, "k", "o").collect()
    assert D.dedup_keep_first(rows.filter("k = 'a'"), "k", "o").count() == 1


def test_rejects_are_told_from_missing_values(spark, tmp_path):
    (tmp_path / "in.csv").write_text("id;x;name\n1;2.5;a\n2;;b\n3;oops;c\n4;1;d;more\nfive;1;e\n")
    good, bad = S.read_with_rejects(spark, str(tmp_path / "in.csv"), "id long, x double, name string")
    assert sorted(map(tuple, good.collect())) == [(1, 2.5, "a"), (2, None, "b")]
    assert sorted(r["line"] for r in bad.collect()) == ["3;oops;c", "4;1;d;more", "five;1;e"]
    assert good.count() == 2 and bad.count() == 3 and good.select("name").count() == 2


def test_a_dataset_has_few_files(spark, tmp_path):
    rows = spark.range(4000).select("id", (F.col("id") % 5).cast("double").alias("var_add"), F.lit(1.0).alias("modified_pct")).repartition(16)
    S.write_table(rows, str(tmp_path / "out"))
    folders = [(d, f) for d, _, f in os.walk(tmp_path / "out") if "modified_pct=" in d]
    assert len(folders) == 5 and all(sum(n.endswith(".parquet") for n in f) <= 2 for _, f in folders)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4000


def test_p_values_equal_tables(spark):
    """Two-sided critical values of Student's t."""
    known = [(12.706205, 1, 0.05), (63.656741, 1, 0.01), (2.228139, 10, 0.05), (3.169273, 10, 0.01), (2.042272, 30, 0.05), (1.959964, 10**8, 0.05), (1.980, 120, 0.05), (0.0, 7, 1.0), (0.699812, 10, 0.5), (4.586894, 10, 0.001)]
    rows = T.with_p_value(spark.createDataFrame([(t, d, p) for t, d, p in known], "t double, dof long, want double")).collect()
    for r in rows:
        assert math.isclose(r["p"], r["want"], rel_tol=2e-3 if r["t"] == 1.980 else 2e-5), r
    odd = T.with_p_value(spark.createDataFrame([(None, 5), (2.0, 0), (float("inf"), 4)], "t double, dof long")).collect()
    assert [r["p"] for r in odd] == [None, None, 0.0]


def test_p_value_equals_that_of_spark(spark):
    r = np.random.default_rng(3)
    df = spark.createDataFrame([(float(x), float(0.3 * x + r.normal(0, 4))) for x in range(25)], "x double, y double")
    got = T.with_p_value(T.slope_statistics(df, "x", "y")).first()["p"]
    assert math.isclose(got, T.slope_p_value(df, "x", "y"), rel_tol=1e-8)


def test_hubs_have_short_signature_keys(spark):
    """Three hubs of 300 000 neighbours: equal multisets in another order, and one label that differs."""
    n = 300_000
    leaves = spark.range(3 * n).select(
        F.lit(0).alias("graph_id"), F.col("id").alias("node_id"), F.concat(F.lit("L"), F.col("id") % n % 7).alias("label")
    ).withColumn("label", F.when(F.col("node_id") == 3 * n - 1, "L9").otherwise(F.col("label")))
    hubs = spark.range(3 * n, 3 * n + 3).select(F.lit(0).alias("graph_id"), F.col("id").alias("node_id"), F.lit("H").alias("label"))
    edges = spark.range(3 * n).select(F.lit(0).alias("graph_id"), F.col("id").alias("src"), (F.floor(F.col("id") / n) + 3 * n).alias("dst"))
    keyed = X.signature_keys(leaves.union(hubs), edges.orderBy(F.rand(3)), own=("label",))
    keys = {r.node_id - 3 * n: r.signature_key for r in keyed.filter(F.col("node_id") >= 3 * n).collect()}
    assert keys[0] == keys[1] != keys[2]
    assert keyed.select("signature_key").distinct().count() == 8 + 2


def test_signature_keys_part_what_texts_part(spark):
    r = np.random.default_rng(4)
    nodes = [(int(i % 5), int(i), str(r.choice(["C", "N", "O"])), int(r.integers(2))) for i in range(150)] + [(0, 500, None, 1), (1, 501, "C", None)]
    edges = [(int(g), int(a) * 5 + int(g), int(b) * 5 + int(g)) for g, a, b in zip(r.integers(0, 5, 200), r.integers(0, 30, 200), r.integers(0, 30, 200))] + [(0, 500, 5), (1, 501, 1), (2, 2, 2)]
    nodes = spark.createDataFrame(nodes, "graph_id int, node_id int, label string, degree int")
    edges = spark.createDataFrame(edges, "graph_id int, src int, dst int")
    own = ("label", "degree")
    by_text = X.signature_codes(X.node_signatures(nodes, edges, own))
    by_key = X.signature_codes(X.signature_keys(nodes, edges, own), key="signature_key")
    codes = lambda df: {(r.graph_id, r.node_id): (r.code, r.n_signatures) for r in df.collect()}
    assert codes(by_text) == codes(by_key)
    texts = {r.code: r.signature for r in by_text.collect()}
    assert {r.code: r.signature for r in X.signature_dictionary(by_key, nodes, edges, own).collect()} == texts


def test_bucketed_reference_is_joined_without_a_shuffle(spark):
    rows = spark.createDataFrame([(i % 40, float(i % 3), float(i)) for i in range(200)] + [(None, 1.0, 5.0), (77, 1.0, float("nan"))], "entry_id long, var_add double, values double")
    ref = spark.createDataFrame([(i, float(i) / 2) for i in range(35)] + [(90, None)], "entry_id long, values double")
    with staging.owned() as tables:
        near, far = R.bucket_by_entry(rows, 6), R.bucket_by_entry(ref, 6)
        out = R.align_bucketed(near, far)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "SortMergeJoin" in plan
        same = lambda df: sorted(map(repr, df.select("entry_id", "var_add", "values", "ref_values").collect()))
        assert same(out) == same(R.align_reference(rows, ref))
        assert same(R.align_bucketed(near.filter("var_add = 1"), far)) == same(R.align_reference(rows.filter("var_add = 1"), ref))
        names = list(tables.names)
        twice = R.bucket_by_entry(ref.union(ref), 6)
        with pytest.raises(Exception, match="unique"):
            R.align_bucketed(near, twice).collect()
    tables.release(spark)
    assert names and not any(spark.catalog.tableExists(n) for n in names)
