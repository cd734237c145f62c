import re
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from outvote.defaults import MODELS, THRESHOLDS, TOL
from outvote.operators import cards as C
from outvote.operators import errors as R
from outvote.operators import metrics as M

KEYS = ["var_add", "modified_pct"]
NAN = float("nan")


def make(n=400, seed=1, datasets=((0.5, 1.0), (2.0, 1.0), (2.0, 5.0))):
    rng = np.random.default_rng(seed)
    parts = []
    for add, pct in datasets:
        ref = rng.normal(10, 5, n).round(2)
        wrong = rng.random(n) < pct / 20
        part = pd.DataFrame({"entry_id": np.arange(n), "var_add": add, "modified_pct": pct, "ref_values": ref, "values": ref + wrong * add * 5})
        for m in MODELS:
            part[m] = (ref + rng.normal(0, 1, n)).round(1)
        parts.append(part)
    return pd.concat(parts, ignore_index=True)


@pytest.fixture(scope="module")
def data():
    return make()


@pytest.fixture(scope="module")
def df(spark, data):
    return spark.createDataFrame(data).repartition(4).cache()


def numpy_cards(data, models, t, offset):
    """Own recomputation, dataset by dataset."""
    out = data.copy()
    for _, at in data.groupby(KEYS).groups.items():
        part = data.loc[at]
        err = (part[list(models)].sub(part["values"], axis=0)).abs()
        rel = err.div(part[list(models)].median(axis=1) + offset, axis=0)
        a = err.to_numpy() >= np.quantile(err, (100 - t) / 100.0, axis=0)
        r = rel.to_numpy() >= np.quantile(rel, (100 - t) / 100.0, axis=0)
        out.loc[at, "a"], out.loc[at, "r"], out.loc[at, "b"] = a.sum(1), r.sum(1), (a & r).sum(1)
    return out


@pytest.mark.parametrize("models", [MODELS, MODELS[:4]])
def test_cards_equal_numpy(data, df, models):
    thresholds, offsets = (0.7, 5.0, 30.0, 100.0), (0.0, 1.5)
    got = C.cards(df, models, thresholds, offsets).toPandas()
    assert len(got) == len(data) * 8
    for t in thresholds:
        for d in offsets:
            part = got[(got.threshold_pct == t) & (got.data_offset == d)].sort_values([*KEYS, "entry_id"])
            want = numpy_cards(data, models, t, d).sort_values([*KEYS, "entry_id"])
            assert (part.cards_abs.to_numpy() == want.a).all()
            assert (part.cards_rel.to_numpy() == want.r).all()
            assert (part.cards_both.to_numpy() == want.b).all()
            assert (part.cards_norm == 0).all()
            assert (part.cards_both <= part[["cards_abs", "cards_rel"]].min(axis=1)).all()
            if t == 100.0:
                assert (part.cards_abs == len(models)).all()


@pytest.mark.parametrize("kind", ["abs", "rel", "both"])
def test_metrics_equal_numpy(data, df, kind):
    thresholds = (1.0, 5.0, 20.0)
    got = M.classification_metrics(df, thresholds=thresholds, data_offsets=(0.0, 1.5), group_stat=kind).toPandas()
    keys = [*KEYS, "threshold_pct", "data_offset", "group_no"]
    assert not got.duplicated(keys).any()
    sizes = got.groupby([*KEYS, "threshold_pct", "data_offset"]).group_len.sum()
    real = set(map(tuple, data[KEYS].drop_duplicates().to_numpy()))
    assert all(n == (400 if key[:2] in real else 0) for key, n in sizes.items())
    for t in thresholds:
        for d in (0.0, 1.5):
            want = numpy_cards(data, MODELS, t, d)
            want["mod"] = (want["values"] - want["ref_values"]).abs() > TOL
            for (add, pct), part in want.groupby(KEYS):
                for g in range(6):
                    hit = part[part[kind[0]] == g]
                    row = got[(got.var_add == add) & (got.modified_pct == pct) & (got.threshold_pct == t) & (got.data_offset == d) & (got.group_no == g)]
                    if row.empty:
                        assert hit.empty
                        continue
                    row = row.iloc[0]
                    n, pos, ds_pos = len(hit), int(hit["mod"].sum()), int(part["mod"].sum())
                    p, r = pos / (n + TOL), pos / (ds_pos + TOL)
                    assert (row.group_len, row.group_pos) == (n, pos)
                    assert row.precision == pytest.approx(p) and row.recall == pytest.approx(r)
                    assert row.f1 == pytest.approx(2 * p * r / (p + r + TOL))
                    assert row.group_ratio == pytest.approx(n / 400) and row.group_pos_ratio == pytest.approx(pos / 400)


def test_marks_do_not_depend_on_the_other_thresholds_next_to_infinity(df):
    """A few zero denominators: cutoffs next to an infinite error are infinite, none is NaN."""
    zero = df.withColumns({m: F.when(F.col("entry_id") % 40 == 0, -1.5).otherwise(F.col(m)) for m in MODELS})
    cuts = C.cutoffs(zero, thresholds=(20, 10, 8, 6, 4, 2, 0.5), kinds=("rel",)).toPandas()
    assert not cuts["cutoff"].isna().any() and np.isinf(cuts["cutoff"]).any()
    many = C.cards(zero, thresholds=(20, 10, 8, 6, 4, 2), kinds=("rel",)).filter("threshold_pct = 4")
    alone = C.cards(zero, thresholds=4, kinds=("rel",))
    columns = ["entry_id", *KEYS, "cards_rel"]
    rows = [sorted(map(tuple, x.select(*columns).collect())) for x in (many, alone)]
    assert rows[0] == rows[1]
    assert all(r[-1] == len(MODELS) for r in rows[0] if r[0] % 40 == 0)


def test_metrics_with_reference_frame_norm_and_unknown_kind(spark, data, df):
    one = df.filter("var_add = 0.5")
    ref = one.select("entry_id", F.col("ref_values").alias("values"))
    bare = one.drop("ref_values")
    want = M.classification_metrics(one).orderBy("group_no").collect()
    assert M.classification_metrics(bare, ref).orderBy("group_no").collect() == want
    assert M.classification_metrics(one, group_stat="no such kind").orderBy("group_no").collect() == want
    norm = M.classification_metrics(one, group_stat="norm").collect()
    assert [(r.group_no, r.group_len) for r in norm] == [(0, 400)]


def test_no_dataset_columns_is_one_dataset(data, spark):
    flat = make(datasets=((2.0, 5.0),))
    df = spark.createDataFrame(flat)
    bare = df.drop(*KEYS)
    got = M.classification_metrics(bare, thresholds=(5.0, 20.0)).orderBy("threshold_pct", "group_no").toPandas()
    want = M.classification_metrics(df, thresholds=(5.0, 20.0)).orderBy("threshold_pct", "group_no").toPandas()
    pd.testing.assert_frame_equal(got, want.drop(columns=KEYS))
    assert {r.threshold for r in M.compare_threshold_methods(bare, num_points=6).collect()}


def test_subsets_equal_runs_on_each_subset(df):
    stats = M.multi_model_stats(df).toPandas().set_index(["model_combo", *KEYS])
    assert len(stats) == 31 * 3
    for combo in [c for n in (1, 3, 5) for c in combinations(MODELS, n)][::4]:
        part = M.group_slice(M.classification_metrics(df, models=combo, complete=False), len(combo)).toPandas()
        for row in part.itertuples():
            got = stats.loc[(";".join(combo), row.var_add, row.modified_pct)]
            assert (got.group_len, got.group_pos, got.n_models) == (row.group_len, row.group_pos, len(combo))
            assert got.f1 == pytest.approx(row.f1)


def test_best_subsets_and_their_curve(df):
    stats = M.multi_model_stats(df)
    pdf = stats.toPandas()
    best = M.best_combo(stats).toPandas().set_index("n_models")
    for n, part in pdf.groupby("n_models"):
        assert best.loc[n, "f1"] == part.f1.max()
    middle = M.best_combo(stats, "median").toPandas().set_index("n_models")
    for n, part in pdf.groupby("n_models"):
        assert abs(middle.loc[n, "f1"] - part.f1.median()) == pytest.approx((part.f1 - part.f1.median()).abs().min())
    with pytest.raises(ValueError):
        M.best_combo(stats, "other")
    curve = M.multi_model_curve(df, thresholds=(2.0, 5.0)).toPandas()
    assert len(curve) == 5 * 2 * 3
    at5 = curve[curve.threshold_pct == 5.0].set_index(["model_combo", *KEYS])
    same = pdf.set_index(["model_combo", *KEYS]).loc[at5.index]
    assert np.allclose(at5.f1, same.f1) and (at5.group_len == same.group_len).all()


def test_quantile_baseline_equals_numpy(data, df):
    steps = (0.01, 50.0, 90.0, 99.9)
    got = M.quantile_baseline(df, thresholds=steps).toPandas().set_index(["threshold", *KEYS])
    for key, part in data.groupby(KEYS):
        dist = (part[list(MODELS)].median(axis=1) - part["values"]).abs()
        mod = (part["values"] - part["ref_values"]).abs() > TOL
        for t in steps:
            flagged = dist > np.quantile(dist, t / 100)
            p = (flagged & mod).sum() / (flagged.sum() + TOL)
            r = (flagged & mod).sum() / (mod.sum() + TOL)
            row = got.loc[(t, *key)]
            assert row.precision == pytest.approx(p) and row.recall == pytest.approx(r)
    assert len(M.quantile_thresholds()) == 99


def test_threshold_100_flags_nothing_by_quantile(df):
    assert M.quantile_baseline(df, thresholds=(100.0,)).isEmpty()


def test_cards_do_not_depend_on_a_shift_that_the_offset_takes_back(df):
    moved = df.withColumns({c: F.col(c) + 2.0 for c in (*MODELS, "values", "ref_values")})
    out = M.shifted_comparison(df, moved, thresholds=(5.0, 20.0), data_offsets=(2.0, 4.0), shift=2.0).toPandas()
    by = ["threshold_pct", *KEYS, "data_offset"]
    orig, shifted = (out[out.df_type == k].sort_values(by, ignore_index=True) for k in ("orig", "shifted"))
    assert (orig.data_offset == shifted.data_offset).all()
    assert (orig.group_len - shifted.group_len).abs().max() <= 1  # rounding of the shifted values


def test_log_ratio_at_empty_groups(spark):
    rows = [(float(t), 1.5, g, n) for t, (top, below) in enumerate([(8, 4), (3, 0), (0, 3), (0, 0)]) for g, n in ((5, top), (4, below))]
    metrics = spark.createDataFrame(rows, "threshold_pct double, data_offset double, group_no int, group_len bigint")
    got = [r.log_ratio for r in M.group_size_log_ratio(metrics).orderBy("threshold_pct").collect()]
    assert got == [pytest.approx(np.log(2)), float("inf"), float("-inf"), None]


def small(spark, rows, models=("a", "b")):
    schema = "entry_id bigint, var_add double, values double, ref_values double, " + ", ".join(f"{m} double" for m in models)
    return spark.createDataFrame(rows, schema)


def test_missing_prediction_poisons_its_model_only(spark):
    rows = [(i, 1.0, 0.0, 0.0, float(i), NAN if i == 3 else float(i)) for i in range(10)]
    df = small(spark, rows)
    got = {r.entry_id: r.cards_abs for r in C.cards(df, ("a", "b"), 10.0, kinds=("abs",)).collect()}
    assert got == {**{i: 0 for i in range(9)}, 9: 1}
    got = {r.entry_id: r.cards_abs for r in C.cards(df, ("a", "b"), 10.0, kinds=("abs",), null_policy="skip").collect()}
    assert got == {**{i: 0 for i in range(9)}, 9: 2}


def test_missing_value_poisons_every_model_of_its_dataset(spark):
    rows = [(i, d, None if (i, d) == (2, 1.0) else 0.0, 0.0, float(i), float(i)) for i in range(10) for d in (1.0, 2.0)]
    got = {(r.var_add, r.entry_id): r.cards_abs for r in C.cards(small(spark, rows), ("a", "b"), 10.0, kinds=("abs",)).collect()}
    assert sum(v for (d, _), v in got.items() if d == 1.0) == 0
    assert got[(2.0, 9)] == 2


def test_rows_without_dataset_get_no_cards(spark):
    rows = [(i, None if i > 7 else 1.0, 0.0, 0.0, float(i), float(i)) for i in range(10)]
    got = {r.entry_id: r.cards_abs for r in C.cards(small(spark, rows), ("a", "b"), 100.0, kinds=("abs",)).collect()}
    assert got == {**{i: 2 for i in range(8)}, 8: 0, 9: 0}


def test_ties_at_the_cutoff_are_all_marked(spark):
    rows = [(i, 1.0, 0.0, 0.0, 5.0 if i >= 4 else 1.0, float(i)) for i in range(10)]
    got = C.cards(small(spark, rows), ("a",), 20.0, kinds=("abs",)).filter("cards_abs = 1").count()
    assert got == 6


def test_zero_denominator_ranks_highest_and_negative_lowest(spark):
    rows = [(0, 1.0, 1.0, 1.0, 0.0, 0.0), (1, 1.0, 0.0, 0.0, 0.0, 0.0), (2, 1.0, 5.0, 5.0, 4.0, 4.0), (3, 1.0, 5.0, 5.0, -2.0, -2.0), (4, 1.0, 9.0, 9.0, 8.0, 8.0)]
    df = small(spark, rows)
    out = R.model_diffs(df, ("a", "b"), data_offset=0.0).filter("model_name = 'a'").orderBy("entry_id").collect()
    assert [r.delta_rel for r in out] == [float("inf"), None, 0.25, 3.5, 0.125]
    got = C.cards(df, ("a", "b"), 40.0, 0.0, kinds=("rel",), null_policy="skip").orderBy("entry_id").collect()
    assert [r.cards_rel for r in got] == [2, 0, 2, 0, 0]


def test_nothing_modified_gives_zero_metrics(spark):
    rows = [(i, 1.0, 1.0, 1.0, float(i), float(i)) for i in range(20)]
    got = M.classification_metrics(small(spark, rows), models=("a", "b")).collect()
    assert sum(r.group_len for r in got) == 20
    assert all(r.precision == r.recall == r.f1 == 0 for r in got)


def test_alignment_keeps_rows_and_rejects_repeated_ids(spark):
    df = small(spark, [(i, 1.0, 1.0, 0.0, 1.0, 1.0) for i in range(4)]).drop("ref_values")
    ref = spark.createDataFrame([(1, 1.0), (2, 3.0), (77, 5.0)], "entry_id bigint, values double")
    got = R.modified_entries(R.align_reference(df, ref)).orderBy("entry_id").collect()
    assert [(r.entry_id, r.ref_values, r.modified) for r in got] == [(0, None, False), (1, 1.0, False), (2, 3.0, True), (3, None, False)]
    with pytest.raises(PySparkException):
        R.align_reference(df, ref.union(ref)).collect()


def test_basic_stats_skip_missing_and_handle_even_counts(spark):
    rows = [(0, 1.0, 2.0, 2.0, 1.0, 4.0, NAN), (1, 1.0, 2.0, 2.0, NAN, NAN, NAN), (2, 1.0, 2.0, 2.0, 1.0, 2.0, 9.0)]
    df = small(spark, rows, ("a", "b", "c"))
    got = R.basic_stats(df, ("a", "b", "c"), data_offset=0.0).orderBy("entry_id").collect()
    assert (got[0].p_median, got[0].p_mean, got[0].d_median_a, got[0].d_mean_r) == (2.5, 2.5, 0.5, 0.2)
    assert got[0].p_std == pytest.approx(np.std([1, 4], ddof=1))
    assert (got[1].p_median, got[1].p_mean, got[1].p_std) == (None, None, None)
    assert (got[2].p_median, got[2].p_mean) == (2.0, 4.0)


def test_correlations_equal_pandas_and_constant_gives_null(spark, data, df):
    got = R.diff_correlations(df).toPandas()
    for key, part in data.groupby(KEYS):
        want = part[list(MODELS)].sub(part["values"], axis=0).corr()
        rows = got[(got.var_add == key[0]) & (got.modified_pct == key[1])]
        assert len(rows) == 25
        for r in rows.itertuples():
            assert r.corr == pytest.approx(want.loc[r.model_name, r.model_name_2])
    flat = small(spark, [(i, 1.0, 0.0, 0.0, 3.0, float(i)) for i in range(5)])
    got = {(r.model_name, r.model_name_2): r.corr for r in R.diff_correlations(flat, ("a", "b")).collect()}
    assert got == {("a", "a"): None, ("a", "b"): None, ("b", "a"): None, ("b", "b"): 1.0}


def test_published_counts_of_the_top_groups(spark):
    from suite.fixtures import predictions

    sizes = {}
    out = M.classification_metrics(predictions(spark, "/root/testdata/sf0.01"), thresholds=5.0, complete=False)
    for r in out.collect():
        sizes[(r.var_add, r.modified_pct, r.group_no)] = (r.group_len, r.group_pos)
    assert sizes[(50000.0, 5.0, 5)] == (750, 750)
    assert sizes[(10000.0, 1.0, 5)] == (110, 110) and sizes[(10000.0, 1.0, 4)] == (37, 37)
    assert sizes[(10000.0, 5.0, 0)] == (13948, 0)


def test_methods_of_many_models_and_offsets_stay_small(spark):
    """The JVM leaves methods of more than 8000 bytes uncompiled."""
    models = ["cnn", "gnn", "fcd", "fcfp", "cb"]
    rows = spark.range(40).select(F.col("id").alias("entry_id"), F.col("id").cast("double").alias("values"), *[(F.col("id") * 1.5 + i).alias(m) for i, m in enumerate(models)])
    levels = C.card_levels(rows, models, list(map(float, range(20, 0, -1))), [1.5, 2.5, 5.0], ("abs", "rel", "both"), "values", [])
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        text = spark._jvm.PythonSQLUtils.explainString(levels.select("*")._jdf.queryExecution(), "codegen")
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert max(map(int, re.findall(r"maxMethodCodeSize:(\d+)", text))) < 8000


def test_predictions_are_dealt_to_all_tasks(spark, sf_dir):
    from suite.fixtures import predictions

    assert predictions(spark, sf_dir).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


@pytest.mark.parametrize("kind, policy", [("both", "skip")])
def test_subsets_of_odd_rows_are_the_same_in_batches_and_joined(spark, monkeypatch, kind, policy):
    """Missing and infinite numbers, zero denominators, ties and rows that come twice; no row is multiplied by subsets in the first plan."""
    inf = float("inf")
    odd = [None, NAN, inf, -inf, -1.5, 0.0, -0.0, 3.0]
    rng = np.random.default_rng(3)
    rows = []
    for i in range(600):
        numbers = [float(v) for v in rng.normal(2, 3, 5).round(1)]
        if i % 3 == 0 and i % 2:  # the other dataset has no odd numbers
            numbers[i % 5] = odd[i % 8]
            numbers[(i // 5) % 5] = odd[(i // 7) % 8]
        rows.append((i % 500, float(i % 2), numbers[0], 2.0, *numbers[1:]))
    models = ["a", "b", "c", "d"]
    df = small(spark, rows + rows[:50], models).repartition(3)
    steps = [40.0, 10.0, 2.0]

    def told():
        stats = M.multi_model_stats(df, models=models, threshold=20.0, group_stat=kind, null_policy=policy)
        levels = M._subset_levels(M._with_truth(df, "ref_values", "values", ["var_add"]), ["var_add"], models, M.subsets(models), steps, 1.5, kind, "values", policy)
        return sorted(map(str, stats.collect())), sorted(map(str, levels.select(sorted(levels.columns)).collect()))

    monkeypatch.setattr(M, "FEW", 0)
    joined = told()
    monkeypatch.undo()
    monkeypatch.setattr(M, "_joined_subset_levels", lambda *a: pytest.fail("a row for each subset"))
    assert told() == joined and len(joined[0]) == 15 * 2
