import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.ml.regression import DecisionTreeRegressor, LinearRegression
from pyspark.sql import functions as F

from outvote.operators import cleaning as P
from outvote.operators import ensemble as E
from outvote.operators import features as X
from outvote.operators import injection as J
from outvote.plans import staging
from outvote.sources import tables as S


@pytest.fixture(scope="module")
def clean(spark):
    return spark.range(1003).select(F.col("id").alias("entry_id"), (F.col("id") * 1.5).alias("values"), (F.col("id") % 7).alias("other"))


def values(df, *cols):
    return [tuple(r) for r in df.select(*cols).orderBy(cols[0]).collect()]


@pytest.mark.parametrize("pct", [0.0, 0.05, 2.5, 100.0])
def test_sample_is_exact_and_repeatable_under_any_partitioning(clean, pct):
    got = values(J.sample_exact(clean, pct), "entry_id")
    assert len(got) == int(pct / 100 * 1003)
    assert values(J.sample_exact(clean.repartition(17), pct), "entry_id") == got
    if pct == 2.5:
        assert values(J.sample_exact(clean, pct, seed=7), "entry_id") != got


def test_shuffle_keeps_the_multiset_and_all_other_rows(clean):
    out = J.inject_shuffle(clean, 10.0, ("values", "other"))
    before, after = np.array(values(clean, "entry_id", "values", "other")), np.array(values(out, "entry_id", "values", "other"))
    assert sorted(before[:, 1]) == sorted(after[:, 1])
    moved = before[:, 1] != after[:, 1]
    assert 80 < moved.sum() <= 100
    sampled = {r[0] for r in values(J.sample_exact(clean, 10.0), "entry_id")}
    assert set(before[moved, 0]) <= sampled
    assert (after[:, 2] == (after[:, 1] / 1.5) % 7).all()  # columns move together
    assert values(J.inject_shuffle(clean, 0.01), "entry_id", "values") == values(clean, "entry_id", "values")


def test_grid_equals_single_shifts(clean):
    grid = J.experiment_grid(clean, rates=(1.0, 5.0), deltas=(0.5, 3.0), scale=-10.0).cache()
    assert grid.count() == 4 * 1003
    for rate in (1.0, 5.0):
        for delta in (0.5, 3.0):
            part = grid.filter((F.col("modified_pct") == rate) & (F.col("var_add") == delta))
            assert values(part, "entry_id", "values") == values(J.inject_shift(clean, rate, -10.0 * delta), "entry_id", "values")


def test_published_plans():
    assert len(J.RATES) * len(J.SHIFTS_SYNTHETIC) == 125
    assert len(J.RATES) * len(J.SHIFTS_ENERGY) == 90


@pytest.mark.parametrize("k", [2, 5, 7])
def test_folds_are_even_and_complete(clean, k):
    sizes = {r.fold: r["count"] for r in J.kfold(clean, k).groupBy("fold").count().collect()}
    assert sorted(sizes) == list(range(k)) and sum(sizes.values()) == 1003
    assert max(sizes.values()) - min(sizes.values()) <= 1
    loose = J.kfold(clean, k, balanced=False)
    assert loose.select("fold").distinct().count() == k


def test_out_of_fold_predictions_cover_every_row_once(spark):
    rows = spark.range(300).select(
        F.col("id").alias("entry_id"), (F.col("id") % 17).cast("double").alias("x"), F.pmod(F.xxhash64("id"), F.lit(10)).cast("double").alias("z")
    ).withColumn("values", F.col("x") * 3 + F.col("z"))
    out = E.oof_predict(rows, ("x", "z"), estimators={"lin": LinearRegression(), "tree": DecisionTreeRegressor()}, k=3)
    assert values(out, "entry_id") == [(i,) for i in range(300)]
    maes = E.fold_mae(out, ("lin", "tree"))
    assert maes.count() == 6
    best = {r.model_name: r.mae for r in E.best_fold(maes).collect()}
    assert best["lin"] < 1e-6 < best["tree"]
    assert len(E.default_estimators()) == 5


def test_first_row_per_key(spark):
    rows = [(1, "a", 9), (2, "a", 3), (3, None, 5), (4, "b", 1), (5, None, 0)]
    df = spark.createDataFrame(rows, "id int, k string, v int").repartition(3)
    assert values(P.dedup_keep_first(df, "k", "id"), "id", "k", "v") == [(1, "a", 9), (3, None, 5), (4, "b", 1)]
    assert values(P.dedup_keep_first(df, "k", "v"), "id") == [(2,), (4,), (5,)]


def test_validator_may_be_a_vectorised_function(spark):
    @F.pandas_udf("boolean")
    def short(text: pd.Series) -> pd.Series:
        return text.str.len() < 3

    df = spark.createDataFrame([("a",), ("abcd",), (None,)], "t string")
    assert [r.t for r in P.drop_invalid(df, short("t")).collect()] == ["a"]
    assert P.rejects(df, short("t")).count() == 2


def test_key_truncation(spark):
    keys = ["InChI=1S/C2H6O/c1-2-3/h3H,2H2,1H3/t5-/m0", "InChI=1S/C2H6O/c1-2-3", "xInChI=1S/C2H6O/c1/h3H", None]
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    assert [r[0] for r in df.select(P.truncate_key("k")).collect()] == ["InChI=1S/C2H6O/c1-2-3/h3H,2H2,1H3", None, None, None]


def test_filter_reaches_the_scan(spark, sf_dir):
    plan = P.above(spark.read.parquet(f"{sf_dir}/events.parquet"), "value").select("event_id")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(value,400.0)" in plan and "ReadSchema: struct<event_id:bigint,value:double>" in plan


def test_float_column_rules(spark):
    rows = [("1", "1.5", "x", None, "2"), ("2", "2", "3.5", None, None)]
    df = spark.createDataFrame(rows, "whole string, real string, broken string, empty string, gappy string").withColumns({"i": F.lit(1), "d": F.lit(1.0)})
    assert P.float_columns(df) == ["real", "empty", "gappy", "d"]


def test_reshaping_back_and_forth(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0), (2, 4.0, None)], "id int, a double, b double")
    long = P.wide_to_long(df, ("id",), ("a", "b"))
    assert long.count() == 4
    assert values(P.long_to_wide(long, ("id",), "stat", "value", ("a", "b")), "id", "a", "b") == [(1, 2.0, 3.0), (2, 4.0, None)]


def test_fill_missing_covers_nan(spark):
    df = spark.createDataFrame([(float("nan"),), (None,), (2.0,)], "a double")
    assert sorted(r.a for r in P.fill_missing(df, ("a",)).collect()) == [0.0, 0.0, 2.0]


def test_scaler_is_population_and_constant_columns_stay_finite(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    params = X.fit_scaler(df, ("a", "b"))
    assert [(r.mean, r.scale) for r in params.orderBy("position").collect()] == [(2.0, 1.0), (5.0, 1.0)]
    assert values(X.apply_scaler(df, ("a", "b"), params), "a", "b") == [(-1.0, 0.0), (1.0, 0.0)]


def test_noise_is_normal_and_repeatable(spark):
    df = spark.range(20000).withColumn("v", F.lit(0.0))
    a = values(X.add_noise(df, "v", "id"), "id", "v")
    assert a == values(X.add_noise(df.repartition(7), "v", "id"), "id", "v")
    noise = np.array([v for _, v in a])
    assert abs(noise.mean()) < 5e-4 and abs(noise.std() - 0.015) < 5e-4


def test_symbol_codes_by_first_appearance(spark):
    df = spark.createDataFrame([(0, "CCl"), (1, "BrCO"), (2, "Siß"), (3, "")], "i int, s string").repartition(3)
    got = {r.i: r.codes for r in X.encode_symbols(df, "s", "i", width=4).collect()}
    assert got == {0: [1, 2, 0, 0], 1: [3, 1, 4, 0], 2: [5, 6, 0, 0], 3: [0, 0, 0, 0]}
    with pytest.raises(PySparkException):
        X.encode_symbols(df, "s", "i", width=1).collect()


def test_node_signatures_and_codes(spark):
    nodes = spark.createDataFrame(
        [(0, 0, "C", 4, 3, 0), (0, 1, "C", 4, 2, 0), (0, 2, "O", 2, 1, 0), (1, 0, "C", 4, 3, 0), (1, 1, "C", 4, 3, 0), (2, 0, "N", 3, 3, 1)],
        "graph_id int, node_id int, label string, degree int, hydrogens int, charge int",
    )
    edges = spark.createDataFrame([(0, 0, 1, 0), (0, 1, 2, 1), (1, 0, 1, 0)], "graph_id int, src int, dst int, bond_no int")
    signed = X.node_signatures(nodes, edges)
    got = {(r.graph_id, r.node_id): (r.signature, r.code, r.n_signatures) for r in X.signature_codes(signed).collect()}
    assert got == {
        (0, 0): ("C-4-3-0_C", 0, 5), (0, 1): ("C-4-2-0_CO", 1, 5), (0, 2): ("O-2-1-0_C", 2, 5),
        (1, 0): ("C-4-3-0_C", 0, 5), (1, 1): ("C-4-3-0_C", 0, 5), (2, 0): ("N-3-3-1_", 3, 5),
    }
    both = [tuple(r) for r in X.symmetrise_edges(edges).orderBy("graph_id", "slot").collect()]
    assert both == [(0, 0, 0, 1), (0, 1, 1, 2), (0, 2, 2, 1), (0, 3, 1, 0), (1, 0, 0, 1), (1, 1, 1, 0)]


def test_histogram_edges(spark):
    df = spark.createDataFrame([(v,) for v in (-1.0, 0.0, 0.5, 1.0, 2.0, 2.5, None)], "x double")
    got = X.histogram(df, "x", (0.0, 1.0, 2.0), normalised=True).orderBy("bin").collect()
    assert [(r.n, r.share) for r in got] == [(2, 2 / 7), (2, 2 / 7)]


def test_assemble_mixes_numbers_and_arrays(spark):
    df = spark.createDataFrame([(1, [2.0, 3.0], 4.5)], "a int, b array<double>, c double")
    assert X.assemble(df, ("a", "b", "c")).first().features == [1.0, 2.0, 3.0, 4.5]


def test_predictions_are_repaired_shifted_and_numbered(spark):
    rows = [(5, "b", 1.0, "[0.5]", 2.0), (6, "a", 2.0, "1.5", 3.0), (7, "b", 3.0, "oops", 4.0)]
    df = spark.createDataFrame(rows, S.prediction_schema(("m", "n"), text_models=("m",)).fieldNames())
    got = values(S.load_predictions(df, ("m", "n"), offset=1.0), "entry_id", "smiles", "values", "m", "n")
    assert got == [(0, "a", 3.0, 2.5, 4.0), (1, "b", 2.0, 1.5, 3.0), (2, "b", 4.0, None, 5.0)]


def test_tables_and_parameters_round_trip(spark, tmp_path):
    df = S.stack_datasets({(0.5, 1.0): spark.range(3), (0.5, 5.0): spark.range(2)})
    S.write_table(df, str(tmp_path / "t"))
    back = S.read_table(spark, str(tmp_path / "t"), fmt="parquet")
    assert back.filter("modified_pct = 5.0").count() == 2 and back.count() == 5
    with pytest.raises(PySparkException):
        S.write_table(df, str(tmp_path / "t"))
    S.save_params(spark, str(tmp_path / "p"), ["a", "b"], [1, 2], [3, 4])
    assert S.load_params(spark, str(tmp_path / "p")) == (["a", "b"], [1.0, 2.0], [3.0, 4.0])
    ids = spark.range(6).withColumnRenamed("id", "entry_id")
    S.save_mask(ids.filter("entry_id > 3"), str(tmp_path / "m"))
    assert values(S.apply_mask(ids, spark, str(tmp_path / "m")), "entry_id") == [(4,), (5,)]


def test_lookup_falls_back_to_a_shuffled_join(spark, monkeypatch):
    rows, facts = spark.range(50).withColumn("k", F.col("id") % 5), spark.range(4).select(F.col("id").alias("k"), (F.col("id") * 10).alias("f"))
    want = values(staging.lookup(rows, facts, ["k"]), "id", "f")
    monkeypatch.setattr(staging, "BROADCAST_BYTES", 400)
    assert not staging.fits_broadcast(facts)
    joined = staging.lookup(rows, facts, ["k"])
    assert "ResolvedHint" not in joined._jdf.queryExecution().analyzed().toString()
    assert values(joined, "id", "f") == want


def test_staged_tables_go_to_the_named_folder_and_can_be_released(spark, monkeypatch):
    monkeypatch.setattr(staging, "_staged", staging.Staged())
    df = staging.stage(spark.range(3))
    assert staging.checkpoint_dir(spark) in df.inputFiles()[0] and df.count() == 3
    assert staging.release(spark) == 1 and staging.release(spark) == 0


@pytest.mark.parametrize("master", ["yarn", "local-cluster[3,2,1000]"])
def test_cluster_needs_a_shared_folder(master):
    class Conf:
        def get(self, name, default):
            return default

    class Session:
        conf = Conf()
        sparkContext = type("Context", (), {"master": master})

    with pytest.raises(RuntimeError):
        staging.checkpoint_dir(Session())


def test_draws_with_repeated_ids_are_refused(spark):
    df = spark.range(1000).select((F.col("id") % 10).alias("entry_id"), F.col("id").cast("double").alias("values"))
    with pytest.raises(Exception, match="ids must be unique"):
        J.sample_exact(df, 5.0).collect()
    with pytest.raises(Exception, match="ids must be unique"):
        J.kfold(df).collect()


def test_stacked_labels_of_any_type(spark):
    a = spark.range(2)
    out = S.stack_datasets({("noisy", 1): a, ("base", 2): a}, ("kind", "part"))
    assert dict(out.dtypes) == {"kind": "string", "part": "double", "id": "bigint"}
    assert sorted({(r["kind"], r["part"]) for r in out.collect()}) == [("base", 2.0), ("noisy", 1.0)]
    with pytest.raises(ValueError):
        S.stack_datasets({("a", 1, 2): a}, ("kind", "part"))


def test_first_row_of_keys_with_nulls(spark):
    from outvote.operators import cleaning

    rows = [("a", None, 3), ("a", None, 1), (None, "a", 2), (None, None, 5), (None, None, 4), ("b", "a", 6)]
    df = spark.createDataFrame(rows, "k string, l string, i int").repartition(3)
    assert sorted(r["i"] for r in cleaning.dedup_keep_first(df, ["k", "l"], "i").collect()) == [1, 2, 4, 6]
    assert sorted(r["i"] for r in cleaning.dedup_keep_first(df, "k", ["l", "i"]).collect()) == [1, 4, 6]


def test_reserved_columns_are_refused(spark):
    from outvote.functions.expr import with_row_stats

    df = spark.createDataFrame([(1, 2.0, 3.0)], "entry_id int, _n double, _draw double")
    with pytest.raises(ValueError, match="reserved"):
        with_row_stats(df, ["entry_id"], "m")
    with pytest.raises(ValueError, match="reserved"):
        J.sample_exact(df, 50.0)


def test_symbols_are_counted_without_a_sort_of_all_characters(spark, monkeypatch):
    staged = []
    monkeypatch.setattr(X, "stage", lambda df: staged.append(df) or df)
    rows = [(3, "ab\U0001f600\n"), (None, "zCl"), (None, "yz"), (1, ""), (2, None), (1, "qa"), (1, "aq ")]
    df = spark.createDataFrame(rows, "i long, s string").repartition(3)
    got = [tuple(r) for r in X.symbol_vocabulary(df, "s", "i", {}).orderBy("code").collect()]
    # Characters of equal first row and place may stand in either order.
    assert [c for _, c in got] == list(range(1, 11))
    at = {s: c for s, c in got}
    assert {s for s, c in got if c <= 4} == set("zyCl") and {at["q"], at["a"]} == {5, 6} and at[" "] == 7
    assert [s for s, c in got if c > 7] == ["b", "\U0001f600", "\n"]
    assert "SortAggregate" not in staged[0]._jdf.queryExecution().executedPlan().toString()


def test_nodes_of_a_graph_are_not_broadcast(spark):
    few = spark.range(4).select(F.explode(F.sequence(F.lit(0), F.lit(1))).alias("graph_id"), F.col("id").alias("node_id"), F.lit("C").alias("label"))
    edges = spark.range(3).select(F.explode(F.sequence(F.lit(0), F.lit(0))).alias("graph_id"), F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    signed = X.node_signatures(few, edges, ("label",))
    keyed = X.signature_keys(few, edges, ("label",))
    coded = X.signature_codes(keyed, key="signature_key")
    texts = X.signature_dictionary(coded, few, edges, ("label",))
    assert {r.signature for r in texts.collect()} == {r.signature for r in signed.collect()} == {"C_", "C_C", "C_CC"}
    for made in (X._neighbours(few, edges, "label", "graph_id", "node_id"), texts):
        assert "SortMergeJoin [graph_id" in (plan := made._jdf.queryExecution().executedPlan().toString()) and "BroadcastHashJoin [graph_id" not in plan


def test_factorization_machines_from_moments_predict_as_spark_does(spark, monkeypatch):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import FMRegressor

    rows = spark.range(400).select(F.col("id").alias("entry_id"), *[((F.col("id") * m) % 97 / 10.0).alias(c) for m, c in ((31, "a"), (57, "b"), (7, "c"))])
    rows = rows.withColumn("values", F.expr("3 * a - b * c + 5"))
    ours = FMRegressor(factorSize=2, maxIter=12, stepSize=0.1, seed=3)
    vectors = VectorAssembler(inputCols=["a", "b", "c"], outputCol="_features")
    params = {ours.featuresCol: "_features", ours.labelCol: "values", ours.predictionCol: "theirs"}
    theirs = ours.fit(vectors.transform(E.kfold(rows, 2).filter("fold <> 1")), params)
    monkeypatch.setattr(FMRegressor, "fit", lambda self, data, params=None: pytest.fail("a scan a step") if data.count() > 1 else type(self).__mro__[1].fit(self, data, params))
    out = E.oof_predict(rows, ("a", "b", "c"), estimators={"factor": ours}, k=2)
    gap = theirs.transform(vectors.transform(out.filter("fold = 1"))).agg(F.max(F.abs(F.col("theirs") - F.col("factor"))).alias("gap"), F.count("*").alias("n")).first()
    assert gap["n"] == 200 and gap["gap"] < 1e-9


@pytest.mark.parametrize("bytes_a_row, most", [(1 << 40, 1), (1, 4)])
def test_no_more_fits_at_once_than_have_room_in_memory(spark, monkeypatch, bytes_a_row, most):
    import threading
    import time

    class Counted(LinearRegression):
        lock, now, seen = threading.Lock(), [], []

        def _fit(self, data):
            with self.lock:
                self.now.append(1)
                self.seen.append(len(self.now))
            time.sleep(0.3)
            try:
                return super()._fit(data)
            finally:
                with self.lock:
                    self.now.pop()

    monkeypatch.setattr(E, "FIT_ROW_BYTES", bytes_a_row)
    rows = spark.range(60).select(F.col("id").alias("entry_id"), F.col("id").cast("double").alias("x"), (F.col("id") * 2.0).alias("values"))
    out = E.oof_predict(rows, ("x",), estimators={"a": Counted(), "b": Counted()}, k=3)
    assert out.count() == 60 and len(Counted.seen) == 6 and min(2, most) <= max(Counted.seen) <= most
