import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from outvote.plans import batches, quantiles
from outvote.plans.levels import count_passed
from outvote.plans.quantiles import exact_quantiles
from outvote.plans.ranks import at_or_before, distributed_rank, draw_buckets, draw_key, rank_cuts, running_total


def frame(spark, n=6000):
    rng = np.random.default_rng(3)
    data = pd.DataFrame(
        {
            "ds": rng.choice([1.0, 2.0, 3.0], n, p=[0.1, 0.2, 0.7]),
            "a": rng.normal(0, 100, n),
            "b": np.where(rng.random(n) < 0.4, 7.0, rng.integers(0, 30, n)).astype(float),
            "c": rng.exponential(3, n),
        }
    )
    return data, spark.createDataFrame(data).repartition(5)


@pytest.mark.parametrize("split, cell", [(1024, 50_000), (1024, 100), (2, 5)])
def test_quantiles_equal_numpy_exactly(spark, monkeypatch, split, cell):
    from outvote.plans import quantiles

    monkeypatch.setattr(quantiles, "SPLIT", split)
    monkeypatch.setattr(quantiles, "CELL", cell)
    data, df = frame(spark, 6000 if split > 2 else 700)
    qs = [0.0, 0.013, 0.05, 0.5, 0.95, 0.999, 1.0]
    got = exact_quantiles(df, ["ds"], ["a", "b", "c"], qs).toPandas().set_index("ds")
    assert len(got) == 3
    for ds, part in data.groupby("ds"):
        for c in "abc":
            assert list(got.loc[ds, c]) == list(np.quantile(part[c], qs))
        assert got.loc[ds, "n_rows"] == len(part)


def test_quantiles_without_keys_and_with_missing(spark):
    data, df = frame(spark)
    df = df.withColumn("a", F.when(F.col("a") > 150, None).when(F.col("a") > 149, float("nan")).otherwise(F.col("a")))
    kept = data["a"][data["a"] <= 149]
    row = exact_quantiles(df, [], ["a", "c"], [0.25, 0.9], "skip").first()
    assert list(row["a"]) == list(np.quantile(kept, [0.25, 0.9]))
    row = exact_quantiles(df, [], ["a", "c"], [0.25, 0.9], "poison").first()
    assert row["a"] is None
    assert list(row["c"]) == list(np.quantile(data["c"], [0.25, 0.9]))
    empty = df.filter("c < 0")
    assert exact_quantiles(empty, [], ["a"], [0.5]).collect() == [(0, None)]
    assert exact_quantiles(empty, ["ds"], ["a"], [0.5]).count() == 0
    nothing = exact_quantiles(df.withColumn("a", F.lit(None).cast("double")), ["ds"], ["a", "c"], [0.5], "skip").first()
    assert nothing["a"] is None and nothing["c"] is not None


def test_quantiles_at_extreme_values(spark):
    values = [0.0, -0.0, 5e-324, -5e-324, 1.7e308, -1.7e308, float("inf"), 1.0, float(np.nextafter(1.0, 2)), 1.0, -1.0, 1e-300]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    qs = [i / (len(values) - 1) for i in range(len(values))]
    got = exact_quantiles(df, [], ["x"], qs).first()["x"]
    assert got == sorted(values)


def test_quantiles_next_to_infinity_are_infinite(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (float("inf"),), (float("inf"),)], "x double")
    assert exact_quantiles(df, [], ["x"], [0.2, 0.4, 2 / 3, 0.9]).first()["x"] == [1.0 + 0.6 * 1, float("inf"), float("inf"), float("inf")]


def test_rank_cuts_refuse_rows_of_equal_order(spark):
    df = spark.range(1000).select((F.col("id") % 10).alias("id")).withColumn("h", draw_key("id", 42))
    with pytest.raises(Exception, match="ids must be unique"):
        rank_cuts(df, ["h", "id"], draw_buckets(F.col("h")), lambda n: [F.floor(n * 0.05)]).collect()


def test_releasing_one_result_leaves_others_readable(spark):
    from outvote.plans.staging import owned, stage

    with owned() as first:
        a = stage(spark.range(5))
    with owned() as second:
        b = stage(spark.range(7))
        with owned() as inner:
            c = stage(spark.range(9))
    assert first.release(spark) == 1 and b.count() == 7
    with pytest.raises(Exception):
        spark.read.parquet(*a.inputFiles()).count()
    assert second.release(spark) == 1 and c.count() == 9 and inner.release(spark) == 1


def test_distributed_rank_and_running_total(spark):
    data, df = frame(spark)
    df = df.withColumn("i", F.monotonically_increasing_id())
    got = distributed_rank(df, ["c", "i"]).toPandas()
    assert list(got.sort_values("c")["rank"]) == list(range(1, len(data) + 1))
    got = running_total(df.withColumn("w", F.lit(2)), ["c", "i"], F.col("w"), "t").toPandas()
    assert list(got.sort_values("c")["t"]) == list(range(2, 2 * len(data) + 1, 2))


def test_rank_cuts(spark):
    df = spark.range(5000).withColumn("h", draw_key("id", 42))
    order = sorted(((r.h, r.id) for r in df.collect()))
    ranks = [0, 1, 17, 2500, 5000]
    cuts = rank_cuts(df, ["h", "id"], draw_buckets(F.col("h")), lambda n: [F.lit(r) for r in ranks]).first().cuts
    assert cuts[0] is None
    assert [(c.h, c.id) for c in cuts[1:]] == [order[r - 1] for r in ranks[1:]]


@pytest.mark.parametrize("width", [1, 2, 15, 99])
@pytest.mark.parametrize("strict", [False, True])
def test_count_passed(spark, width, strict):
    cuts = np.sort(np.random.default_rng(width).integers(0, 40, width)).astype(float)
    df = spark.range(-2, 45).select(F.col("id").cast("double").alias("x"), F.array(*map(F.lit, cuts.tolist())).alias("c"))
    got = count_passed(df, {"k": ("x", "c")}, width, strict).toPandas()
    side = "left" if strict else "right"
    assert list(got["k"]) == list(np.searchsorted(cuts, got["x"], side=side))


@pytest.mark.parametrize("few", [4096, 0])
def test_quantiles_from_batches_and_from_joined_facts(spark, monkeypatch, few):
    """F10-F13, F15: a value that comes in several tasks, values in the thousands and missing ones, by both second passes."""
    from outvote.plans import batches

    monkeypatch.setattr(batches, "FEW", few)
    monkeypatch.setattr(batches, "HELD_VALUES", 50)
    data, df = frame(spark, 3000)
    df = df.withColumn("a", F.when(F.col("a") > 200, None).otherwise(F.col("a"))).withColumn("ds", F.when(F.col("ds") < 3, F.col("ds")))
    qs = [0.05, 0.5, 0.999]
    got = exact_quantiles(df, ["ds"], ["a", "b"], qs, {"a": "skip", "b": "poison"}).toPandas().set_index("ds")
    assert sorted(got.index) == [1.0, 2.0]
    for ds, part in data[data["ds"] < 3].groupby("ds"):
        assert list(got.loc[ds, "a"]) == list(np.quantile(part["a"][part["a"] <= 200], qs))
        assert list(got.loc[ds, "b"]) == list(np.quantile(part["b"], qs))


@pytest.mark.parametrize("models", [["a", "b", "c"], ["a", "b", "c", "d"]])
@pytest.mark.parametrize("kinds", [("abs",), ("rel",), ("abs", "rel"), ("both",)])
def test_batches_make_the_same_errors(spark, models, kinds):
    """errors of numpy equal those of the columns bit for bit, with missing numbers, infinities and zero denominators."""
    from outvote.operators.cards import errors_in_batches, with_errors

    odd = [0.0, -0.0, 1.5, -1.5, 1e-300, 3.0, 0.1, 1e308, float("inf"), float("-inf"), float("nan"), None]
    rng = np.random.default_rng(5)
    rows = [tuple([i, *(odd[k] for k in rng.integers(0, len(odd), 5))]) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, v double, a double, b double, c double, d double").coalesce(1)
    errors, names = with_errors(df, models, "v", [0.0, 1.5], kinds, ["id"])
    shown = errors.toPandas().sort_values("id")
    made, inputs, make = errors_in_batches(df, models, "v", [0.0, 1.5], kinds, ["id"])
    got = make([c.to_numpy(dtype="float64") for _, c in made.toPandas().sort_values("id")[inputs].items()])
    assert len(got) == len(names)
    for name, column in zip(names, got):
        np.testing.assert_array_equal(shown[name].to_numpy(dtype="float64"), column)


@pytest.mark.parametrize("order", ["id", "rand(1)"])
def test_brackets_of_thinned_summaries_hold_their_ranks(spark, monkeypatch, order):
    """Values that come sorted too, in many small summaries; the exact quantiles need no second search."""
    monkeypatch.setattr(batches, "POINTS", 16)
    monkeypatch.setattr(batches, "HELD_VALUES", 100)
    monkeypatch.setattr(batches, "BATCH_ROWS", 40)
    monkeypatch.setattr(quantiles, "_searched", lambda *a: pytest.fail("a rank outside of its bracket"))
    n, qs = 3000, [0.0, 0.013, 0.5, 0.95, 0.999, 1.0]
    rows = spark.range(n, numPartitions=5).select((F.col("id") % 3).alias("_d"), ((F.col("id") * F.col("id")) % 1009).cast("double").alias("x"), "id").orderBy(F.expr(order))
    make = lambda columns: [columns[0], np.where(columns[0] < 5, np.nan, columns[0] * -2.0), np.full(len(columns[0]), np.nan)]
    brackets = {(r["_d"], r["_c"]): r for r in batches.value_brackets(rows, ["x"], make, qs).collect()}
    assert len(brackets) == 9 and all(r["n_rows"] == n // 3 for r in brackets.values())
    got = {p: {r["_d"]: r for r in quantiles.quantiles_in_batches(rows, ["a", "b", "c"], qs, ["x"], make, p).collect()} for p in ("skip", "poison")}
    for d in range(3):
        x = np.array([i * i % 1009 for i in range(d, n, 3)], float)
        for c, values in enumerate([x, -2.0 * x[x >= 5]]):
            want = np.quantile(values, qs)
            assert got["skip"][d][2 + c] == list(want)
            held = brackets[d, c]["_brackets"]
            assert all(b["a"] <= w <= b["b"] for b, w in zip(held, want)) and held[2]["b"] - held[2]["a"] < np.ptp(values)
        assert got["poison"][d]["a"] == got["skip"][d]["a"] and got["poison"][d]["b"] is None and got["skip"][d]["c"] is None
