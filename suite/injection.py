"""Known errors, folds and out-of-fold predictions."""

from pyspark.sql import functions as F

from outvote.defaults import SEED
from outvote.functions.expr import clean_round
from outvote.operators import ensemble as E
from outvote.operators import injection as J

from .fixtures import ENTRIES_SQL, entries, table
from .sqltext import num, r6, values_table


def sample_exact(spark, sf):
    return J.sample_exact(entries(spark, sf), 2.5)


def inject_shift(spark, sf):
    return J.inject_shift(entries(spark, sf), 5.0, 1234.5)


def inject_shuffle(spark, sf):
    return J.inject_shuffle(entries(spark, sf), 10.0)


def inject_shuffle_columns(spark, sf):
    return J.inject_shuffle(entries(spark, sf), 1.0, ("cust", "values"))


def experiment_grid(spark, sf):
    """All 125 shift datasets, summed up per dataset."""
    grid = J.experiment_grid(entries(spark, sf).withColumn("clean", F.col("values")))
    changed = F.count_if(F.col("values") != F.col("clean"))
    return grid.groupBy("var_add", "modified_pct").agg(
        F.count("*").alias("n"), changed.alias("n_modified"), clean_round(F.sum("values"), 0).alias("total")
    )


def experiment_grid_energy(spark, sf):
    """The 90 datasets of the second plan: other shifts, scaled and on two columns."""
    rows = entries(spark, sf).withColumn("second", F.col("values") / 2)
    grid = J.experiment_grid(rows, deltas=J.SHIFTS_ENERGY, cols=("values", "second"), scale=-1000.0)
    return grid.groupBy("var_add", "modified_pct").agg(
        F.count("*").alias("n"), clean_round(F.sum("values"), 0).alias("total"), clean_round(F.sum("second"), 0).alias("total_second")
    )


def kfold(spark, sf):
    return J.kfold(entries(spark, sf)).select("entry_id", "fold")


def _training(spark, sf):
    """Orders with facts summed up from their line items and parts; the label is the order's price."""
    lines = table(spark, sf, "lineitem").join(
        table(spark, sf, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice"),
        F.col("l_partkey") == F.col("p_partkey"),
    )
    return lines.groupBy(F.col("l_orderkey").alias("entry_id")).agg(
        F.sum("l_quantity").alias("quantity"), F.avg("l_discount").alias("discount"), F.avg("p_size").alias("size"),
        F.avg("p_retailprice").alias("retail"), F.count("*").cast("double").alias("lines"), F.sum("l_extendedprice").alias("values"),
    )


FEATURES = ("quantity", "discount", "size", "retail", "lines")


def out_of_fold(spark, sf):
    """Which fold each entry is in and how many models predict it: what SQL can tell of five different models."""
    out = E.oof_predict(_training(spark, sf), FEATURES)
    predicted = sum((F.col(m).isNotNull() & ~F.isnan(m)).cast("int") for m in E.default_estimators())
    return out.select("entry_id", "fold", predicted.alias("n_predictions"))


def out_of_fold_linear(spark, sf):
    """Plain least squares on one feature, which SQL can do fold by fold."""
    out = E.oof_linear(_training(spark, sf), ("quantity",))
    return out.select("entry_id", "fold", clean_round("linear", 4).alias("linear"))


def experiment_grid_extra(spark, sf):
    """The third plan: two small rates, one large shift."""
    grid = J.experiment_grid(entries(spark, sf), rates=J.EXTRA_RATES, deltas=J.EXTRA_SHIFTS)
    return grid.groupBy("var_add", "modified_pct").agg(F.count("*").alias("n"), clean_round(F.sum("values"), 0).alias("total"))


def fold_errors(spark, sf):
    """Fold errors of two closed-form predictors (any prediction columns will do)."""
    rows = J.kfold(entries(spark, sf)).withColumns({"low": F.col("values") * 0.9, "high": F.col("values") + 100.0})
    return E.fold_mae(rows, ("low", "high")).withColumn("mae", clean_round("mae"))


def best_fold(spark, sf):
    rows = J.kfold(entries(spark, sf)).withColumns({"low": F.col("values") * 0.9, "high": F.col("values") * 1.2})
    return E.best_fold(E.fold_mae(rows, ("low", "high"))).withColumn("mae", clean_round("mae"))


QUERIES = {
    "sample_exact": sample_exact,
    "inject_shift": inject_shift,
    "inject_shuffle": inject_shuffle,
    "inject_shuffle_columns": inject_shuffle_columns,
    "experiment_grid": experiment_grid,
    "experiment_grid_energy": experiment_grid_energy,
    "kfold": kfold,
    "fold_errors": fold_errors,
    "best_fold": best_fold,
    "out_of_fold": out_of_fold,
    "out_of_fold_linear": out_of_fold_linear,
    "experiment_grid_extra": experiment_grid_extra,
}

_DRAWN = f"""with {ENTRIES_SQL},
drawn as (select *, row_number() over (order by md5(entry_id::varchar || '|{SEED}'), entry_id) as rk, count(*) over () as n from entries)"""


def _shuffle_sql(pct, cols):
    out = ", ".join(f'coalesce(new_{c.strip(chr(34))}, {c}) as {c}' if c in cols else c for c in ("cust", '"values"'))
    given = ", ".join(f"{c} as new_{c.strip(chr(34))}" for c in cols)
    return (
        _DRAWN
        + f""",
hit as (select *, row_number() over (order by entry_id) as place from drawn where rk <= floor({num(pct / 100)} * n)),
given as (select rk as place, {given} from hit),
swap as (select entry_id as eid, given.* from hit join given using (place))
select entry_id, {out} from entries left join swap on entry_id = eid"""
    )


def _grid_sql(deltas, scale, second, rates=J.RATES, changed=True):
    g = values_table("rates", "r", [(num(r),) for r in rates]), values_table("deltas", "d", [(num(d),) for d in deltas])
    extra = f", round(sum(\"values\" / 2 + case when rk <= floor(r / 100 * n) then d * {num(scale)} else 0 end), 0) as total_second" if second else "" if not changed else ", count(*) filter (rk <= floor(r / 100 * n)) as n_modified"
    return (
        _DRAWN
        + f""", {g[0]}, {g[1]}
select d as var_add, r as modified_pct, count(*) as n, round(sum("values" + case when rk <= floor(r / 100 * n) then d * {num(scale)} else 0 end), 0) as total{extra}
from drawn, rates, deltas group by d, r"""
    )


_FOLDS = (
    _DRAWN
    + """,
ends as (select f, (select count(*) from entries) // 5 * (f + 1) + least(f + 1, (select count(*) from entries) % 5) as last from (values (0), (1), (2), (3)) v(f)),
folds as (select drawn.*, (select count(*) from ends where rk > last)::int as fold from drawn)"""
)

_TRAINING = """training as (
  select l_orderkey as entry_id, sum(l_quantity) as quantity, sum(l_extendedprice) as "values" from lineitem join part on l_partkey = p_partkey group by l_orderkey),
drawn as (select *, row_number() over (order by md5(entry_id::varchar || '|{seed}'), entry_id) as rk, count(*) over () as n from training),
ends as (select f, (select count(*) from training) // 5 * (f + 1) + least(f + 1, (select count(*) from training) % 5) as last from (values (0), (1), (2), (3)) v(f)),
folds as (select drawn.*, (select count(*) from ends where rk > last)::int as fold from drawn)""".format(seed=SEED)

SQL = {
    "out_of_fold": f"with {_TRAINING} select entry_id, fold, 5 as n_predictions from folds",
    "out_of_fold_linear": f"""with {_TRAINING},
      lines as (select f, regr_slope("values", quantity) as a, regr_intercept("values", quantity) as b from folds, range(5) r(f) where fold <> f group by f)
      select entry_id, fold, {r6('a * quantity + b', 'linear', 4)} from folds join lines on fold = f""",
    "experiment_grid_extra": _grid_sql(J.EXTRA_SHIFTS, 1.0, False, J.EXTRA_RATES, False),
    "sample_exact": _DRAWN + f' select entry_id, cust, "values" from drawn where rk <= floor({num(2.5 / 100)} * n)',
    "inject_shift": _DRAWN
    + f' select entry_id, cust, case when rk <= floor({num(5.0 / 100)} * n) then "values" + 1234.5::double else "values" end as "values" from drawn',
    "inject_shuffle": _shuffle_sql(10.0, ['"values"']),
    "inject_shuffle_columns": _shuffle_sql(1.0, ["cust", '"values"']),
    "experiment_grid": _grid_sql(J.SHIFTS_SYNTHETIC, 1.0, False),
    "experiment_grid_energy": _grid_sql(J.SHIFTS_ENERGY, -1000.0, True),
    "kfold": _FOLDS + " select entry_id, fold from folds",
    "fold_errors": _FOLDS
    + f""" select fold, 'low' as model_name, {r6('avg(abs("values" * 0.9::double - "values"))', 'mae')} from folds group by fold
    union all select fold, 'high', {r6('avg(abs("values" + 100.0::double - "values"))', 'mae')} from folds group by fold""",
    "best_fold": _FOLDS
    + f""", maes as (select fold, 'low' as model_name, avg(abs("values" * 0.9::double - "values")) as mae from folds group by fold
    union all select fold, 'high', avg(abs("values" * 1.2::double - "values")) from folds group by fold)
    select model_name, fold, {r6('mae', 'mae')} from maes qualify row_number() over (partition by model_name order by mae, fold) = 1""",
}
