"""Tables behind the diagnostic figures."""

from pyspark.sql import functions as F

from outvote.defaults import MODELS, THRESHOLDS
from outvote.functions.expr import clean_round
from outvote.operators import reports as T
from outvote.operators.errors import basic_stats

from .fixtures import predictions
from .sqltext import DS, marked_ctes, median_of, num, r6, values_table, with_preds

DELTA_EDGES = (0.0, 10000.0, 20000.0, 30000.0, 40000.0, 50000.0)
BINS = tuple(float(x) for x in range(25000, 500000, 25000))


def injected_deltas(spark, sf):
    return T.injected_deltas(predictions(spark, sf), DELTA_EDGES)


def binned_error_profile(spark, sf):
    out = T.binned_error_profile(predictions(spark, sf), BINS)
    return out.withColumns({c: clean_round(c) for c in ("share", "median_error")})


def error_regression(spark, sf):
    out = T.error_regression(predictions(spark, sf), BINS)
    return out.withColumns({c: clean_round(c, 5) for c in ("slope", "intercept", "r2")})


def regression_p_value(spark, sf):
    """What the p value of a slope follows from, over all entries and over the inner bin medians."""
    out = T.regression_p_values(predictions(spark, sf), BINS).drop("p")
    return out.withColumns({c: clean_round(c, 5) for c in ("slope", "stderr", "t")})


def binned_error_profile_missing(spark, sf):
    """Values that are NULL or NaN stand in the last bin."""
    eid = F.col("entry_id")
    value = F.when(eid % 101 == 0, None).when(eid % 103 == 0, F.lit(float("nan"))).otherwise(F.col("values"))
    out = T.binned_error_profile(predictions(spark, sf).withColumn("values", value), BINS)
    return out.withColumns({c: clean_round(c) for c in ("share", "median_error")})


def model_error_summary(spark, sf):
    rows = predictions(spark, sf).withColumn("original", F.col("ref_values") + 25.0)
    out = T.model_error_summary(rows, "ref_values", "original")
    return out.withColumn("value", clean_round("value", 5))


def _stats(spark, sf, **options):
    return T.group_statistics(predictions(spark, sf), "ref_values", **options)


def group_sizes(spark, sf):
    return T.group_sizes(predictions(spark, sf), "ref_values", groups=range(1, 6))


def group_size_histogram(spark, sf):
    return T.group_size_histogram(T.group_sizes(predictions(spark, sf)))


def group_statistics(spark, sf):
    out = _stats(spark, sf, groups=(3, 4, 5), group_stat="both")
    columns = ("p_median", "p_std", "d_mean_r", "d_median_a", "err_cnn", "err_cb")
    return out.select("entry_id", "var_add", "modified_pct", "group_no", "modified", *[clean_round(c).alias(c) for c in columns])


def last_group_split(spark, sf):
    return T.group_labels(_stats(spark, sf), split_last=True).groupBy("var_add", "modified_pct", "group").agg(F.count("*").alias("n"))


def group_means(spark, sf):
    return T.group_means(_stats(spark, sf), "p_std").withColumn("mean", clean_round("mean"))


def group_aggregates(spark, sf):
    out = T.group_aggregates(_stats(spark, sf, thresholds=(1.0, 5.0)), ("p_std", "d_median_a"), split_modified=True)
    return out.withColumn("value", clean_round("value"))


def group_aggregates_grid(spark, sf):
    out = T.group_aggregates_grid(predictions(spark, sf), "ref_values", columns=("p_std", "d_median_a"), split_modified=True)
    return out.withColumn("value", clean_round("value"))


def clipped_density(spark, sf):
    out = T.clipped_density(_stats(spark, sf), "d_median_a")
    return out.withColumns({"left_edge": clean_round("left_edge"), "density": clean_round("density", 9)})


def distribution_summary(spark, sf):
    out = T.distribution_summary(_stats(spark, sf), ("p_std", "d_median_a"), ("var_add", "modified_pct", "group_no"))
    return out.withColumn("value", clean_round("value"))


def size_annotations(spark, sf):
    return T.size_annotations(_stats(spark, sf), ("var_add", "modified_pct"), split_modified=True)


QUERIES = {
    "injected_deltas": injected_deltas,
    "binned_error_profile": binned_error_profile,
    "error_regression": error_regression,
    "regression_p_value": regression_p_value,
    "binned_error_profile_missing": binned_error_profile_missing,
    "model_error_summary": model_error_summary,
    "group_sizes": group_sizes,
    "group_size_histogram": group_size_histogram,
    "group_statistics": group_statistics,
    "last_group_split": last_group_split,
    "group_means": group_means,
    "group_aggregates": group_aggregates,
    "group_aggregates_grid": group_aggregates_grid,
    "clipped_density": clipped_density,
    "distribution_summary": distribution_summary,
    "size_annotations": size_annotations,
}

_DELTA_BINS = values_table("bins", "bin, left_edge, right_edge", [(str(i), num(a), num(b)) for i, (a, b) in enumerate(zip(DELTA_EDGES, DELTA_EDGES[1:]))])
_NAMES = [min(BINS), *BINS[1:], max(BINS)]
_PROFILE = (
    f'dist as (select *, abs({median_of(MODELS)} - "values") as dm from source), '
    f'binned as (select dm, "values" as v, list_value({", ".join(num(round(x, 3)) for x in _NAMES)})[1 + '
    + " + ".join(f'("values" >= {num(b)})::int' for b in BINS)
    + "] as bin_val from dist), profile as (select bin_val, count(*) as n, count(*) / (select count(*) from binned) as share, quantile_cont(dm, 0.5::double) as median_error from binned group by bin_val)"
)


_INNER = "inner_bins as (select * from profile where bin_val > (select min(bin_val) from profile) and bin_val < (select max(bin_val) from profile))"


def _slope(x, y, label, source):
    slope, dof = f"regr_slope({y}, {x})", f"(regr_count({y}, {x}) - 2)"
    error = f"sqrt((regr_syy({y}, {x}) - {slope} * regr_sxy({y}, {x})) / {dof} / regr_sxx({y}, {x}))"
    return f"select '{label}' as fit, {r6(slope, 'slope', 5)}, {r6(error, 'stderr', 5)}, {r6(f'{slope} / {error}', 't', 5)}, {dof}::bigint as dof from {source}"


def _regr(x, y, label, source):
    return f"select '{label}' as fit, {r6(f'regr_slope({y}, {x})', 'slope', 5)}, {r6(f'regr_intercept({y}, {x})', 'intercept', 5)}, {r6(f'regr_r2({y}, {x})', 'r2', 5)} from {source}"


def _summary_sql():
    parts = []
    for kind, target in (("mod", '"values"'), ("noisy", "ref_values"), ("base", "(ref_values + 25.0::double)")):
        for m in MODELS:
            size = f"abs({m} - {target})"
            for delta_type, e in (("delta_abs", size), ("delta_rel", f"abs({size} / (med + 1.5::double))")):
                parts.append(
                    f"select {DS}, modified, '{kind}' as ref_type, '{m}' as model_name, '{delta_type}' as delta_type, "
                    f"avg({e}) as mean, quantile_cont({e}, 0.5::double) as median from rows group by {DS}, modified"
                )
    return (
        with_preds(
            f'rows as (select *, {median_of(MODELS)} as med, abs("values" - ref_values) > 1e-8 as modified from preds)',
            "sums as (" + " union all ".join(parts) + ")",
        )
        + f"select {DS}, modified, ref_type, model_name, delta_type, 'mean' as agg, {r6('mean', 'value', 5)} from sums "
        + f"union all select {DS}, modified, ref_type, model_name, delta_type, 'median', {r6('median', 'value', 5)} from sums"
    )


def _stats_ctes(thresholds=(5.0,)):
    mean = "(" + " + ".join(MODELS) + ") / 5"
    return (
        marked_ctes(thresholds, (1.5,))
        + f""", centred as (select *, {median_of(MODELS)} as p_median, {mean} as p_mean from preds),
stats as (select c.*, t, modified, cards_abs, cards_both, sqrt(({" + ".join(f"({m} - p_mean) * ({m} - p_mean)" for m in MODELS)}) / 4) as p_std,
  abs(p_median - ref_values) as d_median_a, abs(p_mean - ref_values) / (p_mean + 1.5::double) as d_mean_r
  from centred c join marked using (entry_id, {DS}))"""
    )


_EIGHTHS = "[" + ", ".join(num(q) for q in T.EIGHTHS) + "]"
_DENSITY = (
    "top as (select quantile_cont(d_median_a, 0.99::double) as top from stats), "
    "placed as (select cards_abs, top, case when d_median_a = top then 49 else list_count(list_filter(list_transform(range(51), lambda i: case when i = 50 then top else i * (top / 50) end), lambda e: e <= d_median_a)) - 1 end as bin from stats, top), "
    "counts as (select cards_abs as group_no, bin::int as bin, top, count(*) as n from placed where bin between 0 and 49 group by all)"
)
SQL = {
    "injected_deltas": with_preds(
        _DELTA_BINS, f'deltas as (select {DS}, "values" - ref_values as delta from preds where abs("values" - ref_values) > 1e-8)', f"ds as (select distinct {DS} from deltas)"
    )
    + f"""select ds.var_add, ds.modified_pct, bin, left_edge, right_edge, count(delta) as n from ds cross join bins left join deltas
      on deltas.var_add = ds.var_add and deltas.modified_pct = ds.modified_pct and delta >= left_edge and (delta < right_edge or (delta = right_edge and bin = {len(DELTA_EDGES) - 2}))
      group by all""",
    "binned_error_profile": with_preds("source as (from preds)", _PROFILE) + f"select bin_val, n, {r6('share', 'share')}, {r6('median_error', 'median_error')} from profile",
    "error_regression": with_preds(
        "source as (from preds)", _PROFILE, _INNER
    )
    + _regr("v", "dm", "entries", "binned")
    + " union all "
    + _regr("bin_val", "median_error", "bin_medians", "inner_bins"),
    "regression_p_value": with_preds("source as (from preds)", _PROFILE, _INNER)
    + _slope("v", "dm", "entries", "binned")
    + " union all "
    + _slope("bin_val", "median_error", "bin_medians", "inner_bins"),
    "binned_error_profile_missing": with_preds(
        'source as (select * replace (case when entry_id % 101 = 0 or entry_id % 103 = 0 then null else "values" end as "values") from preds)',
        _PROFILE.replace('("values" >=', """(coalesce("values", 'inf'::double) >="""),
    )
    + f"select bin_val, n, {r6('share', 'share')}, {r6('median_error', 'median_error')} from profile",
    "model_error_summary": _summary_sql(),
    "group_sizes": with_preds(marked_ctes((5.0,), (1.5,)))
    + f"select {DS}, modified, cards_abs as group_no, count(*) as size from marked where cards_abs between 1 and 5 group by all",
    "group_size_histogram": with_preds(marked_ctes((5.0,), (1.5,)))
    + f"""select ds.var_add, ds.modified_pct, g::int as group_no, count(entry_id) as size from (select distinct {DS} from marked) ds cross join range(6) r(g)
      left join marked on marked.var_add = ds.var_add and marked.modified_pct = ds.modified_pct and cards_abs = g group by all""",
    "group_statistics": with_preds(_stats_ctes())
    + f"select entry_id, {DS}, cards_both as group_no, modified, {r6('p_median', 'p_median')}, {r6('p_std', 'p_std')}, {r6('d_mean_r', 'd_mean_r')}, {r6('d_median_a', 'd_median_a')}, "
    + f"{r6('abs(cnn - ref_values)', 'err_cnn')}, {r6('abs(cb - ref_values)', 'err_cb')} from stats where cards_both in (3, 4, 5)",
    "last_group_split": with_preds(marked_ctes((5.0,), (1.5,)))
    + f"select {DS}, case when cards_abs = 5 then '5' || chr(10) || case when modified then 'Mod' else 'Unmod' end else cards_abs::varchar end as \"group\", count(*) as n from marked group by all",
    "group_means": with_preds(_stats_ctes())
    + f"""select {DS}, cards_abs as group_no, case when grouping(modified) = 1 then 'All' when modified then 'Modified' else 'Unmodified' end as type,
      {r6('avg(p_std)', 'mean')}, count(*) as n from stats group by grouping sets (({DS}, cards_abs, modified), ({DS}, cards_abs))""",
    "group_aggregates": with_preds(_stats_ctes((1.0, 5.0)))
    + " union all ".join(
        f"select {DS}, t as threshold_pct, cards_abs as group_no, modified, '{s}' as stat, '{a}' as agg, {r6(e, 'value')} from stats group by {DS}, t, cards_abs, modified"
        for s in ("p_std", "d_median_a")
        for a, e in (("mean", f"avg({s})"), ("median", f"quantile_cont({s}, 0.5::double)"))
    ),
    "group_aggregates_grid": with_preds(_stats_ctes(THRESHOLDS))
    + " union all ".join(
        f"select {DS}, t as threshold_pct, cards_abs as group_no, modified, '{s}' as stat, '{a}' as agg, {r6(e, 'value')} from stats group by {DS}, t, cards_abs, modified"
        for s in ("p_std", "d_median_a")
        for a, e in (("mean", f"avg({s})"), ("median", f"quantile_cont({s}, 0.5::double)"))
    ),
    "clipped_density": with_preds(_stats_ctes(), _DENSITY)
    + f"select group_no, bin, n, {r6('bin * (top / 50)', 'left_edge')}, {r6('n / (sum(n) over (partition by group_no) * (top / 50))', 'density', 9)} from counts",
    "distribution_summary": with_preds(
        _stats_ctes(),
        "wide as ("
        + " union all ".join(f"select {DS}, cards_abs as group_no, count(*) as n, '{s}' as stat, quantile_cont({s}, {_EIGHTHS}) as v from stats group by {DS}, cards_abs" for s in ("p_std", "d_median_a"))
        + ")",
        values_table("qs", "i, q", [(str(i + 1), num(q)) for i, q in enumerate(T.EIGHTHS)]),
    )
    + f"select {DS}, group_no, n, stat, q, {r6('v[i]', 'value')} from wide, qs",
    "size_annotations": with_preds(marked_ctes((5.0,), (1.5,))) + f"select {DS}, cards_abs as group_no, modified, count(*) as n from marked group by all",
}
