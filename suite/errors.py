"""Row and pair statistics."""

from itertools import combinations

from pyspark.sql import functions as F

from outvote.defaults import MODELS
from outvote.functions.expr import clean_round
from outvote.operators import errors as R

from .fixtures import predictions, table
from .sqltext import DS, median_of, r6, with_preds

KEYS = ["entry_id", "var_add", "modified_pct"]


def _fixed_entries(spark, sf):
    """Values of the fulfilled orders as reference."""
    return table(spark, sf, "orders").filter("o_orderstatus = 'F'").select(
        F.col("o_orderkey").alias("entry_id"), F.col("o_totalprice").alias("values")
    )


def aligned_reference(spark, sf):
    return R.align_reference(predictions(spark, sf).drop("ref_values"), _fixed_entries(spark, sf)).select(*KEYS, "ref_values")


def aligned_reference_bucketed(spark, sf):
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows, ref = (R.bucket_by_entry(df, buckets) for df in (predictions(spark, sf).drop("ref_values"), _fixed_entries(spark, sf)))
    return R.align_bucketed(rows, ref).select(*KEYS, "ref_values")


def modified_entries(spark, sf):
    return R.modified_entries(predictions(spark, sf)).select(*KEYS, "modified")


def value_diffs(spark, sf):
    return R.value_diffs(predictions(spark, sf)).select(*KEYS, clean_round("delta").alias("delta"))


STATS = ("p_median", "p_mean", "p_std", "d_mean_a", "d_mean_r", "d_median_a", "d_median_r")


def _basic(ref):
    def run(spark, sf):
        out = R.basic_stats(predictions(spark, sf), ref=ref)
        return out.select(*KEYS, *[clean_round(s).alias(s) for s in STATS])

    return run


def model_diffs(spark, sf):
    out = R.model_diffs(predictions(spark, sf), ref="ref_values")
    return out.withColumns({c: clean_round(c) for c in ("delta", "delta_abs", "delta_rel")})


def _corr(make):
    return lambda spark, sf: make(predictions(spark, sf)).withColumn("corr", clean_round("corr"))


def correlation_envelope(spark, sf):
    return R.correlation_envelope(predictions(spark, sf))


QUERIES = {
    "aligned_reference": aligned_reference,
    "aligned_reference_bucketed": aligned_reference_bucketed,
    "modified_entries": modified_entries,
    "value_diffs": value_diffs,
    "basic_stats": _basic(None),
    "basic_stats_reference": _basic("ref_values"),
    "model_diffs": model_diffs,
    "error_correlations": _corr(R.diff_correlations),
    "error_correlations_global": _corr(lambda df: R.diff_correlations(df, keys=())),
    "correlation_pairs": _corr(R.correlation_pairs),
    "correlation_envelope": correlation_envelope,
}


def _basic_sql(ref):
    mean = "(" + " + ".join(MODELS) + ") / 5"
    std = "sqrt((" + " + ".join(f"({m} - p_mean) * ({m} - p_mean)" for m in MODELS) + ") / 4)"
    return (
        with_preds(f"rows as (select *, {median_of(MODELS)} as p_median, {mean} as p_mean from preds)")
        + f"select entry_id, {DS}, {r6('p_median', 'p_median')}, {r6('p_mean', 'p_mean')}, {r6(std, 'p_std')}, "
        + f"{r6(f'abs(p_mean - {ref})', 'd_mean_a')}, {r6(f'abs(p_mean - {ref}) / (p_mean + 1.5::double)', 'd_mean_r')}, "
        + f"{r6(f'abs(p_median - {ref})', 'd_median_a')}, {r6(f'abs(p_median - {ref}) / (p_median + 1.5::double)', 'd_median_r')} from rows"
    )


def _diffs_sql():
    parts = [f"select entry_id, {DS}, '{m}' as model_name, {m} - ref_values as delta, {median_of(MODELS)} as med from preds" for m in MODELS]
    return with_preds("rows as (" + " union all ".join(parts) + ")") + (
        f"select entry_id, {DS}, model_name, {r6('delta', 'delta')}, {r6('abs(delta)', 'delta_abs')}, "
        f"{r6('abs(abs(delta) / (med + 1.5::double))', 'delta_rel')} from rows"
    )


def _corr_sql(keys):
    ids = f"{keys}, " if keys else ""
    group = f" group by {keys}" if keys else ""
    parts = [f"select {ids}'{a}' as model_name, '{b}' as model_name_2, corr({a} - \"values\", {b} - \"values\") as c from preds{group}" for a in MODELS for b in MODELS]
    return with_preds("rows as (" + " union all ".join(parts) + ")") + f"select {ids}model_name, model_name_2, {r6('c', 'corr')} from rows"


def _pairs_cte():
    pairs = [tuple(sorted(p)) for p in combinations(MODELS, 2)]
    parts = [f"select {DS}, '{a}; {b}' as pair, corr({a} - \"values\", {b} - \"values\") as c from preds group by {DS}" for a, b in pairs]
    return "rows as (" + " union all ".join(parts) + ")"


SQL = {
    "aligned_reference": with_preds("kept as (select o_orderkey as entry_id, o_totalprice as r from orders where o_orderstatus = 'F')")
    + f"select entry_id, {DS}, r as ref_values from preds left join kept using (entry_id)",
    "modified_entries": with_preds() + f'select entry_id, {DS}, abs("values" - ref_values) > 1e-8 as modified from preds',
    "value_diffs": with_preds() + f"select entry_id, {DS}, " + r6('"values" - ref_values', "delta") + " from preds",
    "basic_stats": _basic_sql('"values"'),
    "basic_stats_reference": _basic_sql("ref_values"),
    "model_diffs": _diffs_sql(),
    "error_correlations": _corr_sql(DS),
    "error_correlations_global": _corr_sql(""),
    "correlation_pairs": with_preds(_pairs_cte()) + f"select {DS}, pair, {r6('c', 'corr')} from rows",
    "correlation_envelope": with_preds(_pairs_cte())
    + "select pair, round_even(min(c), 2) as corr_min, round_even(max(c), 2) as corr_max from rows group by pair",
}
SQL["aligned_reference_bucketed"] = SQL["aligned_reference"]
