"""Metrics of groups, subset sweeps and the comparison with a plain cut."""

from itertools import combinations

from numpy import geomspace
from pyspark.sql import functions as F

from outvote.defaults import DATA_OFFSETS, MODELS, THRESHOLDS, VALUE
from outvote.functions.expr import clean_round
from outvote.operators import metrics as M

from .fixtures import predictions, table
from .sqltext import DS, F1, P, R, errors_cte, marked_ctes, median_of, metrics_ctes, num, q_list, r6, rounded, values_table, with_preds

RATIOS = ("group_ratio", "group_pos_ratio", "precision", "recall", "f1")


def tidy(df, columns=RATIOS):
    return df.withColumns({c: clean_round(c) for c in columns if c in df.columns})


def dataset_totals(spark, sf):
    return M.dataset_totals(predictions(spark, sf), data_offsets=DATA_OFFSETS)


def _metrics(kind, offsets, thresholds=THRESHOLDS):
    return lambda spark, sf: tidy(
        M.classification_metrics(predictions(spark, sf), thresholds=thresholds, data_offsets=offsets, group_stat=kind)
    )


def _metrics_sql(kind, offsets, thresholds=THRESHOLDS, tail=""):
    return (
        with_preds(marked_ctes(thresholds, offsets), metrics_ctes(kind).strip())
        + f"select threshold_pct, {DS}, data_offset, group_no, group_len, group_pos, {rounded()} from metrics{tail}"
    )


def metrics_observed_groups(spark, sf):
    return tidy(M.classification_metrics(predictions(spark, sf), thresholds=(5.0,), complete=False))


def metrics_joined_reference(spark, sf):
    """Known values in a frame of their own, which lacks many entries."""
    known = table(spark, sf, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("entry_id"), F.col("o_totalprice").alias("values"))
    return tidy(M.classification_metrics(predictions(spark, sf).drop("ref_values"), known, thresholds=(1.0, 5.0, 20.0)))


def metrics_top_group(spark, sf):
    return tidy(M.group_slice(M.classification_metrics(predictions(spark, sf), thresholds=THRESHOLDS), len(MODELS)))


def subset_metrics(spark, sf):
    return tidy(M.multi_model_stats(predictions(spark, sf))).drop("combo_no")


def _subset_errors(kind):
    return lambda spark, sf: tidy(M.multi_model_stats(predictions(spark, sf), group_stat=kind)).drop("combo_no")


def _best(criterion):
    def run(spark, sf):
        return tidy(M.best_combo(M.multi_model_stats(predictions(spark, sf)), criterion))

    return run


def subset_curve(spark, sf):
    return tidy(M.multi_model_curve(predictions(spark, sf)))


def quantile_cut(spark, sf):
    out = M.quantile_baseline(predictions(spark, sf))
    return tidy(out.withColumn("threshold", clean_round("threshold", 9)))


def method_comparison(spark, sf):
    out = M.compare_threshold_methods(predictions(spark, sf))
    return tidy(out.withColumn("threshold", clean_round("threshold", 9)))


def shifted_comparison(spark, sf):
    df = predictions(spark, sf)
    moved = df.withColumns({c: F.col(c) + 1.5 for c in (*MODELS, VALUE, "ref_values")})
    return tidy(M.shifted_comparison(df, moved))


def metric_maxima(spark, sf):
    metrics = M.classification_metrics(predictions(spark, sf), thresholds=THRESHOLDS)
    out = M.aggregate_metrics(metrics, ("precision", "recall", "f1"), "max", group_no=len(MODELS))
    return out.withColumn("max", clean_round("max"))


def top_group_ratio(spark, sf):
    metrics = M.classification_metrics(predictions(spark, sf), thresholds=THRESHOLDS)
    return M.group_size_log_ratio(metrics).withColumn("log_ratio", clean_round("log_ratio"))


QUERIES = {
    "dataset_totals": dataset_totals,
    "metrics_absolute": _metrics("abs", (1.5,)),
    "metrics_relative": _metrics("rel", DATA_OFFSETS),
    "metrics_both_errors": _metrics("both", DATA_OFFSETS),
    "metrics_absolute_offsets": _metrics("abs", DATA_OFFSETS, (1.0, 5.0)),
    "metrics_observed_groups": metrics_observed_groups,
    "metrics_top_group": metrics_top_group,
    "metrics_joined_reference": metrics_joined_reference,
    "subset_metrics": subset_metrics,
    "subset_metrics_relative": _subset_errors("rel"),
    "subset_metrics_both": _subset_errors("both"),
    "subset_best_max": _best("max"),
    "subset_best_median": _best("median"),
    "subset_curve": subset_curve,
    "quantile_cut": quantile_cut,
    "method_comparison": method_comparison,
    "shifted_comparison": shifted_comparison,
    "metric_maxima": metric_maxima,
    "top_group_ratio": top_group_ratio,
}

_N = range(len(MODELS))
_SUBSETS = [c for k in range(1, len(MODELS) + 1) for c in combinations(_N, k)]


def _subset_ctes():
    """Top-group metrics of all subsets at 5 %."""
    cut = ", ".join(f"quantile_cont(a{i}, 0.95::double) as q{i}" for i in _N)
    bits = ", ".join(f"a{i} >= q{i} as b{i}" for i in _N)
    branches = [
        f"select {len(c)} as n_models, '{';'.join(MODELS[i] for i in c)}' as model_combo, {no} as combo_no, {DS}, "
        f"count(*) filter ({' and '.join(f'b{i}' for i in c)}) as group_len, "
        f"count(*) filter (modified and {' and '.join(f'b{i}' for i in c)}) as group_pos, "
        f"count(*) filter (modified) as ds_pos, count(*) as ds_len from marked group by {DS}"
        for no, c in enumerate(_SUBSETS)
    ]
    return ",\n".join(
        [
            errors_cte(),
            f"cuts as (select {DS}, {cut} from errs group by {DS})",
            f"marked as (select errs.*, {bits} from errs join cuts using ({DS}))",
            "counts as (" + " union all ".join(branches) + ")",
            f"stats as (select *, group_len / (ds_len + 1e-8::double) as group_ratio, group_pos / (ds_len + 1e-8::double) as group_pos_ratio, "
            f"{P} as precision, {R} as recall, {F1} as f1 from counts)",
        ]
    )


def _subset_errors_sql(kind):
    """The same by errors relative to the median of each subset's own predictions."""
    own = [(j, c, median_of([MODELS[i] for i in c])) for j, c in enumerate(_SUBSETS)]
    shares = ", ".join(f'abs({MODELS[i]} - "values") / ({med} + 1.5::double) as r{j}_{i}' for j, c, med in own for i in c)
    sizes = ", ".join(f'abs({m} - "values") as a{i}' for i, m in enumerate(MODELS))
    names = [f"r{j}_{i}" for j, c, _ in own for i in c] + [f"a{i}" for i in _N]
    cut = ", ".join(f"quantile_cont({n}, 0.95::double) as q{n}" for n in names)

    def test(j, c):
        return " and ".join(f"r{j}_{i} >= qr{j}_{i}" + (f" and a{i} >= qa{i}" if kind == "both" else "") for i in c)

    branches = [
        f"select {len(c)} as n_models, '{';'.join(MODELS[i] for i in c)}' as model_combo, {DS}, count(*) filter ({test(j, c)}) as group_len, "
        f"count(*) filter (modified and {test(j, c)}) as group_pos, count(*) filter (modified) as ds_pos, count(*) as ds_len from marked group by {DS}"
        for j, c, _ in own
    ]
    return with_preds(
        f'errs as (select {DS}, abs("values" - ref_values) > 1e-8 as modified, {sizes}, {shares} from preds)',
        f"cuts as (select {DS}, {cut} from errs group by {DS})",
        f"marked as (select * from errs join cuts using ({DS}))",
        "counts as (" + " union all ".join(branches) + ")",
        f"stats as (select *, group_len / (ds_len + 1e-8::double) as group_ratio, group_pos / (ds_len + 1e-8::double) as group_pos_ratio, "
        f"{P} as precision, {R} as recall, {F1} as f1 from counts)",
    ) + f"select n_models, model_combo, 5.0::double as threshold_pct, {DS}, 1.5::double as data_offset, group_len, group_pos, {rounded()} from stats"


_BEST_MAX = f"best as (select * from stats qualify row_number() over (partition by n_models order by f1 desc, combo_no, {DS}) = 1)"
_BEST_MEDIAN = (
    "mid as (select n_models, median(f1) as middle from stats group by n_models), "
    f"best as (select stats.* from stats join mid using (n_models) qualify row_number() over (partition by n_models order by abs(f1 - middle), combo_no, {DS}) = 1)"
)


def _curve_sql():
    ts = values_table("ts", "i, t", [(str(i + 1), num(t)) for i, t in enumerate(THRESHOLDS)])
    cut = ", ".join(f"quantile_cont(a{i}, {q_list(THRESHOLDS)}) as q{i}" for i in _N)
    has = " and ".join(f"(not list_contains(string_split(model_combo, ';'), '{MODELS[i]}') or a{i} >= q{i}[i])" for i in _N)
    return (
        with_preds(
            _subset_ctes(),
            _BEST_MAX,
            ts,
            f"grid_cuts as (select {DS}, {cut} from errs group by {DS})",
            f"curve as (select best.n_models, best.model_combo, t, {', '.join('errs.' + k for k in DS.split(', '))}, count(*) filter ({has}) as group_len, "
            f"count(*) filter (modified and {has}) as group_pos, count(*) filter (modified) as ds_pos, count(*) as ds_len "
            f"from errs join grid_cuts using ({DS}), ts, best group by all)",
        )
        + f"select n_models, model_combo, t as threshold_pct, {DS}, 1.5::double as data_offset, group_len, group_pos, "
        + f"round(group_len / (ds_len + 1e-8::double), 6) as group_ratio, round(group_pos / (ds_len + 1e-8::double), 6) as group_pos_ratio, "
        + f"round({P}, 6) as precision, round({R}, 6) as recall, round({F1}, 6) as f1 from curve"
    )


def _quantile_ctes():
    steps = M.quantile_thresholds()
    qs = "[" + ", ".join(num(t / 100) for t in steps) + "]"
    return ",\n".join(
        [
            errors_cte(),
            'dist as (select var_add, modified_pct, abs("values" - ref_values) > 1e-8 as modified, '
            'abs(list_sort([cnn, gnn, fcd, fcfp, cb])[3] - "values") as dm from preds)',
            f"qcuts as (select {DS}, quantile_cont(dm, {qs}) as q from dist group by {DS})",
            values_table("qs", "i, t", [(str(i + 1), num(t)) for i, t in enumerate(steps)]),
            f"plain_counts as (select t, {DS}, count(*) filter (dm > q[i]) as group_len, count(*) filter (dm > q[i] and modified) as group_pos, "
            f"count(*) filter (modified) as ds_pos from dist join qcuts using ({DS}), qs group by t, {DS})",
            f"plain as (select t as threshold, {DS}, {P} as precision, {R} as recall, {F1} as f1 from plain_counts where group_len > 0)",
        ]
    )


def _round3():
    return "round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1"


def _comparison_sql():
    steps = [float(t) for t in geomspace(0.0001, 100, 100)]
    qs = q_list(steps)
    cut = ", ".join(f"quantile_cont(a{i}, {qs}) as qa{i}" for i in _N)
    s_a = " and ".join(f"a{i} >= qa{i}[i]" for i in _N)
    return (
        with_preds(
            _quantile_ctes(),
            values_table("ts", "i, t", [(str(i + 1), num(t)) for i, t in enumerate(steps)]),
            f"acuts as (select {DS}, {cut} from errs group by {DS})",
            f"card_counts as (select t, {DS}, count(*) filter ({s_a}) as group_len, count(*) filter (modified and {s_a}) as group_pos, "
            f"count(*) filter (modified) as ds_pos from errs join acuts using ({DS}), ts group by t, {DS})",
            f"card as (select t as threshold, {DS}, {P} as precision, {R} as recall, {F1} as f1 from card_counts)",
        )
        + f"select round(threshold, 9) as threshold, {DS}, {_round3()}, 'Quantile' as method from plain union all "
        + f"select round(threshold, 9), {DS}, {_round3()}, 'Cards' from card"
    )


def _shifted_sql():
    moved = ", ".join(f"{c} + 1.5::double as {c}" for c in MODELS)
    shifted = f'moved as (select entry_id, {DS}, "values" + 1.5::double as "values", ref_values + 1.5::double as ref_values, {moved} from preds)'
    steps = THRESHOLDS
    top = f"select threshold_pct, {DS}, data_offset, group_len, group_pos, {rounded()}, '{{0}}' as df_type from ({{1}}) where group_no = 5"
    orig = "with " + marked_ctes(steps, DATA_OFFSETS) + "," + metrics_ctes("both") + "select * from metrics"
    other = "with " + marked_ctes(steps, [d - 1.5 for d in DATA_OFFSETS], source="moved") + "," + metrics_ctes("both") + (
        f"select threshold_pct, {DS}, data_offset + 1.5::double as data_offset, group_no, group_len, group_pos, group_ratio, group_pos_ratio, precision, recall, f1 from metrics"
    )
    return with_preds(shifted) + top.format("orig", orig) + " union all " + top.format("shifted", other)


def _ratio_sql():
    return (
        with_preds(
            marked_ctes(THRESHOLDS, (1.5,)),
            f"sizes as (select t, {DS}, d, count(*) filter (cards_abs = 5) as top, count(*) filter (cards_abs = 4) as below from marked group by all)",
        )
        + f"select t as threshold_pct, {DS}, d as data_offset, case when top = 0 and below = 0 then null "
        + "when below = 0 then 'inf'::double when top = 0 then '-inf'::double else round(ln(top / below), 6) + 0.0::double end as log_ratio from sizes"
    )


SQL = {
    "dataset_totals": with_preds(errors_cte(), values_table("os", "d", [(num(d),) for d in DATA_OFFSETS]))
    + f"select {DS}, d as data_offset, count(*) filter (modified) as ds_pos, count(*) filter (not modified) as neg_ds, count(*) as ds_len from errs, os group by {DS}, d",
    "metrics_absolute": _metrics_sql("abs", (1.5,)),
    "metrics_relative": _metrics_sql("rel", DATA_OFFSETS),
    "metrics_both_errors": _metrics_sql("both", DATA_OFFSETS),
    "metrics_absolute_offsets": _metrics_sql("abs", DATA_OFFSETS, (1.0, 5.0)),
    "metrics_observed_groups": _metrics_sql("abs", (1.5,), (5.0,), " where group_len > 0"),
    "metrics_joined_reference": with_preds(
        "known as (select o_orderkey as entry_id, o_totalprice as r from orders where o_orderstatus = 'F')",
        "joined as (select * exclude (ref_values, r), r as ref_values from preds left join known using (entry_id))",
        marked_ctes((1.0, 5.0, 20.0), (1.5,), source="joined"),
        metrics_ctes("abs").strip(),
    )
    + f"select threshold_pct, {DS}, data_offset, group_no, group_len, group_pos, {rounded()} from metrics",
    "metrics_top_group": with_preds(marked_ctes(THRESHOLDS, (1.5,)), metrics_ctes("abs").strip())
    + f"select threshold_pct, {DS}, data_offset, group_len, group_pos, {rounded()} from metrics where group_no = 5",
    "subset_metrics": with_preds(_subset_ctes())
    + f"select n_models, model_combo, 5.0::double as threshold_pct, {DS}, 1.5::double as data_offset, group_len, group_pos, {rounded()} from stats",
    "subset_metrics_relative": _subset_errors_sql("rel"),
    "subset_metrics_both": _subset_errors_sql("both"),
    "subset_best_max": with_preds(_subset_ctes(), _BEST_MAX) + "select n_models, model_combo, round(f1, 6) as f1 from best",
    "subset_best_median": with_preds(_subset_ctes(), _BEST_MEDIAN) + "select n_models, model_combo, round(f1, 6) as f1 from best",
    "subset_curve": _curve_sql(),
    "quantile_cut": with_preds(_quantile_ctes()) + f"select round(threshold, 9) as threshold, {DS}, {_round3()} from plain",
    "method_comparison": _comparison_sql(),
    "shifted_comparison": _shifted_sql(),
    "metric_maxima": with_preds(marked_ctes(THRESHOLDS, (1.5,)), metrics_ctes("abs").strip())
    + f"""select {DS}, stat, round(v, 6) as "max" from (unpivot (select {DS}, max(precision) as precision, max(recall) as recall, max(f1) as f1
       from metrics where group_no = 5 group by {DS}) on precision, recall, f1 into name stat value v)""",
    "top_group_ratio": _ratio_sql(),
}
