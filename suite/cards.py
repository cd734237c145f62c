"""Cutoffs, marks per entry and flagged entries."""

from pyspark.sql import functions as F

from outvote.defaults import DATA_OFFSETS, MODELS, THRESHOLDS
from outvote.functions.expr import clean_round
from outvote.operators import cards as C

from .fixtures import predictions
from .sqltext import DS, errors_cte, marked_ctes, num, q_list, r6, values_table, with_preds


def card_cutoffs(spark, sf):
    out = C.cutoffs(predictions(spark, sf), thresholds=THRESHOLDS, data_offsets=DATA_OFFSETS)
    return out.withColumn("cutoff", clean_round("cutoff"))


def _cutoffs_sql():
    def branch(kind, m, i, offset, error):
        return (
            f"select {DS}, '{kind}' as kind, {offset} as data_offset, '{m}' as model_name, "
            f"quantile_cont({error}, {q_list(THRESHOLDS)}) as q from errs group by {DS}"
        )

    parts = [branch("abs", m, i, "null::double", f"a{i}") for i, m in enumerate(MODELS)]
    parts += [branch("rel", m, i, num(d), f"a{i} / (med + {num(d)})") for i, m in enumerate(MODELS) for d in DATA_OFFSETS]
    ts = values_table("ts", "i, t", [(str(i + 1), num(t)) for i, t in enumerate(THRESHOLDS)])
    return (
        with_preds(errors_cte(), "cuts as (" + " union all ".join(parts) + ")", ts)
        + f"select {DS}, kind, data_offset, model_name, t as threshold_pct, {r6('q[i]', 'cutoff')} from cuts, ts"
    )


def _marks(kind):
    def run(spark, sf):
        out = C.cards(predictions(spark, sf), thresholds=(1.0, 5.0, 20.0), data_offsets=DATA_OFFSETS, kinds=(kind,))
        return out.select("entry_id", "var_add", "modified_pct", "threshold_pct", "data_offset", f"cards_{kind}")

    return run


def _marks_sql(kind):
    return with_preds(marked_ctes((1.0, 5.0, 20.0), DATA_OFFSETS)) + (
        f"select entry_id, {DS}, t as threshold_pct, d as data_offset, cards_{kind} from marked"
    )


def cards_grid(spark, sf):
    """All thresholds and offsets, summed up per dataset and count of marks."""
    out = C.cards(predictions(spark, sf), thresholds=THRESHOLDS, data_offsets=DATA_OFFSETS)
    ids = ["var_add", "modified_pct", "threshold_pct", "data_offset", "cards_abs", "cards_rel", "cards_both", "cards_norm"]
    return out.groupBy(*ids).agg(F.count("*").alias("n"))


def flagged_entries(spark, sf):
    return C.flag_errors(predictions(spark, sf)).select("entry_id", "var_add", "modified_pct", "values")


def cards_zero_denominator(spark, sf):
    """Every 40th entry has predictions of minus the offset: a zero denominator, which ranks highest."""
    gone = F.col("entry_id") % 40 == 0
    df = predictions(spark, sf).withColumns({m: F.when(gone, -1.5).otherwise(F.col(m)) for m in MODELS})
    out = C.cards(df, thresholds=(1.0, 2.0, 4.0, 20.0), data_offsets=(1.5,), kinds=("rel", "both"))
    return out.select("entry_id", "var_add", "modified_pct", "threshold_pct", "cards_rel", "cards_both")


def _missing(policy):
    """Two models lack predictions, one as NULL and one as NaN."""

    def run(spark, sf):
        df = predictions(spark, sf)
        df = df.withColumn("cnn", F.when(F.col("entry_id") % 97 == 0, None).otherwise(F.col("cnn")))
        df = df.withColumn("fcd", F.when(F.col("entry_id") % 89 == 0, F.lit(float("nan"))).otherwise(F.col("fcd")))
        out = C.cards(df, thresholds=(1.0, 5.0), kinds=("abs",), null_policy=policy)
        return out.select("entry_id", "var_add", "modified_pct", "threshold_pct", "cards_abs")

    return run


def cards_four_models(spark, sf):
    """An even number of models: the centre is the mean of the two middle predictions."""
    out = C.cards(predictions(spark, sf), MODELS[:4], thresholds=(1.0, 5.0), data_offsets=DATA_OFFSETS)
    return out.select("entry_id", "var_add", "modified_pct", "threshold_pct", "data_offset", "cards_abs", "cards_rel", "cards_both")


def cards_no_dataset(spark, sf):
    """A frame without dataset columns is one dataset."""
    df = predictions(spark, sf).drop("var_add", "modified_pct")
    return C.cards(df, thresholds=(1.0, 5.0), kinds=("abs",)).select("entry_id", "values", "threshold_pct", "cards_abs")


QUERIES = {
    "card_cutoffs": card_cutoffs,
    "cards_absolute": _marks("abs"),
    "cards_relative": _marks("rel"),
    "cards_both_errors": _marks("both"),
    "cards_grid": cards_grid,
    "flagged_entries": flagged_entries,
    "cards_zero_denominator": cards_zero_denominator,
    "cards_missing_predictions": _missing("poison"),
    "cards_missing_predictions_skipped": _missing("skip"),
    "cards_four_models": cards_four_models,
    "cards_no_dataset": cards_no_dataset,
}


def _cut_sql(values, q):
    """Interpolated quantile of a sorted list; next to infinity it is infinite."""
    at = f"((len({values}) - 1) * {q})"
    low, high, w = f"{values}[1 + floor({at})::int]", f"{values}[least(len({values}), 2 + floor({at})::int)]", f"({at} - floor({at}))"
    return (
        f"case when {w} = 0 or {low} = {high} then {low} when isinf({high}) then {high} when isinf({low}) then {low} "
        f"when {w} < 0.5 then {low} + ({high} - {low}) * {w} else {high} - ({high} - {low}) * (1 - {w}) end"
    )


def _zero_denominator_sql():
    n = range(len(MODELS))
    gone = ", ".join(f"case when entry_id % 40 = 0 then -1.5::double else {m} end as {m}" for m in MODELS)
    ratio = ", ".join(f"case when med + 1.5::double = 0 then (case when a{i} <> 0 then 'inf'::double end) else a{i} / (med + 1.5::double) end as r{i}" for i in n)
    lists = ", ".join(f"list_sort(list(a{i})) as la{i}, list_sort(list(r{i})) as lr{i}" for i in n)
    cut = ", ".join(f"{_cut_sql(f'la{i}', 'q')} as ca{i}, {_cut_sql(f'lr{i}', 'q')} as cr{i}" for i in n)
    rel = " + ".join(f"(r{i} >= cr{i})::int" for i in n)
    both = " + ".join(f"(a{i} >= ca{i} and r{i} >= cr{i})::int" for i in n)
    return (
        with_preds(
            f"moved as (select * replace ({gone}) from preds)",
            errors_cte(source="moved"),
            f"rel as (select *, {ratio} from errs)",
            values_table("ts", "t, q", [(num(t), num((100 - t) / 100.0)) for t in (1.0, 2.0, 4.0, 20.0)]),
            f"lists as (select {DS}, {lists} from rel group by {DS})",
            f"cuts as (select {DS}, t, {cut} from lists, ts)",
        )
        + f"select entry_id, {DS}, t as threshold_pct, {rel} as cards_rel, {both} as cards_both from rel join cuts using ({DS})"
    )


def _missing_sql(poison):
    gone = 'case when entry_id % 97 = 0 then null else cnn end as cnn, case when entry_id % 89 = 0 then null else fcd end as fcd'
    n = range(len(MODELS))
    whole = lambda i: f"count(a{i}) = count(*)" if poison else "true"
    cut = ", ".join(f"case when {whole(i)} then quantile_cont(a{i}, {q_list((1.0, 5.0))}) end as q{i}" for i in n)
    marks = " + ".join(f"coalesce(a{i} >= q{i}[i], false)::int" for i in n)
    return (
        with_preds(
            f"moved as (select * replace ({gone}) from preds)",
            errors_cte(source="moved"),
            values_table("ts", "i, t", [("1", num(1)), ("2", num(5))]),
            f"cuts as (select {DS}, {cut} from errs group by {DS})",
        )
        + f"select entry_id, {DS}, t as threshold_pct, {marks} as cards_abs from errs join cuts using ({DS}), ts"
    )


def _no_dataset_sql():
    n = range(len(MODELS))
    sizes = ", ".join(f'abs({m} - "values") as a{i}' for i, m in enumerate(MODELS))
    cut = ", ".join(f"quantile_cont(a{i}, {q_list((1.0, 5.0))}) as q{i}" for i in n)
    marks = " + ".join(f"(a{i} >= q{i}[i])::int" for i in n)
    return (
        with_preds(
            f'errs as (select entry_id, "values", {sizes} from preds)',
            f"cuts as (select {cut} from errs)",
            values_table("ts", "i, t", [("1", num(1)), ("2", num(5))]),
        )
        + f'select entry_id, "values", t as threshold_pct, {marks} as cards_abs from errs, cuts, ts'
    )


SQL = {
    "card_cutoffs": _cutoffs_sql(),
    "cards_zero_denominator": _zero_denominator_sql(),
    "cards_missing_predictions": _missing_sql(True),
    "cards_missing_predictions_skipped": _missing_sql(False),
    "cards_four_models": with_preds(marked_ctes((1.0, 5.0), DATA_OFFSETS, MODELS[:4]))
    + f"select entry_id, {DS}, t as threshold_pct, d as data_offset, cards_abs, cards_rel, cards_both from marked",
    "cards_no_dataset": _no_dataset_sql(),
    "cards_absolute": _marks_sql("abs"),
    "cards_relative": _marks_sql("rel"),
    "cards_both_errors": _marks_sql("both"),
    "cards_grid": with_preds(marked_ctes(THRESHOLDS, DATA_OFFSETS))
    + f"select {DS}, t as threshold_pct, d as data_offset, cards_abs, cards_rel, cards_both, 0 as cards_norm, count(*) as n from marked group by all",
    "flagged_entries": with_preds(marked_ctes((5.0,), (1.5,)))
    + 'select entry_id, var_add, modified_pct, "values" from preds join (select entry_id, var_add, modified_pct from marked where cards_abs = 5) using (entry_id, var_add, modified_pct)',
}
