"""Pieces of SQL text shared by the twins."""

from outvote.defaults import MODELS

from .fixtures import PREDICTIONS_SQL

DS = "var_add, modified_pct"


def num(x):
    return f"{float(x)!r}::double"


def r6(expr, name, digits=6):
    return f"round({expr}, {digits}) + 0.0::double as {name}"


def values_table(name, cols, rows):
    body = ", ".join("(" + ", ".join(r) + ")" for r in rows)
    return f"{name} as (select * from (values {body}) v({cols}))"


def q_list(thresholds):
    return "[" + ", ".join(num((100 - float(t)) / 100.0) for t in thresholds) + "]"


def median_of(models):
    s = "list_sort([" + ", ".join(models) + "])"
    n = len(models)
    return f"{s}[{n // 2 + 1}]" if n % 2 else f"({s}[{n // 2}] + {s}[{n // 2 + 1}]) / 2"


def errors_cte(models=MODELS, source="preds"):
    cols = ", ".join(f'abs({m} - "values") as a{i}' for i, m in enumerate(models))
    return (
        f'errs as (select entry_id, {DS}, abs("values" - ref_values) > 1e-8 as modified, '
        f"{median_of(models)} as med, {cols} from {source})"
    )


def marked_ctes(thresholds, offsets, models=MODELS, source="preds"):
    """CTEs up to ``marked``: every row per threshold and offset with its counts by kind."""
    n = range(len(models))
    ts = values_table("ts", "i, t", [(str(i + 1), num(t)) for i, t in enumerate(thresholds)])
    os = values_table("os", "j, d", [(str(j), num(d)) for j, d in enumerate(offsets)])
    rel = "rel as (select e.*, j, d, " + ", ".join(f"a{i} / (med + d) as r{i}" for i in n) + " from errs e, os)"
    cut = ", ".join(f"quantile_cont(a{i}, {q_list(thresholds)}) as qa{i}, quantile_cont(r{i}, {q_list(thresholds)}) as qr{i}" for i in n)
    cuts = f"cuts as (select {DS}, j, {cut} from rel group by {DS}, j)"
    s_a = " + ".join(f"(a{i} >= qa{i}[i])::int" for i in n)
    s_r = " + ".join(f"(r{i} >= qr{i}[i])::int" for i in n)
    s_b = " + ".join(f"(a{i} >= qa{i}[i] and r{i} >= qr{i}[i])::int" for i in n)
    marked = (
        f"marked as (select entry_id, rel.var_add, rel.modified_pct, t, d, modified, {s_a} as cards_abs, {s_r} as cards_rel, {s_b} as cards_both "
        f"from rel join cuts using ({DS}, j), ts)"
    )
    return ",\n".join([errors_cte(models, source), ts, os, rel, cuts, marked])


P = "(group_pos / (group_len + 1e-8::double))"
R = "(group_pos / (ds_pos + 1e-8::double))"
F1 = f"((2 * {P} * {R}) / ({P} + {R} + 1e-8::double))"


def metrics_ctes(kind="abs"):
    """CTEs from ``marked`` to ``metrics`` (complete over the values seen)."""
    return f"""
grp as (select t, {DS}, d, cards_{kind} as g, count(*) as group_len, sum(modified::int)::bigint as group_pos from marked group by all),
tot as (select {DS}, sum(modified::int)::bigint as ds_pos, count(*) as ds_len from errs group by all),
dom as (select * from (select distinct t from grp), (select distinct var_add from grp), (select distinct modified_pct from grp),
        (select distinct d from grp), (select distinct g from grp)),
full_grp as (select dom.*, coalesce(group_len, 0) as group_len, coalesce(group_pos, 0) as group_pos, ds_pos, ds_len
        from dom left join grp using (t, {DS}, d, g) left join tot using ({DS})),
metrics as (select t as threshold_pct, {DS}, d as data_offset, g as group_no, group_len, group_pos,
        coalesce(group_len / (ds_len + 1e-8::double), 0) as group_ratio, coalesce(group_pos / (ds_len + 1e-8::double), 0) as group_pos_ratio,
        {P} as precision, coalesce({R}, 0) as recall, coalesce({F1}, 0) as f1 from full_grp)"""


def rounded(metrics=("group_ratio", "group_pos_ratio", "precision", "recall", "f1")):
    return ", ".join(r6(m, m) for m in metrics)


def with_preds(*ctes):
    return "with " + ",\n".join([PREDICTIONS_SQL.strip(), *ctes]) + "\n"
