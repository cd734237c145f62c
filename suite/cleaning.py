"""Filters, key repair, deduplication, reshaping."""

from pyspark.sql import functions as F

from outvote.operators import cleaning as P
from outvote.operators.cleaning import LAYERED_KEY
from outvote.operators.cards import cards

from .fixtures import predictions, table
from .sqltext import DS, marked_ctes, with_preds


def values_above(spark, sf):
    return P.above(table(spark, sf, "events"), "value").select("event_id", "value")


def filter_counts(spark, sf):
    return P.filter_counts(table(spark, sf, "events"), F.col("value") > 400)


def _valid():
    return F.when(F.col("n_chars") > 500, F.col("lang") == "en")  # short texts: unknown


def valid_rows(spark, sf):
    return P.drop_invalid(table(spark, sf, "documents"), _valid()).select("doc_id", "lang", "n_chars")


def rejected_rows(spark, sf):
    return P.rejects(table(spark, sf, "documents"), _valid()).select("doc_id", "lang", "n_chars")


def truncated_keys(spark, sf):
    number = F.col("p_partkey").cast("string")
    key = F.concat(
        F.when(F.col("p_partkey") % 5 == 0, F.lit("Other=1S/C")).otherwise(F.lit("InChI=1S/C")), number,
        F.lit("H12/c1-2(3,4)"), F.when(F.col("p_partkey") % 3 == 0, F.lit("/t5-,6+")).otherwise(F.lit("/h1-3H,(H,4,5)/t6-/m0/s1")),
    )
    rows = table(spark, sf, "part").select("p_partkey", key.alias("key"))
    return rows.select("p_partkey", P.truncate_key("key").alias("short_key"))


def first_documents(spark, sf):
    return P.dedup_keep_first(table(spark, sf, "documents"), "text", "doc_id").select("doc_id", "lang", "source")


def float_columns(spark, sf):
    rows = table(spark, sf, "part").select(
        "p_partkey", F.col("p_size").cast("string").alias("whole_text"), F.col("p_retailprice").cast("string").alias("real_text"),
        F.when(F.col("p_partkey") % 100 == 1, F.lit("no value")).otherwise(F.col("p_retailprice").cast("string")).alias("broken_text"),
        F.when(F.col("p_size") > 3, F.col("p_size").cast("string")).alias("gappy_text"), "p_size", "p_retailprice",
    )
    return P.keep_float_columns(rows, ("p_partkey",))


def missing_filled(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left")
    return P.fill_missing(rows, ("quality", "toxic"))


def rescaled(spark, sf):
    return P.rescale(table(spark, sf, "events").select("event_id", "value"), ("value",), factor=-0.001, offset=2.0)


def wide_to_long(spark, sf):
    rows = table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").alias("quantity"), F.max("l_extendedprice").alias("price")
    )
    return P.wide_to_long(rows, ("l_returnflag", "l_linestatus"), ("quantity", "price"))


def long_to_wide(spark, sf):
    rows = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return P.long_to_wide(rows, ("user_id",), "event_type", "n", ("click", "view", "error"))


def chosen_groups(spark, sf):
    marked = cards(predictions(spark, sf), kinds=("abs",))
    return P.in_groups(marked, "cards_abs", (4, 5)).select("entry_id", "var_add", "modified_pct", "cards_abs")


QUERIES = {
    "values_above": values_above,
    "filter_counts": filter_counts,
    "valid_rows": valid_rows,
    "rejected_rows": rejected_rows,
    "truncated_keys": truncated_keys,
    "first_documents": first_documents,
    "float_columns": float_columns,
    "missing_filled": missing_filled,
    "rescaled": rescaled,
    "wide_to_long": wide_to_long,
    "long_to_wide": long_to_wide,
    "chosen_groups": chosen_groups,
}
_VALID = "coalesce(case when n_chars > 500 then lang = 'en' end, false)"
SQL = {
    "values_above": "select event_id, value from events where value > 400",
    "filter_counts": "select count(*) as n_before, count(*) filter (value > 400) as n_after from events",
    "valid_rows": f"select doc_id, lang, n_chars from documents where {_VALID}",
    "rejected_rows": f"select doc_id, lang, n_chars from documents where not {_VALID}",
    "truncated_keys": r"""with rows as (select p_partkey, (case when p_partkey % 5 = 0 then 'Other=1S/C' else 'InChI=1S/C' end) || p_partkey || 'H12/c1-2(3,4)'
        || (case when p_partkey % 3 = 0 then '/t5-,6+' else '/h1-3H,(H,4,5)/t6-/m0/s1' end) as key from part)
        select p_partkey, nullif(regexp_extract(key, '""" + LAYERED_KEY + """', 1), '') as short_key from rows""",
    "first_documents": "select doc_id, lang, source from documents qualify row_number() over (partition by text order by doc_id) = 1",
    "float_columns": "select p_partkey, p_retailprice as real_text, case when p_size > 3 then p_size::double end as gappy_text, p_retailprice from part",
    "missing_filled": "select doc_id, coalesce(quality, 0) as quality, coalesce(toxic, 0) as toxic from documents left join labels using (doc_id)",
    "rescaled": "select event_id, value * -0.001::double + 2.0::double as value from events",
    "wide_to_long": """with rows as (select l_returnflag, l_linestatus, sum(l_quantity) as quantity, max(l_extendedprice) as price from lineitem group by all)
        select l_returnflag, l_linestatus, 'quantity' as stat, quantity as value from rows union all select l_returnflag, l_linestatus, 'price', price from rows""",
    "long_to_wide": """select user_id, nullif(count(*) filter (event_type = 'click'), 0) as click, nullif(count(*) filter (event_type = 'view'), 0) as view,
        nullif(count(*) filter (event_type = 'error'), 0) as error from events group by user_id""",
    "chosen_groups": with_preds(marked_ctes((5.0,), (1.5,))) + f"select entry_id, {DS}, cards_abs from marked where cards_abs in (4, 5)",
}
