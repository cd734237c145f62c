"""Sources and sinks."""

from pyspark.sql import functions as F

from outvote.functions.expr import clean_round
from outvote.operators.features import fit_scaler
from outvote.plans.staging import new_path, written
from outvote.sources import tables as S

from .fixtures import descriptors, predictions, table
from .sqltext import DS, r6, with_preds


def csv_round_trip(spark, sf):
    path = new_path(spark)
    rows = table(spark, sf, "events").select("event_id", "event_type", "value")
    S.write_table(rows, path, fmt="csv")
    written(spark, path)
    return S.read_table(spark, path, "event_id BIGINT, event_type STRING, value DOUBLE")


def delimited_rejects(spark, sf):
    """Events as text: every 11th value cannot be read, every 7th is missing."""
    path = new_path(spark)
    eid = F.col("event_id")
    text = F.when(eid % 11 == 0, F.lit("n/a?")).when(eid % 7 != 0, F.col("value").cast("string"))
    S.write_table(table(spark, sf, "events").select("event_id", "event_type", text.alias("value")), path, fmt="csv")
    written(spark, path)
    good, bad = S.read_with_rejects(spark, path, "event_id BIGINT, event_type STRING, value DOUBLE")
    bad = bad.select(F.split("line", ";")[0].cast("bigint").alias("event_id"), F.lit(None).cast("double").alias("value"), F.lit("rejected").alias("state"))
    state = F.when(F.col("value").isNull(), "missing").otherwise("read")
    return good.select("event_id", "value", state.alias("state")).unionByName(bad)


def parquet_scan(spark, sf):
    rows = S.read_table(spark, f"{sf}/events.parquet", fmt="parquet")
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


def load_predictions(spark, sf):
    rows = table(spark, sf, "events").select(
        F.col("event_id").alias("index"),
        F.concat_ws("-", "event_type", "user_id").alias("smiles"),
        F.col("value").alias("values"),
        F.concat(F.lit("["), F.col("value").cast("string"), F.lit("]")).alias("cnn"),
        (F.col("value") * 2).alias("gnn"),
    )
    return S.load_predictions(rows, ("cnn", "gnn"), offset=1.5)


def partitioned_write(spark, sf):
    path = new_path(spark)
    S.write_table(predictions(spark, sf), path)
    written(spark, path)
    back = S.read_table(spark, path, fmt="parquet")
    return back.groupBy("var_add", "modified_pct").agg(F.count("*").alias("n"), clean_round(F.sum("values"), 2).alias("total"))


def scaler_params_round_trip(spark, sf):
    path = new_path(spark)
    fitted = fit_scaler(descriptors(spark, sf), ("l_quantity", "l_tax")).orderBy("position").collect()
    S.save_params(spark, path, [r["name"] for r in fitted], [r["mean"] for r in fitted], [r["scale"] for r in fitted])
    written(spark, path)
    names, means, scales = S.load_params(spark, path)
    rows = descriptors(spark, sf)
    scaled = [clean_round(F.max((F.col(n) - m) / s), 6).alias(f"max_{n}") for n, m, s in zip(names, means, scales)]
    return rows.agg(*scaled)


def row_mask(spark, sf):
    path = new_path(spark)
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("entry_id"), F.col("o_totalprice").alias("values"))
    S.save_mask(rows.filter("values > 200000"), path)
    written(spark, path)
    return S.apply_mask(rows, spark, path)


def stacked_datasets(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("entry_id"), F.col("o_totalprice").alias("values"))
    return S.stack_datasets({(0.5, 1.0): rows, (2.5, 1.0): rows.withColumn("values", F.col("values") + 2.5)})


def stacked_text_labels(spark, sf):
    """Datasets told apart by names, as those of models and references are."""
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("entry_id"), F.col("o_totalprice").alias("values"))
    half = rows.withColumn("values", F.col("values") / 2)
    return S.stack_datasets({("noisy", 1): rows, ("base", 2): half}, ("ref_type", "part"))


QUERIES = {
    "csv_round_trip": csv_round_trip,
    "delimited_rejects": delimited_rejects,
    "parquet_scan": parquet_scan,
    "load_predictions": load_predictions,
    "partitioned_write": partitioned_write,
    "scaler_params_round_trip": scaler_params_round_trip,
    "row_mask": row_mask,
    "stacked_datasets": stacked_datasets,
    "stacked_text_labels": stacked_text_labels,
}
SQL = {
    "csv_round_trip": "select event_id, event_type, value from events",
    "delimited_rejects": "select event_id, case when event_id % 11 <> 0 and event_id % 7 <> 0 then value end as value, "
    "case when event_id % 11 = 0 then 'rejected' when event_id % 7 = 0 then 'missing' else 'read' end as state from events",
    "parquet_scan": "select event_type, count(*) as n, count(distinct user_id) as users from events group by event_type",
    "load_predictions": """with rows as (select *, event_type || '-' || user_id as smiles from events)
        select row_number() over (order by smiles, event_id) - 1 as entry_id, smiles, value + 1.5::double as "values",
               value + 1.5::double as cnn, value * 2 + 1.5::double as gnn from rows""",
    "partitioned_write": with_preds() + f'select {DS}, count(*) as n, round(sum("values"), 2) + 0.0::double as total from preds group by {DS}',
    "scaler_params_round_trip": "select "
    + ", ".join(r6(f"max(({c} - m_{c}) / s_{c})", f"max_{c}") for c in ("l_quantity", "l_tax"))
    + " from lineitem, (select avg(l_quantity) as m_l_quantity, stddev_pop(l_quantity) as s_l_quantity, avg(l_tax) as m_l_tax, stddev_pop(l_tax) as s_l_tax from lineitem)",
    "row_mask": 'select o_orderkey as entry_id, o_totalprice as "values" from orders where o_totalprice > 200000',
    "stacked_datasets": """select 0.5::double as var_add, 1.0::double as modified_pct, o_orderkey as entry_id, o_totalprice as "values" from orders
        union all select 2.5::double, 1.0::double, o_orderkey, o_totalprice + 2.5::double from orders""",
    "stacked_text_labels": """select 'noisy' as ref_type, 1.0::double as part, o_orderkey as entry_id, o_totalprice as "values" from orders
        union all select 'base', 2.0::double, o_orderkey, o_totalprice / 2 from orders""",
}
