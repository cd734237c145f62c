"""Inputs of the registered queries, derived from the given tables."""

from pyspark.sql import functions as F

from outvote.plans.ranks import at_or_before, rank_cuts

SHIFTS = (10000.0, 50000.0)
RATES = (1.0, 5.0)


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def predictions(spark, sf_dir):
    """Orders as entries with known errors (shift x rate) and five made-up predictions each.

    Orders are dealt out by id, since a file of many rows may be a single split, which one task would read and work on alone.
    """
    eid = F.col("entry_id")
    entries = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("entry_id"), F.col("o_totalprice").alias("y0"))
    drawn = entries.withColumn("_key", (eid * 48271) % 2147483647)
    order = ["_key", "entry_id"]
    cuts = rank_cuts(drawn, order, F.shiftright("_key", 15), lambda n: [F.floor(n * F.lit(r) / 100) for r in RATES])
    grid = F.array(
        *[
            F.struct(F.lit(a).alias("var_add"), F.lit(r).alias("modified_pct"), F.lit(i).alias("_i"))
            for a in SHIFTS
            for i, r in enumerate(RATES)
        ]
    )
    hits = F.array(*[at_or_before(order, F.get("_cuts", i)) for i in range(len(RATES))])
    noise = {
        "cnn": ((eid * 7919) % 1009 - 504) * 10.0,
        "gnn": ((eid * 104729) % 2003 - 1001) * 5.0,
        "fcd": ((eid * 1299709) % 4001 - 2000) * 2.0,
        "fcfp": ((eid * 15485863) % 997 - 498) * 12.0,
        "cb": ((eid * 32452843) % 1499 - 749) * 8.0,
    }
    y0 = F.col("y0")
    drawn = drawn.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "entry_id")
    rows = drawn.withColumn("_cuts", cuts.scalar()).withColumn("_hits", hits).select("entry_id", "y0", "_hits", F.inline(grid))
    shift = F.when(F.get("_hits", F.col("_i")), F.col("var_add")).otherwise(0.0)
    return rows.select(
        "entry_id", "var_add", "modified_pct", y0.alias("ref_values"), (y0 + shift).alias("values"),
        *[(y0 + e).alias(m) for m, e in noise.items()],
    )


PREDICTIONS_SQL = """
ref as (
  select o_orderkey as entry_id, o_totalprice as y0,
         row_number() over (order by (o_orderkey*48271)%2147483647, o_orderkey) as rk,
         count(*) over () as n
  from orders),
grid as (select * from (values (10000.0::double),(50000.0::double)) a(var_add),
                       (values (1.0::double),(5.0::double)) b(modified_pct)),
preds as (
  select entry_id, var_add, modified_pct, y0 as ref_values,
         y0 + case when rk <= floor(n*modified_pct/100) then var_add else 0.0::double end as "values",
         y0 + ((entry_id*7919)%1009-504)*10.0::double as cnn,
         y0 + ((entry_id*104729)%2003-1001)*5.0::double as gnn,
         y0 + ((entry_id*1299709)%4001-2000)*2.0::double as fcd,
         y0 + ((entry_id*15485863)%997-498)*12.0::double as fcfp,
         y0 + ((entry_id*32452843)%1499-749)*8.0::double as cb
  from ref, grid)"""


def entries(spark, sf_dir):
    """Orders as a clean dataset."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("entry_id"), F.col("o_custkey").alias("cust"), F.col("o_totalprice").alias("values")
    )


ENTRIES_SQL = """entries as (select o_orderkey as entry_id, o_custkey as cust, o_totalprice as "values" from orders)"""


def descriptors(spark, sf_dir):
    """Line items as descriptor columns."""
    return table(spark, sf_dir, "lineitem").select("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def graph(spark, sf_dir):
    """Parts and suppliers as nodes, sales as bonds; one graph per supplier nation group, each with all parts."""
    parts = table(spark, sf_dir, "part").select(
        F.explode(F.sequence(F.lit(0), F.lit(4))).alias("graph_id"), F.col("p_partkey").alias("node_id"), F.col("p_type").alias("label"),
        (F.col("p_size") % 5).alias("degree"), (F.col("p_size") % 3).alias("hydrogens"), F.lit(0).alias("charge"),
    )
    suppliers = table(spark, sf_dir, "supplier").select(
        (F.col("s_nationkey") % 5).cast("int").alias("graph_id"), (F.col("s_suppkey") + 100000000).alias("node_id"), F.concat(F.lit("N"), F.col("s_nationkey")).alias("label"),
        (F.col("s_nationkey") % 5).alias("degree"), F.lit(0).alias("hydrogens"), (F.col("s_nationkey") % 2).alias("charge"),
    )
    home = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), (F.col("s_nationkey") % 5).cast("int").alias("graph_id"))
    edges = table(spark, sf_dir, "lineitem").join(home, "l_suppkey").select(
        "graph_id", F.col("l_partkey").alias("src"), (F.col("l_suppkey") + 100000000).alias("dst")
    ).distinct()
    return parts.unionByName(suppliers), edges


GRAPH_SQL = """
nodes as (
  select g::int as graph_id, p_partkey as node_id, p_type as label, p_size % 5 as degree, p_size % 3 as hydrogens, 0 as charge from part, range(5) r(g)
  union all
  select (s_nationkey % 5)::int, s_suppkey + 100000000, 'N' || s_nationkey, s_nationkey % 5, 0, s_nationkey % 2 from supplier),
edges as (select distinct (s_nationkey % 5)::int as graph_id, l_partkey as src, l_suppkey + 100000000 as dst from lineitem join supplier on l_suppkey = s_suppkey)"""
