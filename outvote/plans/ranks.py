"""Exact ranks and rank cuts without putting all rows into one task."""

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .staging import stage

_ROW_BITS = 33  # monotonically_increasing_id keeps the row number in its low 33 bits


def running_total(df: DataFrame, order_cols, weight: Column | None = None, name="rank", partitions: int | None = None) -> DataFrame:
    """Adds the running total of ``weight`` (default: the 1-based rank) over a global order.

    Range partitioning and a sort inside each partition give the order; the result is staged
    so that partitions stay put; only one total per partition is brought together. The order
    should be unique: it also decides where partitions may be cut. ``partitions`` is the number of
    ranges, the session's shuffle width by default; give about one per 200 MB of input.
    """
    order = [F.col(c) for c in order_cols]
    sorted_rows = (
        df.withColumn("_w", F.lit(1).cast("long") if weight is None else weight)
        .repartitionByRange(*([partitions] if partitions else []), *order)
        .sortWithinPartitions(*order)
        .withColumn("_at", F.monotonically_increasing_id())
    )
    rows = stage(sorted_rows).withColumn("_part", F.shiftright("_at", _ROW_BITS).cast("int"))
    # One row per partition: bounded by the shuffle width, not by the data.
    over = Window.orderBy("_part")
    starts = rows.groupBy("_part").agg(F.sum("_w").alias("_sum")).select(
        "_part", (F.sum("_sum").over(over) - F.col("_sum")).alias("_start")
    )
    if weight is None:
        inside = F.col("_at").bitwiseAND((1 << _ROW_BITS) - 1) + 1
    else:
        inside = F.sum("_w").over(
            Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
        )
    return (
        rows.withColumn("_inside", inside)
        .join(F.broadcast(starts), "_part")
        .withColumn(name, F.col("_start") + F.col("_inside"))
        .drop("_part", "_at", "_w", "_start", "_inside")
    )


def distributed_rank(df: DataFrame, order_cols, name="rank", partitions: int | None = None) -> DataFrame:
    """Exact global 1..n rank by a unique order."""
    return running_total(df, order_cols, None, name, partitions)


def draw_key(id_col: str, seed: int) -> Column:
    """Repeatable pseudo-random sort key of an entry, the same under any partitioning."""
    return F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f"|{seed}")))


def draw_buckets(key: Column) -> list[Column]:
    """65 536 even buckets in the order of the hash, each cut into as many again."""
    return [F.substring(key, 1, 4), F.substring(key, 1, 8)]


def rank_cuts(df: DataFrame, order_cols, buckets, ranks) -> DataFrame:
    """The order values found at given ranks, as a frame of one row with one array ``cuts``.

    ``buckets`` is a Column, or several from coarse to fine: each maps rows to values that are monotone in
    the order, and those of the next one are apart for different values of the one before and at most some ten
    thousand within it. ``ranks(n)`` gives one Column per slot: the rank wanted of ``n`` rows; rank 0 gives
    a NULL entry. One counting pass a level, each over the few buckets that hold a wanted rank, and one pass over
    the finest of them; no sort of the whole input. Everything is a function of row values, so
    nothing has to be staged. Rows of equal order in such a bucket are an error: no cut between them exists.
    """
    buckets = [buckets] if isinstance(buckets, Column) else list(buckets)
    names = [f"_bucket{i}" for i in range(len(buckets))]
    keyed = df.select(*[b.alias(n) for b, n in zip(buckets, names)], *order_cols)
    counts = keyed.groupBy(names[0]).agg(F.count("*").alias("_n"))
    # One row per bucket, a bounded number of them.
    below = F.sum("_n").over(Window.orderBy(names[0]).rowsBetween(Window.unboundedPreceding, -1))
    n = F.sum("_n").over(Window.partitionBy())
    counts = counts.select(names[0], "_n", F.coalesce(below, F.lit(0)).alias("_below"), n.alias("_total"))
    slots = F.array(*[F.struct(F.lit(i).alias("_slot"), r.cast("long").alias("_nth")) for i, r in enumerate(ranks(F.col("_total")))])
    wanted = _wanted(counts.withColumn("_slots", slots), names[0])
    for last, name in zip(names, names[1:]):
        over = Window.partitionBy(last).orderBy(name).rowsBetween(Window.unboundedPreceding, -1)
        counts = keyed.join(F.broadcast(wanted), last).groupBy(last, name).agg(F.count("*").alias("_n"), F.first("_slots").alias("_slots"))
        wanted = _wanted(counts.withColumn("_below", F.coalesce(F.sum("_n").over(over), F.lit(0))), name)
    fine = names[-1]
    over = Window.partitionBy(fine).orderBy(*order_cols)
    same = reduce(and_, [F.col(c).eqNullSafe(F.lag(c).over(over)) for c in order_cols]) & (F.row_number().over(over) > 1)
    found = (
        keyed.join(F.broadcast(wanted), fine)
        .withColumns({"_place": F.row_number().over(over), "_same": same})
        .withColumn("_same", F.max("_same").over(Window.partitionBy(fine)))
        .select(*order_cols, "_place", "_same", F.explode("_slots").alias("_s"))
        .filter(F.col("_place") == F.col("_s._nth"))
        .select(
            F.when(F.col("_same"), F.raise_error(F.lit("rows of equal order: ids must be unique")).cast("int")).otherwise(F.col("_s._slot")).alias("_slot"),
            F.struct(*order_cols).alias("_cut"),
        )
    )
    width = len(ranks(F.lit(0)))
    by_slot = F.map_from_entries(F.collect_list(F.struct("_slot", "_cut")))
    return found.agg(by_slot.alias("_cuts")).select(
        F.array(*[F.try_element_at("_cuts", F.lit(i)) for i in range(width)]).alias("cuts")
    )


def _wanted(counts, bucket):
    """The buckets that hold a wanted rank, with the ranks counted from the bucket's first row."""
    return (
        counts.select("*", F.explode("_slots").alias("_s"))
        .filter((F.col("_s._nth") > F.col("_below")) & (F.col("_s._nth") <= F.col("_below") + F.col("_n")))
        .select(bucket, F.struct(F.col("_s._slot").alias("_slot"), (F.col("_s._nth") - F.col("_below")).alias("_nth")).alias("_s"))
        .groupBy(bucket)  # at most one row per slot
        .agg(F.collect_list("_s").alias("_slots"))
    )


def at_or_before(order_cols, cut: Column) -> Column:
    """Row order values <= the cut; a NULL cut lies before every row."""
    first, *rest = order_cols
    here = F.col(first) < cut[first]
    if rest:
        here = here | ((F.col(first) == cut[first]) & at_or_before(rest, cut))
    else:
        here = here | (F.col(first) == cut[first])
    return F.coalesce(here, F.lit(False))
