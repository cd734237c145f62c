"""Repeatable known errors and folds, drawn by hash so that partitioning never matters.

Entries are ordered by md5(id | seed). Sampling k entries means taking the first k of that
order, folds are stretches of it, so one small table of rank cuts (see ``plans.ranks``) makes
every draw a row-local comparison: the rows themselves are not shuffled or sorted.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..defaults import ENTRY_ID, SEED, VALUE
from ..functions.expr import check_free
from ..plans.ranks import at_or_before, distributed_rank, draw_buckets, draw_key, rank_cuts
from ..plans.staging import stage

# The published experiment plans.
RATES = (0.5, 1.0, 2.5, 5.0, 10.0)
SHIFTS_SYNTHETIC = (
    0.001, 0.0025, 0.005, 0.01, 0.025, 0.030, 0.035, 0.040, 0.045, 0.05, 0.055, 0.060, 0.065,
    0.070, 0.075, 0.080, 0.085, 0.090, 0.095, 0.1, 0.125, 0.15, 0.175, 0.2, 0.25,
)
SHIFTS_ENERGY = (
    0.005, 0.0075, 0.01, 0.0125, 0.015, 0.0175, 0.0200, 0.0225, 0.025, 0.05, 0.075, 0.08, 0.1,
    0.125, 0.15, 0.175, 0.2, 0.25,
)
EXTRA_RATES, EXTRA_SHIFTS = (0.15, 0.25), (2.5,)


def sample_size(pct, n):
    return F.floor(F.lit(pct / 100) * n)


def draw_cuts(df: DataFrame, ranks, id_col=ENTRY_ID, seed=SEED):
    """``df`` with its draw key, and the array of order values found at ``ranks(n)``.

    Ids must be unique: with repeated ones no draw has the asked size, so they are an error, found
    while the buckets that hold a wanted rank are counted.
    The one row of cuts is staged: results that are read again do not look for it again.
    """
    check_free(df, "_draw", "_hit", "_cuts", "_hits", "_i")
    keyed = df.withColumn("_draw", draw_key(id_col, seed))
    cuts = rank_cuts(keyed, ["_draw", id_col], draw_buckets(F.col("_draw")), ranks)
    return keyed, stage(cuts).scalar()


def _sampled(df, pct, id_col, seed):
    keyed, cuts = draw_cuts(df, lambda n: [sample_size(pct, n)], id_col, seed)
    return keyed.withColumn("_hit", at_or_before(["_draw", id_col], F.get(cuts, 0)))


def sample_exact(df: DataFrame, pct: float, id_col=ENTRY_ID, seed=SEED) -> DataFrame:
    """floor(pct/100 * n) rows without replacement; the same ones whenever asked."""
    return _sampled(df, pct, id_col, seed).filter("_hit").drop("_draw", "_hit")


def inject_shift(df: DataFrame, pct: float, delta: float, cols=(VALUE,), id_col=ENTRY_ID, seed=SEED) -> DataFrame:
    """Adds ``delta`` to ``cols`` of the sampled rows."""
    rows = _sampled(df, pct, id_col, seed)
    moved = {c: F.when(F.col("_hit"), F.col(c) + F.lit(delta)).otherwise(F.col(c)) for c in cols}
    return rows.withColumns(moved).select(*df.columns)


def inject_shuffle(df: DataFrame, pct: float, cols=(VALUE,), id_col=ENTRY_ID, seed=SEED) -> DataFrame:
    """Sampled rows swap ``cols`` among themselves.

    The i-th sampled row by id receives the values of the i-th drawn row. Only sampled rows
    are ranked and joined; all others pass through.
    """
    rows = _sampled(df, pct, id_col, seed)
    hit = rows.filter("_hit")
    positions = distributed_rank(hit.select(*df.columns), [id_col], "_rank")
    draws = distributed_rank(hit.select("_draw", id_col, *cols), ["_draw", id_col], "_rank")
    given = draws.select("_rank", *[F.col(c).alias(f"_new_{c}") for c in cols])
    swapped = positions.join(given, "_rank").select(
        *[F.col(f"_new_{c}").alias(c) if c in cols else F.col(c) for c in df.columns]
    )
    return rows.filter(~F.col("_hit")).select(*df.columns).unionByName(swapped)


def experiment_grid(
    df: DataFrame, rates=RATES, deltas=SHIFTS_SYNTHETIC, cols=(VALUE,), scale=1.0, id_col=ENTRY_ID, seed=SEED,
) -> DataFrame:
    """All shift datasets (rate x delta) stacked, with ``var_add`` and ``modified_pct`` labels.

    A row is sampled at a rate whatever the delta. ``scale`` multiplies the delta that is
    added, not its label.
    """
    keyed, cuts = draw_cuts(df, lambda n: [sample_size(r, n) for r in rates], id_col, seed)
    hits = F.array(*[at_or_before(["_draw", id_col], F.get("_cuts", i)) for i in range(len(rates))])
    grid = F.array(
        *[
            F.struct(F.lit(float(d)).alias("var_add"), F.lit(float(r)).alias("modified_pct"), F.lit(i).alias("_i"))
            for i, r in enumerate(rates)
            for d in deltas
        ]
    )
    rows = keyed.withColumn("_cuts", cuts).withColumn("_hits", hits).select(*df.columns, "_hits", F.inline(grid))
    step = F.col("var_add") * F.lit(float(scale))
    moved = {c: F.when(F.get("_hits", F.col("_i")), F.col(c) + step).otherwise(F.col(c)) for c in cols}
    return rows.withColumns(moved).select("var_add", "modified_pct", *df.columns)


def kfold(df: DataFrame, k=5, id_col=ENTRY_ID, seed=SEED, balanced=True) -> DataFrame:
    """Adds ``fold`` 0..k-1: stretches of the draw order whose sizes differ by at most one.

    ``balanced=False`` hashes ids to folds in a single pass, with sizes equal on average.
    """
    if not balanced:
        return df.withColumn("fold", F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(k)).cast("int"))

    def ends(n):
        whole, extra = F.floor(n / k), n % k
        return [whole * (f + 1) + F.least(F.lit(f + 1), extra) for f in range(k - 1)]

    keyed, cuts = draw_cuts(df, ends, id_col, seed)
    rows = keyed.withColumn("_cuts", cuts)
    fold = F.lit(0)
    for f in range(k - 1):
        fold = fold + (~at_or_before(["_draw", id_col], F.get("_cuts", f))).cast("int")
    return rows.withColumn("fold", fold).select(*df.columns, "fold")
