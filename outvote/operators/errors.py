"""Row and pair statistics of prediction errors."""

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..defaults import DATA_OFFSET, DATASET_KEYS, ENTRY_ID, MODELS, REF_VALUE, TOL, VALUE
from ..functions.expr import clean_number, ratio, with_row_stats
from ..plans.staging import stage_bucketed


def dataset_keys(df: DataFrame, keys=None) -> list[str]:
    """The dataset columns of a frame: those given, or the usual ones it has."""
    if keys is not None:
        return list(keys)
    return [k for k in DATASET_KEYS if k in df.columns]


def align_reference(df: DataFrame, ref: DataFrame, value=VALUE, id_col=ENTRY_ID, out=REF_VALUE) -> DataFrame:
    """Adds the reference value of each entry; every row of ``df`` stays, with NULL if unmatched.

    A repeated reference id is an error. The check groups by the join key, so a shuffled
    join reuses its partitioning; a small reference is broadcast by the optimizer.
    """
    return df.join(_once(ref, value, id_col, out), id_col, "left")


def _once(ref, value, id_col, out):
    """Reference value by id, one row each."""
    return ref.groupBy(id_col).agg(
        F.when(F.count("*") > 1, F.raise_error(F.lit("reference ids must be unique")).cast("double"))
        .otherwise(F.first(clean_number(value)))
        .alias(out)
    )


def bucket_by_entry(df: DataFrame, buckets: int, id_col=ENTRY_ID) -> DataFrame:
    """A staged copy in buckets by entry id; prepare entries and reference alike, once, for any number of alignments."""
    return stage_bucketed(df, id_col, buckets)


def align_bucketed(df: DataFrame, ref: DataFrame, value=VALUE, id_col=ENTRY_ID, out=REF_VALUE) -> DataFrame:
    """``align_reference`` of two frames of ``bucket_by_entry`` with equal numbers of buckets: no row is shuffled.

    Both sides are merged bucket by bucket whatever their size, and ``df`` may be filtered before. The check for repeated
    reference ids runs inside the buckets too.
    """
    return df.join(_once(ref, value, id_col, out).hint("merge"), id_col, "left")


def is_modified(value=VALUE, ref=REF_VALUE, tol=TOL) -> Column:
    """Whether a recorded value differs from its reference; false where either is missing."""
    return F.coalesce(F.abs(clean_number(value) - clean_number(ref)) > tol, F.lit(False))


def modified_entries(df: DataFrame, value=VALUE, ref=REF_VALUE) -> DataFrame:
    return df.withColumn("modified", is_modified(value, ref))


def value_diffs(df: DataFrame, value=VALUE, ref=REF_VALUE, out="delta") -> DataFrame:
    return df.withColumn(out, clean_number(value) - clean_number(ref))


def basic_stats(df: DataFrame, models=MODELS, ref=None, value=VALUE, data_offset=DATA_OFFSET) -> DataFrame:
    """Adds centre and spread of the predictions and their distance from ``ref`` (default: own values)."""
    target = clean_number(ref or value)
    df = with_row_stats(df, models, "p_median", "p_mean", "p_std")
    df = df.withColumns({"d_mean_a": F.abs(F.col("p_mean") - target), "d_median_a": F.abs(F.col("p_median") - target)})
    return df.withColumns(
        {
            "d_mean_r": ratio(F.col("d_mean_a"), F.col("p_mean") + F.lit(data_offset)),
            "d_median_r": ratio(F.col("d_median_a"), F.col("p_median") + F.lit(data_offset)),
        }
    )


def model_diffs(df: DataFrame, models=MODELS, ref=None, value=VALUE, data_offset=DATA_OFFSET, carry=()) -> DataFrame:
    """Long table of every model's error per entry, keeping id, dataset and ``carry`` columns."""
    kept = [c for c in (*DATASET_KEYS, ENTRY_ID) if c in df.columns] + list(carry)
    target = clean_number(ref or value)
    wide = with_row_stats(df, models, "_median").select(
        *kept,
        (F.col("_median") + F.lit(data_offset)).alias("_centre"),
        *[(clean_number(m) - target).alias(m) for m in models],
    )
    long = wide.unpivot([*kept, "_centre"], list(models), "model_name", "delta")
    size = F.abs(F.col("delta"))
    return long.select(
        *kept, "model_name", "delta", size.alias("delta_abs"), F.abs(ratio(size, F.col("_centre"))).alias("delta_rel")
    )


def diff_correlations(df: DataFrame, models=MODELS, ref=None, value=VALUE, keys=None) -> DataFrame:
    """Full symmetric matrix, in long form, of Pearson correlations between model errors."""
    keys = dataset_keys(df, keys)
    pairs = _pair_correlations(df, models, ref, value, keys)
    sides = F.array(
        F.struct(F.col("a").alias("model_name"), F.col("b").alias("model_name_2"), "corr"),
        F.struct(F.col("b").alias("model_name"), F.col("a").alias("model_name_2"), "corr"),
    )
    full = F.when(F.col("a") == F.col("b"), F.slice(sides, 1, 1)).otherwise(sides)
    return pairs.select(*keys, F.inline(full))


def correlation_pairs(df: DataFrame, models=MODELS, ref=None, value=VALUE, keys=None) -> DataFrame:
    """One row per unordered pair of different models, labelled ``a; b`` in name order."""
    keys = dataset_keys(df, keys)
    label = F.concat_ws("; ", F.least("a", "b"), F.greatest("a", "b"))
    return (
        _pair_correlations(df, models, ref, value, keys)
        .filter(F.col("a") != F.col("b"))
        .select(*keys, label.alias("pair"), "corr")
    )


def correlation_envelope(df: DataFrame, models=MODELS, ref=None, value=VALUE, keys=None) -> DataFrame:
    """Lowest and highest correlation of each pair over the datasets, to two digits."""
    pairs = correlation_pairs(df, models, ref, value, keys)
    return pairs.groupBy("pair").agg(
        F.bround(F.min("corr"), 2).alias("corr_min"), F.bround(F.max("corr"), 2).alias("corr_max")
    )


def _pair_correlations(df, models, ref, value, keys):
    """One row per dataset and pair a <= b in model order.

    Rows fan out to the pairs of different models and combine again before the shuffle, so that the
    aggregate has few fields and stays in generated code. A model with itself needs its spread only.
    """
    target = clean_number(ref or value)
    models = list(models)
    deltas = df.select(*keys, *[(clean_number(m) - target).alias(f"_d{i}") for i, m in enumerate(models)])
    if keys:
        deltas = deltas.dropna(subset=keys)
    cells = [(i, i) for i in range(len(models))] + list(combinations(range(len(models)), 2))
    pairs = F.array(*[F.struct(F.lit(models[i]).alias("a"), F.lit(models[j]).alias("b"), F.col(f"_d{i}").alias("_x"), F.col(f"_d{j}").alias("_y")) for i, j in cells])
    rows = deltas.select(*keys, F.inline(pairs))
    both = F.col("_x").isNotNull() & F.col("_y").isNotNull()
    rows = rows.withColumns({"_x": F.when(both, F.col("_x")), "_y": F.when(both, F.col("_y"))})
    moments = rows.groupBy(*keys, "a", "b").agg(
        F.covar_pop("_x", "_y").alias("_cov"), F.stddev_pop("_x").alias("_sx"), F.stddev_pop("_y").alias("_sy")
    )
    # The ready-made correlation fails on a constant column; this one gives NULL.
    corr = F.col("_cov") / F.nullif(F.col("_sx") * F.col("_sy"), F.lit(0.0))
    own = F.when(corr.isNotNull(), F.lit(1.0))
    return moments.select(*keys, "a", "b", F.when(F.col("a") == F.col("b"), own).otherwise(corr).alias("corr"))
