"""Column expressions that stay inside generated code: no UDF, no lambda."""

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def check_free(df, *names):
    """Columns that a step adds for itself must not be there already; they would be overwritten."""
    taken = sorted(set(names) & set(df.columns))
    if taken:
        raise ValueError(f"columns {taken} are reserved for helpers; rename them")


def own_method(df):
    """The same rows through a one-row generator: Spark then compiles what stands before and behind it as methods of their own.

    The JVM never optimises a method of more than 8000 bytes of byte code, which some dozen columns of long expressions reach.
    """
    check_free(df, "_once")
    return df.select("*", F.explode(F.array(F.lit(0))).alias("_once")).drop("_once")


def total(columns):
    return reduce(add, columns)


def clean_number(col):
    """NaN and NULL are one thing here: a missing number."""
    col = F.col(col) if isinstance(col, str) else col
    return F.nanvl(col.cast("double"), F.lit(None).cast("double"))


def ratio(num: Column, den: Column) -> Column:
    """num / den where a zero denominator ranks highest and 0/0 is missing."""
    return F.when(den == 0, F.when(num != 0, F.lit(INF))).otherwise(num / F.nullif(den, F.lit(0.0)))


def row_count(columns):
    return total([c.isNotNull().cast("int") for c in columns])


def with_row_stats(df, columns, median=None, mean=None, std=None):
    """Adds median, mean and sample deviation over columns of one row, skipping missing ones.

    Shared parts are columns of their own, so that they are computed once per row however
    often they are used.
    """
    check_free(df, "_n", "_sorted", "_mean")
    columns = [clean_number(c) for c in columns]
    width, n, kept = len(columns), F.col("_n"), df.columns
    df = df.withColumn("_n", row_count(columns))
    if median:
        df = df.withColumn("_sorted", F.sort_array(F.array(*columns)))  # missing ones come first
        low = F.get("_sorted", F.shiftright(n - 1, 1) + width - n)
        high = F.get("_sorted", F.shiftright(n, 1) + width - n)
        df = df.withColumn(median, F.when(n > 0, (low + high) / 2))
    if mean or std:
        mid = mean or "_mean"
        sums = total([F.coalesce(c, F.lit(0.0)) for c in columns])
        df = df.withColumn(mid, sums / F.nullif(n, F.lit(0)))
        if std:
            squares = total([F.coalesce((c - F.col(mid)) * (c - F.col(mid)), F.lit(0.0)) for c in columns])
            df = df.withColumn(std, F.when(n > 1, F.sqrt(squares / F.nullif(n - 1, F.lit(0)))))
    return df.select(*kept, *[name for name in (median, mean, std) if name])


def between_ranks(low: Column, high: Column, weight: Column) -> Column:
    """Linear interpolation that is exact at both ends and for equal neighbours; next to an infinite one it is infinite."""
    gap = high - low
    return (
        F.when((weight == 0) | (low == high), low)
        .when(F.abs(high) == INF, high)
        .when(F.abs(low) == INF, low)
        .when(weight < 0.5, low + gap * weight)
        .otherwise(high - gap * (1 - weight))
    )


def clean_round(col, digits=6):
    """Round for reports; adding zero turns -0.0 into 0.0."""
    return F.round(col, digits) + F.lit(0.0)


def f1_columns(pos, length, ds_pos, ds_len, tol):
    """The metric columns of one flagged group, with the tolerance in each denominator."""
    precision = pos / (length + F.lit(tol))
    recall = pos / (ds_pos + F.lit(tol))
    return {
        "group_ratio": length / (ds_len + F.lit(tol)),
        "group_pos_ratio": pos / (ds_len + F.lit(tol)),
        "precision": precision,
        "recall": recall,
        "f1": (2 * precision * recall) / (precision + recall + F.lit(tol)),
    }


def digest128(columns):
    """Two 64-bit hashes that are not functions of each other: the number that tells them apart is hashed first.

    A hash of columns goes on from the hash of those before, so a number at the end would give two functions
    of one 64-bit hash. NULL differs from all values.
    """
    parts = [p for c in columns for p in (F.col(c).isNull(), F.col(c))]
    return [F.xxhash64(F.lit(i), *parts) for i in (1, 2)]
