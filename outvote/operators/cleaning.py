"""Filters, key repair, deduplication, column choice and reshaping."""

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expr import digest128

# Fixed value: keeps the formula, connection and hydrogen layers of a structure key.
LAYERED_KEY = r"^(InChI=1S/[\w]+/[\w\d\-\(\)\,]+/h[\w\d\,\(\)\-]+)/{0,1}.*"
MIN_RETENTION = 400


def above(df: DataFrame, column: str, limit=MIN_RETENTION) -> DataFrame:
    """Rows strictly above a limit; reaches the scan as a pushed filter."""
    return df.filter(F.col(column) > limit)


def filter_counts(df: DataFrame, condition: Column) -> DataFrame:
    """Rows before and after a filter, in one pass."""
    return df.agg(F.count("*").alias("n_before"), F.count_if(condition).alias("n_after"))


def drop_invalid(df: DataFrame, valid: Column) -> DataFrame:
    """Rows the validator accepts. ``valid``: a condition, or a vectorised user function of columns."""
    return df.filter(F.coalesce(valid, F.lit(False)))


def rejects(df: DataFrame, valid: Column) -> DataFrame:
    return df.filter(~F.coalesce(valid, F.lit(False)))


def truncate_key(column, pattern=LAYERED_KEY) -> Column:
    """First group of an anchored pattern; NULL where it does not match."""
    return F.nullif(F.regexp_extract(column, pattern, 1), F.lit(""))


def dedup_keep_first(df: DataFrame, key, order) -> DataFrame:
    """The first row of each key by a unique order; a NULL is a key like others.

    Only 128-bit digests of the keys and the order are aggregated, one row per key and task, and the rows are
    then picked by their order: long keys and wide rows are neither sorted nor carried along. A hash of another
    kind is compared among the rows of a digest; if it shows that keys differ, that is an error.
    """
    key = [key] if isinstance(key, str) else list(key)
    order = [order] if isinstance(order, str) else list(order)
    rest = [c for c in df.columns if c not in key]
    if not rest:
        return df.distinct()
    digest = [d.alias(f"_digest{i}") for i, d in enumerate(digest128(key), 1)]
    least = F.min(order[0]) if len(order) == 1 else F.min(F.struct(*order))
    check = _key_check(key)
    first = df.groupBy(*digest).agg(least.alias("_first"), F.min(check).alias("_low"), F.max(check).alias("_high"))
    same = F.when(F.col("_low") == F.col("_high"), F.col("_first")).otherwise(F.raise_error(F.lit("different keys with equal digests")).cast(first.schema["_first"].dataType))
    first = first.select(same.alias("_first"))
    chosen = [F.col("_first")] if len(order) == 1 else [F.col(f"_first.{c}") for c in order]
    first = first.select(*[c.alias(f"_order{i}") for i, c in enumerate(chosen)])
    match = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_order{i}")) for i, c in enumerate(order)])
    return df.join(first, match, "left_semi")


def _key_check(key):
    """A hash of another kind than the digest's."""
    return F.crc32(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in key]))


def float_columns(df: DataFrame, among=None) -> list[str]:
    """Columns read as floating point: text that is all numbers and not all integers, and doubles.

    One aggregate over all text columns; a column with any other text is out, integers too.
    """
    names = list(among or df.columns)
    kinds = {f.name: f.dataType for f in df.schema.fields}
    texts = [n for n in names if isinstance(kinds[n], T.StringType)]
    aggs = []
    for i, n in enumerate(texts):
        c = F.nullif(F.trim(n), F.lit(""))
        aggs.append(F.count_if(c.isNotNull() & c.try_cast("double").isNull()).alias(f"bad{i}"))
        aggs.append(F.count_if(c.isNull() | ~c.rlike(r"^[+-]?\d+$")).alias(f"real{i}"))
    seen = df.agg(*aggs).first() if aggs else None
    fits = {n: seen[f"bad{i}"] == 0 and seen[f"real{i}"] > 0 for i, n in enumerate(texts)}
    return [n for n in names if fits.get(n, isinstance(kinds[n], (T.DoubleType, T.FloatType)))]


def keep_float_columns(df: DataFrame, ids=()) -> DataFrame:
    """Identifier columns and the floating-point ones, as doubles."""
    names = float_columns(df, [c for c in df.columns if c not in ids])
    return df.select(*ids, *[F.nullif(F.trim(F.col(n).cast("string")), F.lit("")).cast("double").alias(n) if dict(df.dtypes)[n] == "string" else F.col(n) for n in names])


def fill_missing(df: DataFrame, columns, value=0) -> DataFrame:
    """NULL and NaN become ``value``."""
    return df.na.fill(value, list(columns))


def rescale(df: DataFrame, columns, factor=1.0, offset=0.0) -> DataFrame:
    return df.withColumns({c: F.col(c) * F.lit(factor) + F.lit(offset) for c in columns})


def wide_to_long(df: DataFrame, ids, columns, name="stat", value="value") -> DataFrame:
    return df.unpivot(list(ids), list(columns), name, value)


def long_to_wide(df: DataFrame, ids, name: str, value: str, names) -> DataFrame:
    """One column per listed name; conditional aggregates, so no pass to find the names."""
    return df.groupBy(*ids).agg(*[F.max(F.when(F.col(name) == n, F.col(value))).alias(str(n)) for n in names])


def in_groups(df: DataFrame, column: str, groups) -> DataFrame:
    return df.filter(F.col(column).isin(list(groups)))
