"""Reading and writing entry tables, predictions and small parameter tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..defaults import DATASET_KEYS, ENTRY_ID, VALUE
from ..plans.ranks import distributed_rank
from ..plans.staging import stage

_CORRUPT = "_corrupt_line"


def read_table(spark: SparkSession, path: str, schema=None, sep=";", fmt="csv") -> DataFrame:
    """Delimited text with a header (give a schema: none is inferred, text stays text) or Parquet."""
    if fmt == "parquet":
        return spark.read.parquet(path)
    reader = spark.read.options(header=True, sep=sep, enforceSchema=False)
    return (reader.schema(schema) if schema is not None else reader).csv(path)


def read_with_rejects(spark: SparkSession, path: str, schema, sep=";") -> tuple[DataFrame, DataFrame]:
    """Delimited text with a header as (good rows, rejects).

    A row with a value that its column's type cannot hold, or with too few or too many fields, is a reject: ``line`` is its
    text as read. So a value that is missing, NULL in a good row, differs from one that could not be read.
    """
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    kept = T.StructType([*schema.fields, T.StructField(_CORRUPT, T.StringType())])
    reader = spark.read.options(header=True, sep=sep, enforceSchema=True, mode="PERMISSIVE", columnNameOfCorruptRecord=_CORRUPT)
    rows = reader.schema(kept).csv(path)
    # Parsed once and staged: a reader that is asked for some columns does not look at the values of others.
    rows = stage(rows)
    good = rows.filter(F.col(_CORRUPT).isNull()).drop(_CORRUPT)
    return good, rows.filter(F.col(_CORRUPT).isNotNull()).select(F.col(_CORRUPT).alias("line"))


def write_table(df: DataFrame, path: str, keys=None, fmt="parquet", sep=";") -> None:
    """Writes a table, with one folder per dataset where it has dataset columns.

    Rows of a dataset are brought together first, so that a folder has few files: one if the dataset is small; a large one
    is split by adaptive execution into files of about the session's advisory partition size.
    """
    keys = [k for k in DATASET_KEYS if k in df.columns] if keys is None else list(keys)
    if keys:
        df = df.hint("rebalance", *keys)
    writer = df.write.mode("errorifexists")
    writer = writer.partitionBy(*keys) if keys else writer
    writer.options(header=True, sep=sep).csv(path) if fmt == "csv" else writer.parquet(path)


def number_from_text(column):
    """Numbers kept as text, with or without square brackets; NULL where there is none."""
    return F.btrim(F.trim(F.col(column).cast("string")), F.lit("[]")).try_cast("double")


def load_predictions(df: DataFrame, models, offset=0.0, key="smiles", order="index", value=VALUE) -> DataFrame:
    """Repairs model columns, adds ``offset`` to them and to the values, numbers entries by key.

    Entry ids are 0, 1, ... in the order of ``key``; ``order`` settles equal keys.
    """
    kinds = dict(df.dtypes)
    fixed = {m: (number_from_text(m) if kinds[m] == "string" else F.col(m)) + F.lit(float(offset)) for m in models}
    fixed[value] = F.col(value) + F.lit(float(offset))
    ranked = distributed_rank(df.withColumns(fixed), [key, order], "_rank")
    return ranked.select((F.col("_rank") - 1).alias(ENTRY_ID), *[c for c in df.columns if c not in (order, ENTRY_ID)])


def save_params(spark: SparkSession, path: str, names, mean, scale) -> None:
    """Column list with mean and scale: one small row per column, in order."""
    rows = [(i, str(n), float(m), float(s)) for i, (n, m, s) in enumerate(zip(names, mean, scale, strict=True))]
    spark.createDataFrame(rows, "position INT, name STRING, mean DOUBLE, scale DOUBLE").coalesce(1).write.mode(
        "errorifexists"
    ).parquet(path)


def load_params(spark: SparkSession, path: str):
    """The saved (names, means, scales); as many entries as there are columns."""
    rows = spark.read.parquet(path).orderBy("position").collect()
    return [r["name"] for r in rows], [r["mean"] for r in rows], [r["scale"] for r in rows]


def save_mask(df: DataFrame, path: str, id_col=ENTRY_ID) -> None:
    """The ids of the rows that were kept."""
    df.select(id_col).write.mode("errorifexists").parquet(path)


def apply_mask(df: DataFrame, spark: SparkSession, path: str, id_col=ENTRY_ID) -> DataFrame:
    return df.join(spark.read.parquet(path), id_col, "left_semi")


def stack_datasets(frames: dict, keys=DATASET_KEYS) -> DataFrame:
    """Union of frames, each labelled with its key values.

    Labels of a key that are all numbers become doubles, others text. A label for each key is needed.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    labelled = [(labels if isinstance(labels, tuple) else (labels,), frame) for labels, frame in frames.items()]
    for labels, _ in labelled:
        if len(labels) != len(keys):
            raise ValueError(f"{labels!r} does not label {keys}")
    numeric = [all(isinstance(labels[i], (int, float)) and not isinstance(labels[i], bool) for labels, _ in labelled) for i in range(len(keys))]
    out = None
    for labels, frame in labelled:
        part = frame.select(*[F.lit(float(v) if n else str(v)).alias(k) for k, v, n in zip(keys, labels, numeric)], *frame.columns)
        out = part if out is None else out.unionByName(part)
    return out


def prediction_schema(models, with_key="smiles", text_models=()):
    """Schema of a predictions file: leading index, key, values, one column per model."""
    fields = [T.StructField("index", T.LongType()), T.StructField(with_key, T.StringType()), T.StructField(VALUE, T.DoubleType())]
    fields += [T.StructField(m, T.StringType() if m in text_models else T.DoubleType()) for m in models]
    return T.StructType(fields)
