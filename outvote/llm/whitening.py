"""Whitening of embeddings with Spark MLlib's BlockMatrix.

Steps:

1. Vectors become whole numbers and get row numbers, written once. Numbering needs no shuffle: a partition's rows
   fill blocks of their own, and rows that are missing in its last one count as zeros, which add nothing.
2. Sums over the rows give the mean; column expressions centre the rows, and an IndexedRowMatrix
   gathers them into the blocks of a BlockMatrix.
3. ``A' A`` by ``BlockMatrix.multiply``, with the long side split over many tasks, gives the scatter, a
   matrix of the vectors' width; its eigenvectors are found locally.
4. ``A W`` by ``BlockMatrix.multiply`` projects all rows. Ids and deviations ride along as columns of A
   that ``W`` passes on unchanged.
5. A pass over the projected blocks measures how far their covariance is from the identity.

The driver holds matrices of the vectors' width and, inside Spark's product, the number of each block:
one for every ``BLOCK_BYTES`` of doubles.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.staging import stage

BLOCK_BYTES = 4 << 20
TASK_BYTES = 64 << 20  # doubles of a product that one task holds
LARGEST = 2.0**52  # whole numbers beyond it are not exact as doubles
_CARRIED = 5  # columns that ride along: two halves of the row's id and of its deviation, and a 1
_HALF = 32
_NULL = 2.0**40  # marks a null in the first half of an id
_ROW_BITS = 33  # monotonically_increasing_id keeps the row number in its low 33 bits


@dataclass
class Whitened:
    """``rows``: one row for each vector; ``eigenvalues`` and unit ``components`` (columns) of the covariance, ``mean`` and ``n``."""

    rows: DataFrame
    n: int
    mean: np.ndarray
    eigenvalues: np.ndarray
    components: np.ndarray
    explained: np.ndarray
    identity_error: float


def whole_numbers(df: DataFrame, id_col="vec_id", vector="embedding", scale=64, shift=1_000_000) -> DataFrame:
    """``id, x``: floor(scale * entry) + shift of each entry, as long.

    Rows whose vector is null, empty, or holds null, NaN, infinite or (beyond 2^52) inexact entries are left out.
    """
    entries = F.transform(F.col(vector).cast("array<double>"), lambda c: c * F.lit(float(scale)))
    rows = df.select(F.col(id_col).cast("long").alias("id"), entries.alias("v"))
    rows = rows.filter(F.coalesce((F.size("v") > 0) & F.forall("v", lambda c: c.isNotNull() & (F.abs(c) < LARGEST)), F.lit(False)))
    return rows.select("id", F.transform("v", lambda c: F.floor(c) + F.lit(shift).cast("long")).alias("x"))


def _most_common_width(rows: DataFrame) -> int | None:
    sizes = rows.groupBy(F.size("x").alias("width")).agg(F.count("*").alias("n"))
    found = sizes.agg(F.max(F.struct("n", "width")).alias("m")).first()["m"]  # one row a width, combined before the shuffle
    return found and found["width"]


def _indexed(rows: DataFrame, width: int, per_block: int) -> DataFrame:
    """``index, id, x``, written once: row k of partition p of P is row ``k % B`` of block ``(k / B) * P + p``, with B rows a block."""
    rows = rows.filter(F.size("x") == width)
    parts = max(1, rows.rdd.getNumPartitions())
    at = F.monotonically_increasing_id()
    own, k = F.shiftright(at, _ROW_BITS), at.bitwiseAND((1 << _ROW_BITS) - 1)
    block = F.floor(k / per_block) * parts + own
    return stage(rows.select((block * per_block + k % per_block).alias("index"), "id", "x"))


def _sums(rows: DataFrame, width: int) -> tuple[int, list[int]]:
    """Number of rows and the exact sum of each dimension."""

    def run(batches):
        total, n = np.zeros(width, object), 0
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)
            high = x >> 26  # halves, so that the sum of a batch cannot overflow
            total = total + high.sum(axis=0).astype(object) * (1 << 26) + (x & ((1 << 26) - 1)).sum(axis=0).astype(object)
            n += len(x)
        yield pa.RecordBatch.from_pylist([{"dim": i, "s": str(v), "n": n} for i, v in enumerate(total.tolist())])

    parts = rows.select("x").mapInArrow(run, "dim long, s string, n long")
    found = parts.groupBy("dim").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n")).collect()  # one row a dimension
    sums = {r["dim"]: int(r["s"]) for r in found}
    return found[0]["n"], [sums[i] for i in range(width)]


def _whole(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    return (high.astype(np.int64) << _HALF) | low.astype(np.int64)


def _halves(column) -> list:
    """A long as two doubles that hold it exactly."""
    return [F.shiftright(column, _HALF).cast("double"), F.col(column).bitwiseAND((1 << _HALF) - 1).cast("double")]


def _block_matrix(rows: DataFrame, n, sums, per_block: int, n_rows: int) -> BlockMatrix:
    """The centred rows, ``x - S/n`` rounded once, in blocks; ids and deviations are further columns."""
    whole = F.array(*[F.lit(s // n).cast("long") for s in sums])
    rest = F.array(*[F.lit(s % n).cast("long") for s in sums])
    near = rows.withColumns({"near": F.transform("x", lambda v, i: v - F.get(whole, i)), "rest": rest})
    centred = F.transform("near", lambda v, i: v - F.get(F.col("rest"), i) / F.lit(float(n)))
    made = near.withColumn("centred", centred)
    size = F.aggregate("centred", F.lit(0.0), lambda t, c: t + (c * n) * (c * n))
    away = F.zip_with("near", "rest", lambda v, r: v * n - r)
    exact = F.aggregate(away, F.lit(0).cast("long"), lambda t, d: t + d * d)
    made = made.withColumn("away", F.when(size < 9e18, exact).otherwise(F.lit(-1).cast("long")))
    made = made.withColumn("known", F.coalesce("id", F.lit(0).cast("long")))
    high, low = _halves("known")
    carried = F.array(F.when(F.col("id").isNull(), F.lit(_NULL)).otherwise(high), low, *_halves("away"), F.lit(1.0))
    vectors = made.select("index", array_to_vector(F.concat("centred", carried)).alias("vector"))
    vectors = MLUtils.convertVectorColumnsFromML(vectors, "vector")
    columns = len(sums) + _CARRIED
    return IndexedRowMatrix(vectors, n_rows, columns).toBlockMatrix(per_block, columns)


def _multiply(left: BlockMatrix, right: BlockMatrix, splits: int) -> BlockMatrix:
    """``left * right`` with the side they share dealt over ``splits`` tasks for each block of the result."""
    java = left._java_matrix_wrapper.call("multiply", right._java_matrix_wrapper._java_model, int(splits))
    return BlockMatrix(java, left.rowsPerBlock, right.colsPerBlock)


def _blocks(product: BlockMatrix) -> DataFrame:
    """``values``: each block of the product, column after column."""
    blocks = callMLlibFunc("getMatrixBlocks", product._java_matrix_wrapper._java_model)
    return blocks.select(F.unwrap_udt(F.col("subMatrix" if "subMatrix" in blocks.columns else blocks.columns[1])).alias("m")).select("m.values", "m.isTransposed")


def _blocks_read(batches, columns):
    """The rows of each block that stand for a vector."""
    for batch in batches:
        for values, turned in zip(batch.column("values"), batch.column("isTransposed").to_pylist()):
            flat = values.values.to_numpy(zero_copy_only=False)
            table = flat.reshape(-1, columns) if turned else flat.reshape(columns, -1).T
            yield np.ascontiguousarray(table[table[:, -1] == 1.0])


def _identity_error(projected: DataFrame, n: int, k: int) -> float:
    """Largest absolute entry of the covariance of the projected rows less the identity; moments combine before the shuffle."""

    def run(batches):
        total, square = np.zeros(k), np.zeros((k, k))
        for table in _blocks_read(batches, k + _CARRIED):
            y = table[:, :k]
            total += y.sum(axis=0)
            square += y.T @ y
        cells = np.concatenate([total, square.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cells))), pa.array(cells)], names=["cell", "value"])

    cells = projected.mapInArrow(run, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value"))
    found = np.zeros(k + k * k)
    for row in cells.collect():  # k + k^2 rows
        found[row["cell"]] = row["value"]
    mean = found[:k] / n
    covariance = found[k:].reshape(k, k) / n - np.outer(mean, mean)
    return float(np.abs(covariance - np.eye(k)).max())


def _long_form(projected: DataFrame, k: int) -> DataFrame:
    """``vec_id, component, deviation, whitened``: one row for each vector and component."""

    def run(batches):
        for table in _blocks_read(batches, k + _CARRIED):
            for at in range(0, len(table), 1024):
                part = table[at : at + 1024]
                null = part[:, k] == _NULL
                ids = _whole(np.where(null, 0, part[:, k]), part[:, k + 1])
                away = _whole(part[:, k + 2], part[:, k + 3])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(ids, k), mask=np.repeat(null, k)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(part))),
                        pa.array(np.repeat(away, k), mask=np.repeat(away < 0, k)), pa.array(part[:, :k].ravel()),
                    ],
                    names=["vec_id", "component", "deviation", "whitened"],
                )

    return projected.mapInArrow(run, "vec_id long, component int, deviation long, whitened double")


def whiten(df: DataFrame, id_col="vec_id", vector="embedding", most=32, scale=64, shift=1_000_000) -> Whitened | None:
    """Whitened components of all vectors of ``df``; None if no vector or no variance is left.

    Entries become ``floor(scale * entry) + shift``. Rows without a whole vector are left out: null, empty, or with
    null, not finite or (beyond 2^52) inexact entries, and vectors of another length than most have (of lengths
    met equally often the larger one). Repeated rows and ids count each; a null id stays null.
    Components are numbered by falling eigenvalue of the covariance, at most ``most``; those whose eigenvalue is not above
    rounding (width x 2^-52 of the largest) have no direction of their own and are left out. ``rows`` has ``vec_id,
    component, n, deviation, whitened, explained, identity_error``; a deviation that does not fit into a long
    is null. Other columns, whatever their names, are ignored.
    """
    spark = df.sparkSession
    numbers = whole_numbers(df, id_col, vector, scale, shift)
    width = _most_common_width(numbers)
    if not width:
        return None
    per_block = max(1, BLOCK_BYTES // (8 * (width + _CARRIED)))
    rows = _indexed(numbers, width, per_block)
    n, sums = _sums(rows, width)
    n_blocks = rows.agg(F.max("index")).first()[0] // per_block + 1

    a = _block_matrix(rows, n, sums, per_block, n_blocks * per_block)
    tasks = max(-(-n_blocks * BLOCK_BYTES // TASK_BYTES), spark.sparkContext.defaultParallelism)
    scatter = _multiply(a.transpose(), a, min(n_blocks, tasks)).toLocalMatrix().toArray()[:width, :width]
    values, vectors = np.linalg.eigh((scatter + scatter.T) / 2 / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = int((values[:most] > width * 2.0**-52 * max(values[0], 0.0)).sum()) if values[0] > 0 else 0
    if not k:
        return None
    explained = values[:k] / np.trace(scatter / n)

    turn = np.zeros((width + _CARRIED, k + _CARRIED))
    turn[:width, :k] = vectors[:, :k] / np.sqrt(values[:k])
    turn[width:, k:] = np.eye(_CARRIED)
    w = spark.sparkContext.parallelize([((0, 0), Matrices.dense(*turn.shape, turn.ravel(order="F")))], 1)
    w = BlockMatrix(w, *turn.shape, *turn.shape)
    projected = _blocks(_multiply(a, w, 1))
    error = _identity_error(projected, n, k)

    shares = F.array(*[F.lit(float(e)) for e in explained])
    rows = _long_form(projected, k).select(
        "vec_id", "component", F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.get(shares, F.col("component") - 1).alias("explained"), F.lit(error).alias("identity_error"),
    )
    mean = np.array([s // n + (s % n) / n for s in sums])
    return Whitened(rows, n, mean, values, vectors, explained, error)


RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whitened_rows(df: DataFrame, **options) -> DataFrame:
    """``rows`` of ``whiten``, empty where there is nothing to whiten."""
    found = whiten(df, **options)
    return found.rows if found else df.sparkSession.createDataFrame([], RESULT)
