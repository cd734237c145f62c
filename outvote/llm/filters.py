"""A bit filter of bounded size that thins out rows before an exact join."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import draw

MOST_BITS = 27  # 16 MB


class BitFilter:
    """One bit a hash value. It may let rows pass that are not wanted, never the reverse.

    It has 16 bits a value, so one row in sixteen passes without need, up to 2^27 bits in all; beyond
    some hundred million values it lets most rows pass, and the join after it does the work alone.
    """

    def __init__(self, bits: np.ndarray):
        self.bits = bits
        self.log = int(len(bits) * 64).bit_length() - 1

    @classmethod
    def of(cls, df: DataFrame, column: str) -> "BitFilter":
        """Filter over the values of a long column of a staged frame (it is read twice); words of 64 bits meet in the shuffle."""
        log = min(MOST_BITS, max(12, int(16 * df.count()).bit_length()))
        n_words = 1 << (log - 6)

        def run(batches):
            bits = np.zeros(n_words, np.uint64)
            for batch in batches:
                at = _at(batch.column(0).drop_null().to_numpy(), log)
                np.bitwise_or.at(bits, at >> np.uint64(6), np.uint64(1) << (at & np.uint64(63)))
            word = np.flatnonzero(bits)
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(bits[word].view(np.int64))], names=["word", "bits"])

        parts = df.select(column).mapInArrow(run, "word long, bits long")
        rows = parts.groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()
        bits = np.zeros(n_words, np.uint64)
        bits[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64).view(np.uint64)
        return cls(bits)

    def holds(self, values: np.ndarray) -> np.ndarray:
        at = _at(values, self.log)
        return (self.bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def _at(values, log):
    return draw(values.astype(np.int64).view(np.uint64), 77) >> np.uint64(64 - log)
