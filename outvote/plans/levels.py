"""Positions of row values among sorted per-dataset cuts."""

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import own_method


def count_passed(df: DataFrame, probes, width: int, strict=False) -> DataFrame:
    """Adds, per probe, how many entries of an ascending array a value has reached.

    ``probes`` maps a new column to (value column, array column), or to several such pairs
    where each value must have reached its own array's entry; ``width`` is the array length.
    One projection per halving step covers all probes, and with many probes each is a method of its own, so the
    generated code stays small however many cuts there are. A missing value or array gives 0; with ``strict`` the
    value must exceed the cut.

    The result passes through a one-row generator: a filter on it would otherwise be pushed
    below all steps, doubling in size at each.
    """
    kept = df.columns
    df = df.withColumns({out: F.lit(0) for out in probes})
    step = 1 << (width.bit_length() - 1)
    while step:
        moves = {}
        for out, pairs in probes.items():
            tests = []
            for value, cuts in [pairs] if isinstance(pairs, tuple) else pairs:
                cut = F.get(F.col(cuts), F.col(out) + (step - 1))
                tests.append(F.col(value) > cut if strict else F.col(value) >= cut)
            reached = reduce(and_, tests)
            moves[out] = F.when(reached, F.col(out) + step).otherwise(F.col(out))
        df = df.withColumns(moves)
        df = own_method(df) if len(probes) > 4 else df
        step >>= 1
    found = F.array(F.struct(*probes))
    return df.select(*kept, F.inline(found))
