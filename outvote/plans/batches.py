"""Columns of numbers met with a few facts of their dataset, in Arrow batches inside tasks.

For many columns and sorted facts this is far less work than a row for each value: numpy takes a column of some 100 000 rows at once.
What is sent to the tasks are at most ``FEW`` rows of facts; with more of them, callers join.
"""

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

FEW = 4096
BATCH_ROWS = 1 << 17
HELD_VALUES = 1 << 21
POINTS = 1024  # of a summary; thinned to so many, it errs by half a weight of one of them


def few(df: DataFrame):
    """The rows of a staged frame, or None if they are more than ``FEW``."""
    rows = df.limit(FEW + 1).collect()
    return rows if len(rows) <= FEW else None


def by_dataset():
    """A function that tasks get as it is: they need not be able to import this package."""

    def parts(batches, names):
        """Dataset number and columns of its rows, of about ``BATCH_ROWS`` rows at a time. Missing numbers are NaN."""
        held, n = [], 0
        for batch in chain(batches, [None]):
            if batch is not None:
                held.append(batch)
                n += batch.num_rows
            if not n or (batch is not None and n < BATCH_ROWS):
                continue
            table = pa.Table.from_batches(held)
            held, n = [], 0
            numbers = table.column("_d").to_numpy()
            columns = [table.column(c).to_numpy() for c in names]
            del table
            order = np.argsort(numbers, kind="stable")
            numbers = numbers[order]
            starts = np.flatnonzero(np.append(True, numbers[1:] != numbers[:-1]))
            ends = np.append(starts[1:], len(numbers))
            columns = [c[order] for c in columns] if len(starts) > 1 else columns
            for a, b in zip(starts.tolist(), ends.tolist()):
                yield int(numbers[a]), [c[a:b] for c in columns]

    return parts


def region_counts(rows: DataFrame, edges, names, make=None) -> DataFrame:
    """Sizes and bounds of the regions that sorted edges make of a dataset's values, as in ``quantiles``.

    ``rows`` has the dataset's number ``_d`` and the columns ``names``; ``edges`` are rows ``_d, _c, _edges, _covered``. Regions are
    counted by task; where ``_covered``, a row for each distinct value of some ``HELD_VALUES`` (a value may come again). ``make`` turns a list
    of the columns into the list of those to count.
    """
    sent = rows.sparkSession.sparkContext.broadcast({(r["_d"], r["_c"]): (np.array(r["_edges"]), np.array(r["_covered"])) for r in edges})
    parts = by_dataset()

    def count(batches):
        known, totals, held, n_held = sent.value, {}, {}, 0

        def chunks(found):
            """Few and large batches from tuples of a dataset, column, regions, whether inside, sizes, lows and highs."""
            if not found:
                return []
            sizes = [len(f[4]) for f in found]
            d, c, inside = (np.repeat([f[i] for f in found], sizes) for i in (0, 1, 3))
            region, n, low, high = (np.concatenate([f[i] for f in found]) for i in (2, 4, 5, 6))
            fields = {"_d": (d, pa.int64()), "_c": (c, pa.int32()), "_region": (region, pa.int32()), "_inside": (inside, pa.bool_())}
            fields |= {"_n": (n, pa.int64()), "_low": (low, pa.float64()), "_high": (high, pa.float64())}
            return pa.table({k: pa.array(v, t) for k, (v, t) in fields.items()}).to_batches(max_chunksize=1 << 16)

        def values():
            found = []
            for (d, c, region), pieces in held.items():
                x = np.sort(np.concatenate(pieces))
                first = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
                n, x = np.diff(np.append(first, len(x))), x[first]
                found.append((d, c, np.full(len(x), region), True, n, x, x))
            held.clear()
            return chunks(found)

        for d, columns in parts(batches, names):
            for c, x in enumerate(make(columns) if make else columns):
                x = np.sort(x[~np.isnan(x)] + 0.0)  # no -0.0
                if not len(x):
                    continue
                cuts, covered = known[d, c]
                at = np.zeros(2 * len(cuts) + 2, "int64")
                at[1:-1:2], at[2:-1:2], at[-1] = np.searchsorted(x, cuts, "left"), np.searchsorted(x, cuts, "right"), len(x)
                n = np.diff(at)
                low = np.where(n > 0, x[np.minimum(at[:-1], len(x) - 1)], np.inf)
                high = np.where(n > 0, x[np.maximum(at[1:] - 1, 0)], -np.inf)
                inside = np.zeros(len(n), bool)
                inside[::2] = covered
                for region in np.flatnonzero(inside & (n > 0)).tolist():
                    held.setdefault((d, c, region), []).append(x[at[region] : at[region + 1]].copy())
                n_held += int(n[inside].sum())
                n = np.where(inside, 0, n)
                if (d, c) in totals:
                    old = totals[d, c]
                    n, low, high = old[0] + n, np.minimum(old[1], low), np.maximum(old[2], high)
                totals[d, c] = n, low, high
            if n_held >= HELD_VALUES:
                yield from values()
                n_held = 0
        yield from values()
        full = [(d, c, np.flatnonzero(n), n, low, high) for (d, c), (n, low, high) in totals.items()]
        yield from chunks([(d, c, at, False, n[at], low[at], high[at]) for d, c, at, n, low, high in full])

    return rows.select("_d", *names).mapInArrow(count, "_d long, _c int, _region int, _inside boolean, _n long, _low double, _high double")


def value_brackets(rows: DataFrame, names, make, qs) -> DataFrame:
    """Rows ``_d, _c, n_rows, _v, _brackets``: rows and values of each dataset and column, and for each of ``qs`` bounds of the values at its ranks.

    ``make`` turns a list of the columns ``names`` into the columns of numbers. Tasks sort all values and keep evenly spaced ones of
    them as a summary; summaries too long are thinned again. Each thinning moves ranks by half the weight of a point at most, which is
    added up: a bracket as wide as that sum holds its values for certain, whatever the values and their order.
    """
    parts, points_kept, limit, qs = by_dataset(), POINTS, 2 * HELD_VALUES, [float(q) for q in qs]

    def summarise(batches):
        facts, fresh, held, n_fresh = {}, {}, {}, 0

        def thin(key, x, weights):
            total = weights.sum()
            facts[key][2] += total / (2 * points_kept)
            at = np.searchsorted(np.cumsum(weights), (np.arange(points_kept) + 0.5) * (total / points_kept))
            return x[np.minimum(at, len(x) - 1)], np.full(points_kept, total / points_kept)

        def merged(pieces):
            x, weights = (np.concatenate([piece[i] for piece in pieces]) for i in (0, 1))
            order = np.argsort(x, kind="stable")
            return x[order], weights[order]

        def settle():
            longest = max(2 * points_kept, limit // max(len(facts), 1))
            for key, pieces in fresh.items():
                x = np.sort(np.concatenate(pieces))
                weights = np.ones(len(x))
                own = held.setdefault(key, [])
                own.append(thin(key, x, weights) if len(x) > points_kept else (x, weights))
                if sum(len(x) for x, _ in own) > longest:
                    held[key] = [thin(key, *merged(own))]
            fresh.clear()

        for d, columns in parts(batches, names):
            for c, x in enumerate(make(columns)):
                known = facts.setdefault((d, c), [0, 0, 0.0])
                known[0] += len(x)
                x = x[~np.isnan(x)] + 0.0  # no -0.0
                known[1] += len(x)
                if len(x):
                    fresh.setdefault((d, c), []).append(x)
                    n_fresh += len(x)
            if n_fresh >= limit:
                settle()
                n_fresh = 0
        settle()
        found = []
        for key, fact in facts.items():
            own = held.get(key, [])
            if len(own) > 1 or any(len(x) > points_kept for x, _ in own):
                x, weights = merged(own)
                own = [(x, weights) if len(x) <= points_kept and weights.min() == weights.max() else thin(key, x, weights)]
            x, weights = own[0] if own else (np.empty(0), np.ones(1))
            found.append((*key, *fact, float(weights[0]), x))
        if found:
            numbers = [pa.array([f[i] for f in found], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64()))]
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([len(f[6]) for f in found])), pa.int32()), pa.array(np.concatenate([f[6] for f in found])))
            yield from pa.table([*numbers, lists], names=["_d", "_c", "n_rows", "_v", "_error", "_weight", "_points"]).to_batches(max_chunksize=256)

    def bracketed(table):
        d, c = (table.column(name)[0].as_py() for name in ("_d", "_c"))
        n_rows, n = (sum(table.column(name).to_pylist()) for name in ("n_rows", "_v"))
        points = table.column("_points").combine_chunks()
        x = points.flatten().to_numpy(zero_copy_only=False)
        weights = np.repeat(table.column("_weight").to_numpy(), points.value_lengths().to_numpy(zero_copy_only=False))
        order = np.argsort(x, kind="stable")
        x, weights = x[order], weights[order]
        upto = np.cumsum(weights)
        error = sum(table.column("_error").to_pylist()) + 1 + 1e-9 * n  # sums are rounded
        found = []
        for q in qs if n else []:
            low = int((n - 1) * q)
            a, b = np.searchsorted(upto - weights, low - error, "right") - 1, np.searchsorted(upto, min(low + 1, n - 1) + 1 + error, "left")
            found.append({"a": float(x[a]) if a >= 0 else -np.inf, "b": float(x[b]) if b < len(x) else np.inf})
        kind = pa.list_(pa.struct([("a", pa.float64()), ("b", pa.float64())]))
        return pa.table({"_d": pa.array([d], pa.int64()), "_c": pa.array([c], pa.int32()), "n_rows": pa.array([n_rows], pa.int64()), "_v": pa.array([n], pa.int64()), "_brackets": pa.array([found], kind)})

    told = "_d long, _c int, n_rows long, _v long, _error double, _weight double, _points array<double>"
    summaries = rows.select("_d", *names).mapInArrow(summarise, told)
    return summaries.groupBy("_d", "_c").applyInArrow(bracketed, "_d long, _c int, n_rows long, _v long, _brackets array<struct<a: double, b: double>>")


def made_values(rows: DataFrame, names, make) -> DataFrame:
    """A row ``_d, _c, _x`` for each number of each column that ``make`` makes."""
    parts = by_dataset()

    def tell(batches):
        for d, columns in parts(batches, names):
            for c, x in enumerate(make(columns)):
                x = x[~np.isnan(x)] + 0.0
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), d), pa.int64()), pa.array(np.full(len(x), c), pa.int32()), pa.array(x)], ["_d", "_c", "_x"])

    return rows.select("_d", *names).mapInArrow(tell, "_d long, _c int, _x double")


def level_counts(rows: DataFrame, cuts, names, make, groups, steps: int) -> DataFrame:
    """Rows ``_d, _j, _mod, _level, cnt``: how many of the ``steps`` ascending cuts all columns of the j-th group have reached.

    ``cuts`` has an array, or None, for each column of a dataset; a missing number and a missing array have reached none, as in ``levels.count_passed``.
    ``make(columns, absent)`` appends to ``absent`` where each column's NaN stand for a missing number, or None; others are above all cuts.
    Counted by task.
    """
    sent = rows.sparkSession.sparkContext.broadcast({d: [None if a is None else np.array(a, "float64") for a in arrays] for d, arrays in cuts.items()})
    parts, kind = by_dataset(), np.min_scalar_type(steps)

    def count(batches):
        totals = {}
        for d, (mod, *columns) in parts(batches, ["_mod", *names]):
            absent, levels = [], []
            for known, x in zip(sent.value[d], make(columns, absent)):
                if known is None:
                    level = np.zeros(len(x), kind)
                elif steps == 1:
                    level = (~(x < known[0])).astype(kind)
                else:
                    level = np.searchsorted(known, x, "right").astype(kind)
                if absent[-1] is not None:
                    level[absent[-1]] = 0
                levels.append(level)
            mod = mod.astype("int64")
            for j, group in enumerate(groups):
                level = levels[group[0]]
                for c in group[1:]:
                    level = np.minimum(level, levels[c])
                n = np.bincount(2 * level.astype("int64") + mod, minlength=2 * steps + 2)
                totals[d, j] = totals.get((d, j), 0) + n
        found = [(d, j, bool(at % 2), at // 2, int(n[at])) for (d, j), n in totals.items() for at in np.flatnonzero(n).tolist()]
        if found:
            types = pa.int64(), pa.int32(), pa.bool_(), pa.int32(), pa.int64()
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*found), types)], ["_d", "_j", "_mod", "_level", "cnt"])

    return rows.select("_d", "_mod", *names).mapInArrow(count, "_d long, _j int, _mod boolean, _level int, cnt long")
