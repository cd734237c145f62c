"""Exact linear-interpolation quantiles per dataset, for several columns in two passes.

One plan for every size. The first pass makes a mergeable sketch (KLL) of each column and dataset. The error of the
sketch's ranks gives, for each wanted quantile, a bracket of values that holds it. The second pass counts the rows below, between and
above the brackets, and the distinct values inside them: a few percent of the rows, counted in sorted Arrow batches and not shuffled
(with more than ``batches.FEW`` datasets and columns, joined and counted before a shuffle). From these counts come the ranks,
exactly: the sketch only says where to look.

Two further steps are there for what the counts do not settle, and read nothing twice otherwise. Brackets with more than
``CELL`` distinct values are cut into ``SPLIT`` parts, again and again, on the staged counts. A rank
outside of its bracket, which happens once in some million sketches, is searched for in the source in the same way.
"""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.expr import INF, between_ranks, clean_number
from .batches import few, made_values, region_counts, value_brackets
from .levels import count_passed
from .staging import lookup, row_bytes, stage

SPLIT = 1024
CELL = 50_000
ERRORS = 2.0  # a bracket reaches so many times the rank error that 99 of 100 sketches keep


def _sketch_size(wanted: int) -> int:
    """The more quantiles, the narrower their brackets, so that all of them hold a small share of the rows."""
    return min(8192, max(1024, 1 << (256 * wanted - 1).bit_length()))


def _rank_error(size: int) -> float:
    """Of a KLL sketch, as a share of its rows. The formula's numbers are fixed values of that sketch."""
    return 2.296 / size**0.9021


def _by_column(given, columns, what):
    """One entry a column from a mapping, or the same for all."""
    if not isinstance(given, dict):
        return {c: given for c in columns}
    if set(given) != set(columns):
        raise ValueError(f"{what} are needed for {columns}, not for {sorted(given)}")
    return given


def exact_quantiles(df: DataFrame, keys, columns, qs, null_policy="poison", made=None) -> DataFrame:
    """Per dataset: ``n_rows`` and, for each column, an array of its quantiles in the order of ``qs``.

    ``null_policy='poison'``: one missing value makes the whole array NULL. ``'skip'``: quantiles of the values present.
    ``qs`` and ``null_policy`` may be mappings with an entry for each column, all answered in the same two passes.
    Rows with a NULL key belong to no dataset. ``made``, a frame of the same rows with keys and numbers, the numbers' names and a
    function as in ``region_counts``, spares the second pass columns that numpy makes from fewer ones, bit for bit.
    """
    keys, columns = list(keys), list(columns)
    qs = {c: [float(q) for q in v] for c, v in _by_column(qs, columns, "quantiles").items()}
    policies = _by_column(null_policy, columns, "policies")
    for policy in policies.values():
        if policy not in ("poison", "skip"):
            raise ValueError(f"unknown null_policy {policy!r}")
    df = df.select(*keys, *columns).dropna(subset=keys) if keys else df.select(*columns)
    rows = df.select(*keys, *[clean_number(c).alias(f"_v{i}") for i, c in enumerate(columns)])
    ids, width = ["_d", "_c"], 2 * max(map(len, qs.values()), default=0)

    facts = _sketched(rows, keys, [qs[c] for c in columns])
    datasets = facts.filter("_c = 0").select(*keys, "_d")
    numbered = lambda frame: lookup(frame, datasets, keys, "inner", row_bytes(2)).drop(*keys)
    rows = numbered(rows)
    # One narrow row per value: with all columns in a row the generated code gets too big to be compiled.
    long = rows.select("_d", F.inline(F.array(*[F.struct(F.lit(i).alias("_c"), F.col(f"_v{i}").alias("_x")) for i in range(len(columns))])))
    edges = facts.filter("_v > 0").select(*ids, "_edges", "_covered")
    known = few(edges)
    if known is None:
        counts = _counted_regions(long, edges, ids, width)
    else:
        given = (rows, [f"_v{i}" for i in range(len(columns))], None) if made is None else (numbered(made[0]), *made[1:])
        counts = stage(region_counts(given[0], known, *given[1:]))
    return _answered(facts, counts, long, keys, columns, policies, width)


def quantiles_in_batches(rows: DataFrame, columns, qs, names, make, null_policy="poison") -> DataFrame:
    """``exact_quantiles`` of columns that numpy makes from others, per dataset number ``_d``; no more than ``batches.FEW`` datasets and columns.

    ``make`` turns a list of the columns ``names`` of ``rows`` into the numbers of ``columns``. Brackets come from sorted batches too, and are
    certain to hold their ranks.
    """
    columns, qs, ids = list(columns), [float(q) for q in qs], ["_d", "_c"]
    facts = value_brackets(rows, names, make, qs)
    slots = F.transform(_numbers(qs), lambda q: _slot(q, F.col("_v")))
    facts = _with_edges(stage(facts.withColumn("_slots", F.when(F.col("_v") > 0, slots))))
    counts = stage(region_counts(rows, facts.filter("_v > 0").select(*ids, "_edges", "_covered").collect(), names, make))
    return _answered(facts, counts, made_values(rows, names, make), ["_d"], columns, dict.fromkeys(columns, null_policy), 2 * len(qs))


def _answered(facts, counts, long, keys, columns, policies, width):
    """The quantiles at the ranks of ``facts`` from the counts of their regions; ``long`` has all values, for ranks outside of their brackets."""
    ids = ["_d", "_c"]
    state = facts.filter("_v > 0").select(*ids, F.lit(0).alias("_cell"), F.lit(0).cast("long").alias("_below"), "_ranks")
    regions = counts.groupBy(*ids, "_region").agg(
        F.sum("_n").alias("_n"), F.min("_low").alias("_low"), F.max("_high").alias("_high"), F.count("*").alias("_values"), F.first("_inside").alias("_inside")
    )
    kept = stage(_narrowed(regions.withColumn("_cell", F.lit(0)), ids, state, width, "_region", "_values", "_inside"))
    open_ = F.col("_low") < F.col("_high")
    small = F.col("_inside") & (F.col("_values") <= CELL)
    direct = kept.filter(open_ & small).select(*ids, F.col("_region").alias("_cell"), "_below", "_ranks")
    found = [_values(kept, ids), _values(_narrowed(counts.filter("_inside").withColumn("_cell", F.col("_region")), ids, direct, width), ids)]
    rest = kept.agg(F.count_if(open_ & F.col("_inside") & ~small), F.count_if(open_ & ~F.col("_inside"))).first()
    if rest[0]:
        values = counts.filter("_inside and _n > 0").select(*ids, F.col("_low").alias("_x"), F.col("_n").alias("_w"))
        found += _searched(values, kept.filter(F.col("_inside") & ~small), ids, width)
    if rest[1]:
        found += _searched(long.withColumn("_w", F.lit(1).cast("long")), kept.filter(~F.col("_inside")), ids, width)

    # At most two entries per wanted quantile.
    held = reduce(DataFrame.unionByName, found).groupBy(*ids).agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_value"))).alias("_held"))
    value = lambda s: between_ranks(F.try_element_at("_held", s["low"]), F.try_element_at("_held", s["high"]), s["weight"])
    done = facts.join(held, ids, "left").withColumn("_q", F.transform("_slots", value))
    out = done.groupBy(*keys).agg(
        F.coalesce(F.max("n_rows"), F.lit(0)).alias("n_rows"),
        *[F.max(F.when(F.col("_c") == i, F.struct("_v", "_q"))).alias(f"_q{i}") for i in range(len(columns))],
    )
    complete = lambda i: F.when(F.col(f"_q{i}._v") == F.col("n_rows"), F.col(f"_q{i}._q"))
    pick = [complete(i) if policies[c] == "poison" else F.col(f"_q{i}._q") for i, c in enumerate(columns)]
    return out.select(*keys, "n_rows", *[p.alias(c) for p, c in zip(pick, columns)])


def _sketched(rows, keys, qs):
    """Per dataset, numbered ``_d``, and column: rows, values, the wanted ranks and the edges of their brackets, in order.

    ``_covered`` says for each stretch between two edges, and before the first and after the last, whether a bracket covers it.
    """
    sizes = [_sketch_size(len(q)) for q in qs]
    sketches = rows.groupBy(*keys).agg(
        F.count("*").alias("n_rows"), *[F.count(f"_v{i}").alias(f"_n{i}") for i in range(len(qs))],
        *[F.kll_sketch_agg_double(f"_v{i}", F.lit(size)).alias(f"_s{i}") for i, size in enumerate(sizes)],
    )

    def facts_for(wanted, size):
        n, sketch, given = F.col("_v"), F.col("_sketch"), _numbers(wanted)
        slots = F.transform(given, lambda q: _slot(q, n))
        error = _rank_error(size)
        reach = (ERRORS + 0.5) * error  # half an error for the wanted ranks' distance of 1 / n from the quantile
        below, above = (F.kll_sketch_get_quantile_double(sketch, _numbers(min(max(q + side, 0.0), 1.0) for q in wanted)) for side in (-reach, reach))
        few = n < 4 / error
        low = lambda q, k: F.when(few | (q <= reach), -INF).otherwise(F.get(below, k))
        high = lambda q, k: F.when(few | (q >= 1 - reach), INF).otherwise(F.get(above, k))
        brackets = F.transform(given, lambda q, k: F.struct(low(q, k).alias("a"), high(q, k).alias("b")))
        return F.struct(slots.alias("_slots"), brackets.alias("_brackets"))

    each = [F.struct(F.lit(i).alias("_c"), F.col(f"_n{i}").alias("_v"), F.col(f"_s{i}").alias("_sketch")) for i in range(len(qs))]
    facts = sketches.withColumn("_d", F.monotonically_increasing_id()).select(*keys, "_d", "n_rows", F.inline(F.array(*each)))
    found = None
    for wanted in dict.fromkeys(map(tuple, qs)):
        own = F.col("_c").isin([i for i, q in enumerate(qs) if tuple(q) == wanted]) & (F.col("_v") > 0)
        made = facts_for(wanted, _sketch_size(len(wanted)))
        found = F.when(own, made) if found is None else found.when(own, made)
    facts = facts.withColumn("_found", found).select(*keys, "_d", "n_rows", "_c", "_v", "_found._slots", "_found._brackets")
    return _with_edges(stage(facts))  # what follows is arithmetic on its few rows


def _with_edges(facts):
    edges = F.array_sort(F.array_distinct(F.concat("_brackets.a", "_brackets.b")))
    ranks = F.array_sort(F.array_distinct(F.concat("_slots.low", "_slots.high")))
    facts = facts.withColumns({"_edges": edges, "_ranks": ranks})
    covers = lambda k: F.exists("_brackets", lambda b: (b["a"] <= F.get("_edges", k - 1)) & (F.get("_edges", k) <= b["b"]))
    covered = F.transform(F.sequence(F.lit(0), F.size("_edges")), lambda k: F.coalesce(covers(k), F.lit(False)))
    return facts.withColumn("_covered", F.when(F.col("_v") > 0, covered)).drop("_brackets")


def _numbers(values):
    """An array of constants, made in one go."""
    return F.expr("array(" + ", ".join(f"{v!r}D" for v in values) + ")")


def _counted_regions(long, edges, ids, width):
    """Counts of the regions that the edges make, 2 k - 1 for the k-th edge itself and 2 k for what follows it.

    One row a region, or a row for each value of those inside a bracket; the counts combine before the shuffle.
    """
    rows = lookup(long.filter(F.col("_x").isNotNull()), edges, ids, "inner", row_bytes(3 * width))
    rows = count_passed(rows, {"_k": ("_x", "_edges")}, width)
    on = F.coalesce(F.get("_edges", F.col("_k") - 1) == F.col("_x"), F.lit(False))
    rows = rows.select(*ids, "_x", (2 * F.col("_k") - on.cast("int")).alias("_region"), (~on & F.get("_covered", F.col("_k"))).alias("_inside"))
    value = F.when(F.col("_inside"), F.col("_x"))
    counts = rows.groupBy(*ids, "_region", "_inside", value.alias("_value")).agg(F.count("*").alias("_n"), F.min("_x").alias("_low"), F.max("_x").alias("_high"))
    return stage(counts.drop("_value"))


def _searched(values, cells, ids, width):
    """The wanted values of ``cells`` from weighted ``values``: cells are cut until they have few values, then counted by value."""
    found, kept = [], cells
    while (most := kept.filter("_low < _high").agg(F.max("_n")).first()[0]) is not None:
        part = F.col("_x") if most <= CELL else F.floor((F.col("_x") - F.col("_low")) / (F.col("_high") - F.col("_low")) * SPLIT)
        state = kept.filter("_low < _high").withColumn("_cell", F.row_number().over(Window.partitionBy(*ids).orderBy("_low")))
        state = stage(state)
        hist = _counted(_inside(values, ids, state, width), [*ids, "_cell"], part)
        kept = stage(_narrowed(hist, ids, state.select(*ids, "_cell", "_below", "_ranks"), width))
        found.append(_values(kept, ids))
    return found


def _place(q, n):
    """Zero-based lower rank, upper rank and weight of the upper one."""
    at = (n - 1) * q
    low = F.floor(at)
    return low, F.least(low + 1, n - 1), at - low


def _slot(q, n):
    places = ("low", "high", "weight"), ("long", "long", "double")
    return F.struct(*[v.cast(t).alias(k) for k, t, v in zip(*places, _place(q, n))])


def _counted(rows, by, part):
    """Size, smallest and largest value of each part."""
    return rows.groupBy(*by, part.alias("_part")).agg(F.sum("_w").alias("_n"), F.min("_x").alias("_low"), F.max("_x").alias("_high"))


def _narrowed(parts, ids, state, width, *carried):
    """The parts that hold wanted ranks: with their values' bounds and number, the rows below and those ranks.

    ``state`` has the wanted ranks of each cell, ascending. A cell has some dozen parts (regions), ``SPLIT``, or at most CELL
    values; a few of them are looked up by each part.
    """
    cell = [*ids, "_cell"]
    over = Window.partitionBy(*cell).orderBy("_low").rowsBetween(Window.unboundedPreceding, 0)
    rows = parts.join(state, cell).withColumn("_upto", F.col("_below") + F.sum("_n").over(over) - 1)
    rows = rows.withColumn("_from", F.col("_upto") - F.col("_n"))
    rows = count_passed(rows, {"_first": ("_from", "_ranks"), "_last": ("_upto", "_ranks")}, width)
    return rows.filter("_last > _first").select(
        *ids, "_low", "_high", "_n", (F.col("_from") + 1).alias("_below"), F.slice("_ranks", F.col("_first") + 1, F.col("_last") - F.col("_first")).alias("_ranks"), *carried
    )


def _values(kept, ids):
    return kept.filter("_low = _high").select(*ids, F.explode("_ranks").alias("_rank"), F.col("_low").alias("_value"))


def _inside(long, ids, state, width):
    """The values that lie in a cell of ``state``, with its number and bounds."""
    arrays = state.groupBy(*ids).agg(F.array_sort(F.collect_list(F.struct("_low", "_high", "_cell"))).alias("_cells"))
    arrays = stage(arrays.select(*ids, F.col("_cells._low").alias("_lows"), "_cells"))
    rows = lookup(long.filter(F.col("_x").isNotNull()), arrays, ids, "inner", row_bytes(4 * width))
    rows = count_passed(rows, {"_at": ("_x", "_lows")}, width)
    rows = rows.withColumn("_own", F.get("_cells", F.col("_at") - 1)).filter(F.col("_x") <= F.col("_own._high"))
    return rows.select(*ids, "_x", "_w", "_own._cell", "_own._low", "_own._high")
