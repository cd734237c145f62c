"""The tables behind the diagnostic figures."""

import math

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..defaults import DATA_OFFSET, MODELS, REF_VALUE, THRESHOLD, THRESHOLDS, TOL, VALUE
from ..functions.expr import between_ranks, check_free, clean_number, own_method, ratio, total, with_row_stats
from ..plans.levels import count_passed
from ..plans.quantiles import exact_quantiles
from ..plans.staging import lookup, row_bytes, stage
from .cards import card_levels, cards, falling, level_columns
from .errors import basic_stats, dataset_keys, is_modified, value_diffs
from .features import histogram

STATS = ("p_median", "p_mean", "p_std", "d_mean_a", "d_mean_r", "d_median_a", "d_median_r")
CELLS = 1024  # of values, where medians of many groups are looked for at once
EIGHTHS = (0.0, 0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875, 1.0)


def injected_deltas(df: DataFrame, edges, value=VALUE, ref=REF_VALUE, keys=None) -> DataFrame:
    """Histogram per dataset of the differences to the reference that are not zero."""
    keys = dataset_keys(df, keys)
    changed = value_diffs(df, value, ref).filter(F.abs("delta") > TOL)
    return histogram(changed, "delta", edges, keys)


def bin_values(df: DataFrame, column: str, edges, out="bin_val") -> DataFrame:
    """Adds the edge that stands for a value's right-open bin, to three digits.

    A bin is named by its upper edge; below the first edge the lowest, from the last on the
    highest. A missing value, NULL or NaN, goes to the highest as well.
    """
    check_free(df, "_x", "_edges", "_bin")
    edges = [float(e) for e in edges]
    inner = [round(edges[i], 3) for i in range(1, len(edges))]
    names = [round(min(edges), 3), *inner, round(max(edges), 3)]
    rows = df.withColumns({"_x": F.coalesce(clean_number(column), F.lit(float("inf"))), "_edges": F.array(*map(F.lit, edges))})
    rows = count_passed(rows, {"_bin": ("_x", "_edges")}, len(edges))
    return rows.withColumn(out, F.get(F.array(*map(F.lit, names)), F.col("_bin"))).drop("_x", "_edges", "_bin")


def binned_error_profile(df: DataFrame, edges, models=MODELS, value=VALUE) -> DataFrame:
    """Share of entries and median error of the median prediction in each value bin."""
    rows = bin_values(basic_stats(df, models, None, value), value, edges).select("bin_val", "d_median_a")
    binned = exact_quantiles(rows, ["bin_val"], ["d_median_a"], [0.5], "skip")
    whole = F.sum("n_rows").over(Window.partitionBy())  # over one row per bin
    return binned.select(
        "bin_val", F.col("n_rows").alias("n"), (F.col("n_rows") / whole).alias("share"), F.get("d_median_a", 0).alias("median_error")
    )


def _regression(x, y):
    return [
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        F.regr_r2(y, x).alias("r2"),
    ]


def inner_bins(df: DataFrame, edges, models=MODELS, value=VALUE) -> DataFrame:
    """The binned profile without its first and last bin."""
    bins = stage(binned_error_profile(df, edges, models, value))
    ends = bins.agg(F.min("bin_val").alias("low"), F.max("bin_val").alias("high"))
    return bins.filter((F.col("bin_val") > ends.select("low").scalar()) & (F.col("bin_val") < ends.select("high").scalar()))


def error_regression(df: DataFrame, edges, models=MODELS, value=VALUE) -> DataFrame:
    """Error of the median prediction against the value: over entries, and over inner bin medians."""
    raw = basic_stats(df, models, None, value).agg(*_regression(F.col(value), F.col("d_median_a")))
    medians = inner_bins(df, edges, models, value).agg(*_regression(F.col("bin_val"), F.col("median_error")))
    return raw.withColumn("fit", F.lit("entries")).unionByName(medians.withColumn("fit", F.lit("bin_medians")))


def slope_statistics(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: ``slope``, its standard error ``stderr``, ``t`` and degrees of freedom ``dof`` of y on x."""
    pair = F.col(x).isNotNull() & F.col(y).isNotNull()
    sums = df.agg(
        F.regr_slope(y, x).alias("slope"), F.regr_sxx(y, x).alias("_sxx"), F.regr_syy(y, x).alias("_syy"), F.regr_sxy(y, x).alias("_sxy"),
        (F.count_if(pair) - 2).alias("dof"),
    )
    rest = F.col("_syy") - F.col("slope") * F.col("_sxy")
    stderr = F.when((F.col("dof") > 0) & (F.col("_sxx") > 0), F.sqrt(F.greatest(rest, F.lit(0.0)) / F.col("dof") / F.col("_sxx")))
    return sums.withColumn("stderr", stderr).select("slope", "stderr", (F.col("slope") / F.nullif(F.col("stderr"), F.lit(0.0))).alias("t"), "dof")


def _log_gamma(z):
    """ln Gamma of a positive column: Stirling's series after eight steps up."""
    up = z + 8
    series = (up - 0.5) * F.ln(up) - up + 0.5 * math.log(2 * math.pi) + 1 / (12 * up) - 1 / (360 * up * up * up) + 1 / (1260 * up * up * up * up * up)
    return series - total([F.ln(z + i) for i in range(8)])


def _beta_fraction(a, b, x, steps):
    """The continued fraction of the incomplete beta function, which converges for x below (a + 1) / (a + b + 2)."""
    sure = lambda v: F.when(F.abs(v) < 1e-300, F.lit(1e-300)).otherwise(v)
    first = 1 / sure(1 - (a + b) * x / (a + 1))
    start = F.struct(F.lit(1.0).alias("c"), first.alias("d"), first.alias("h"))

    def step(s, j):
        m = F.floor(j / 2).cast("double")
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        factor = F.when(j % 2 == 0, even).otherwise(odd)
        c, d = sure(1 + factor / s["c"]), 1 / sure(1 + factor * s["d"])
        return F.struct(c.alias("c"), d.alias("d"), (s["h"] * c * d).alias("h"))

    return F.aggregate(F.sequence(F.lit(2), F.lit(steps)), start, step)["h"]


def incomplete_beta(a, b, x, steps=2000):
    """Regularised incomplete beta function I_x(a, b) as a column. Some sqrt(max(a, b)) steps make it exact to about nine digits."""
    front = F.exp(_log_gamma(a + b) - _log_gamma(a) - _log_gamma(b) + a * F.ln(x) + b * F.ln(1 - x))
    near = x < (a + 1) / (a + b + 2)
    inside = F.when(near, front * _beta_fraction(a, b, x, steps) / a).otherwise(1 - front * _beta_fraction(b, a, 1 - x, steps) / b)
    return F.when(x <= 0, F.lit(0.0)).when(x >= 1, F.lit(1.0)).otherwise(inside)


def with_p_value(stats: DataFrame, t="t", dof="dof", out="p") -> DataFrame:
    """Adds the two-sided p of Student's t with its degrees of freedom; NULL without them, 0 for an infinite t."""
    check_free(stats, "_dof", "_x")
    rows = stats.withColumn("_dof", F.when(F.col(dof) > 0, F.col(dof).cast("double")))
    rows = rows.withColumn("_x", F.col("_dof") / (F.col("_dof") + F.col(t) * F.col(t)))
    return rows.withColumn(out, incomplete_beta(F.col("_dof") / 2, F.lit(0.5), F.col("_x"))).drop("_dof", "_x")


def regression_p_values(df: DataFrame, edges, models=MODELS, value=VALUE) -> DataFrame:
    """Slope, its statistics and p of the error against the value: over entries, and over inner bin medians."""
    entries = slope_statistics(basic_stats(df, models, None, value).select(value, "d_median_a"), value, "d_median_a")
    medians = slope_statistics(inner_bins(df, edges, models, value), "bin_val", "median_error")
    return with_p_value(entries.withColumn("fit", F.lit("entries")).unionByName(medians.withColumn("fit", F.lit("bin_medians"))))


def slope_p_value(df: DataFrame, x: str, y: str) -> float:
    """Two-sided p of a regression slope."""
    points = VectorAssembler(inputCols=[x], outputCol="_x").transform(df.select(x, y).dropna())
    fit = LinearRegression(featuresCol="_x", labelCol=y, solver="normal").fit(points)
    return fit.summary.pValues[0]


def model_error_summary(
    df: DataFrame, ref=None, original=None, models=MODELS, value=VALUE, data_offset=DATA_OFFSET,
    keys=None, split_modified=True, with_own=True,
) -> DataFrame:
    """Mean and median error per dataset and model against several kinds of reference.

    ``ref_type``: ``mod`` against the recorded values, ``noisy`` against the column ``ref``,
    ``base`` against the column ``original``. All errors of a row are columns of that row, so
    nothing is multiplied or joined before aggregation.
    """
    keys = dataset_keys(df, keys)
    targets = {}
    if with_own and (ref is not None or original is None):
        targets["mod"] = value
    if ref is not None:
        targets["noisy"] = ref
    if original is not None:
        targets["base"] = original
    cells, sizes, ratios = [], {}, {}
    for kind, target in targets.items():
        for m in models:
            size, share = f"_a{len(cells)}", f"_r{len(cells)}"
            sizes[size] = F.abs(clean_number(m) - clean_number(target))
            ratios[share] = F.abs(ratio(F.col(size), F.col("_den")))
            cells += [(kind, m, "delta_abs", size), (kind, m, "delta_rel", share)]
    ids = [*keys, "modified"] if split_modified and ref is not None else keys
    rows = df.withColumn("modified", is_modified(value, ref)) if ref is not None else df
    rows = with_row_stats(rows, models, "_median").withColumn("_den", F.col("_median") + F.lit(data_offset))
    rows = own_method(own_method(rows.withColumns(sizes)).withColumns(ratios)).select(*ids, *sizes, *ratios)
    return _mean_and_median(rows, ids, cells, ("ref_type", "model_name", "delta_type"))


def _mean_and_median(rows, ids, cells, labels):
    """Long table of mean and median of many columns per group. ``cells``: (label..., column)."""
    names = [c[-1] for c in cells]
    means = rows.groupBy(*ids).agg(*[F.avg(n).alias(f"_mean{n}") for n in names])
    medians = stage(exact_quantiles(rows, ids, names, [0.5], "skip"))
    both = lookup(means, medians, ids, "inner", row_bytes(3 * len(names)))
    out = F.array(
        *[
            F.struct(
                *[F.lit(v).alias(k) for k, v in zip(labels, cell[:-1])],
                F.lit(agg).alias("agg"),
                (F.col(f"_mean{cell[-1]}") if agg == "mean" else F.get(cell[-1], 0)).alias("value"),
            )
            for cell in cells
            for agg in ("mean", "median")
        ]
    )
    return both.select(*ids, F.inline(out))


def group_sizes(
    df: DataFrame, ref=None, models=MODELS, threshold=THRESHOLD, data_offset=DATA_OFFSET, group_stat="abs",
    groups=None, value=VALUE, keys=None,
) -> DataFrame:
    """Number of entries per dataset, known state and group."""
    keys = dataset_keys(df, keys)
    kind = group_stat if group_stat in ("abs", "rel", "both", "norm") else "abs"
    ids = list(keys)
    if ref is not None:
        df = df.withColumn("modified", is_modified(value, ref))
        ids.append("modified")
    marked = cards(df, models, threshold, data_offset, ("abs" if kind == "norm" else kind,), value, keys)
    sizes = marked.groupBy(*ids, F.col(f"cards_{kind}").alias("group_no")).agg(F.count("*").alias("size"))
    return sizes if groups is None else sizes.filter(F.col("group_no").isin(list(groups)))


def group_size_histogram(sizes: DataFrame, n_models=len(MODELS)) -> DataFrame:
    """The same with every group 0..n present."""
    ids = [c for c in sizes.columns if c not in ("group_no", "size")]
    found = sizes.groupBy(*ids).agg(F.map_from_entries(F.collect_list(F.struct("group_no", "size"))).alias("_found"))
    groups = F.array(*[F.lit(g) for g in range(n_models + 1)])
    return found.select(*ids, "_found", F.explode(groups).alias("group_no")).select(
        *ids, "group_no", F.coalesce(F.try_element_at("_found", F.col("group_no")), F.lit(0)).alias("size")
    )


def group_statistics(
    df: DataFrame, ref=None, models=MODELS, thresholds=THRESHOLD, data_offset=DATA_OFFSET, group_stat="abs",
    groups=None, value=VALUE, keys=None, own_reference=False,
) -> DataFrame:
    """Entries with group, prediction statistics and each model's error ``err_<model>``.

    Errors are against ``ref`` if given, or the recorded values with ``own_reference``.
    Everything is local to the row once the cutoffs are known.
    """
    kind = group_stat if group_stat in ("abs", "rel", "both", "norm") else "abs"
    target = value if own_reference or ref is None else ref
    counted = "abs" if kind == "norm" else kind
    marked = cards(df, models, thresholds, data_offset, (counted,), value, keys)
    out = basic_stats(marked, models, target, value, data_offset)
    out = out.withColumns({f"err_{m}": F.abs(clean_number(m) - clean_number(target)) for m in models})
    out = out.withColumn("group_no", F.col(f"cards_{kind}")).drop(f"cards_{counted}", "cards_norm")
    if ref is not None:
        out = out.withColumn("modified", is_modified(value, ref))
    return out if groups is None else out.filter(F.col("group_no").isin(list(groups)))


def group_labels(stats: DataFrame, n_models=len(MODELS), split_last=False) -> DataFrame:
    """Adds the group as text; with ``split_last`` the top group is told apart by known state."""
    label = F.col("group_no").cast("string")
    if split_last:
        state = F.when(F.col("modified"), F.lit("\nMod")).otherwise(F.lit("\nUnmod"))
        label = F.when(F.col("group_no") == n_models, F.concat(label, state)).otherwise(label)
    return stats.withColumn("group", label)


def group_means(stats: DataFrame, stat: str, keys=None) -> DataFrame:
    """Mean of one statistic per group, over all entries and by known state.

    Sums per state come first; the ``All`` rows are made from those few sums.
    """
    keys = dataset_keys(stats, keys)
    sums = stats.groupBy(*keys, "group_no", "modified").agg(F.sum(stat).alias("_sum"), F.count(stat).alias("_n"))
    types = F.array(F.lit("All"), F.when(F.col("modified"), F.lit("Modified")).otherwise(F.lit("Unmodified")))
    return (
        sums.select(*keys, "group_no", "_sum", "_n", F.explode(types).alias("type"))
        .groupBy(*keys, "group_no", "type")
        .agg((F.sum("_sum") / F.nullif(F.sum("_n"), F.lit(0))).alias("mean"), F.sum("_n").alias("n"))
    )


def group_aggregates(stats: DataFrame, columns=STATS, keys=None, split_modified=False) -> DataFrame:
    """Mean and median of statistics per dataset, threshold and group, in long form."""
    ids = [*dataset_keys(stats, keys), "threshold_pct", "group_no", *(["modified"] if split_modified else [])]
    cells = [(c, c) for c in columns]
    rows = stats.select(*ids, *[F.col(c).alias(c) for c in columns])
    return _mean_and_median(rows, ids, cells, ("stat",))


def group_aggregates_grid(
    df: DataFrame, ref=None, models=MODELS, thresholds=THRESHOLDS, data_offset=DATA_OFFSET, group_stat="abs",
    columns=STATS, value=VALUE, keys=None, split_modified=False, null_policy="poison",
) -> DataFrame:
    """``group_aggregates`` of ``group_statistics`` over many thresholds, without a row for each threshold.

    A row is in group g at the thresholds between its (g + 1)-th and its g-th largest level: one stretch a group, most of them
    empty. Rows are counted and summed up by stretch and cell of values, the cells cut by a sketch; only these counts
    meet the thresholds. They give all means, and the cell that holds each median. Rows of those cells are then counted by
    value. A cell has about a ``CELLS``-th of a dataset's rows, and its distinct values meet in one task.
    """
    keys, steps = dataset_keys(df, keys), falling(thresholds)
    kind = group_stat if group_stat in ("abs", "rel", "both") else "abs"
    ids, columns = [*keys, *(["modified"] if split_modified else [])], list(columns)
    rows = basic_stats(df, models, value if ref is None else ref, value, data_offset)
    rows = rows.withColumn("modified", is_modified(value, ref)) if split_modified else rows
    rows = card_levels(rows, models, steps, [float(data_offset)], (kind,), value, keys, null_policy, [*ids, *columns])
    levels = [F.lit(len(steps)), F.sort_array(F.array(*level_columns(models, kind)), asc=False), F.lit(0)]
    rows = rows.select(*ids, F.concat(F.array(levels[0]), levels[1], F.array(levels[2])).alias("_s"), *[clean_number(c).alias(f"_v{i}") for i, c in enumerate(columns)])
    rows = stage(rows.dropna(subset=keys) if keys else rows)

    shares = F.array(*[F.lit(i / CELLS) for i in range(1, CELLS)])
    sketches = rows.groupBy(*keys).agg(*[F.kll_sketch_agg_double(f"_v{i}", F.lit(4096)).alias(f"_v{i}") for i in range(len(columns))])
    edges = [F.struct(F.lit(i).alias("_c"), F.array_distinct(F.kll_sketch_get_quantile_double(f"_v{i}", shares)).alias("_edges")) for i in range(len(columns))]
    edges = stage(sketches.select(*keys, F.inline(F.array(*edges))))
    long = rows.select(*ids, "_s", F.inline(F.array(*[F.struct(F.lit(i).alias("_c"), F.col(f"_v{i}").alias("_x")) for i in range(len(columns))])))
    long = count_passed(lookup(long, edges, [*keys, "_c"], "left", row_bytes(CELLS)), {"_cell": ("_x", "_edges")}, CELLS)
    stretch = lambda g: F.struct(F.lit(g).alias("_g"), F.get("_s", g + 1).alias("_lo"), F.get("_s", g).alias("_hi"))
    stretches = F.filter(F.array(*[stretch(g) for g in range(len(models) + 1)]), lambda e: e["_lo"] < e["_hi"])
    long = long.select(*ids, "_c", "_x", "_cell", F.inline(stretches))

    by, one = [*ids, "_c"], [*ids, "_c", "_i", "_g"]
    counts = stage(long.groupBy(*by, "_g", "_lo", "_hi", "_cell").agg(F.count("_x").alias("_n"), F.sum("_x").alias("_sum")))
    counts = counts.withColumn("_i", F.explode(F.sequence("_lo", F.col("_hi") - 1))).groupBy(*one, "_cell").agg(F.sum("_n").alias("_n"), F.sum("_sum").alias("_sum"))
    over = Window.partitionBy(*one)
    counts = counts.withColumns(
        {
            "_size": F.sum("_n").over(over), "_mean": F.sum("_sum").over(over) / F.nullif(F.sum("_n").over(over), F.lit(0)),
            "_upto": F.sum("_n").over(over.orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0)),
        }
    )
    counts = stage(counts)
    means = counts.groupBy(*one).agg(F.first("_mean").alias("_mean"), F.first("_size").alias("_size"))
    low, high = F.floor((F.col("_size") - 1) / 2), F.floor(F.col("_size") / 2)
    wanted = counts.withColumn("_from", F.col("_upto") - F.col("_n")).filter((F.col("_from") <= high) & (F.col("_upto") > low) & (F.col("_n") > 0))
    wanted = stage(wanted.select(*one, "_cell", "_from", low.alias("_low"), high.alias("_high")))

    cells = stage(wanted.select(*by, "_cell").distinct())
    fine = lookup(long.filter(F.col("_x").isNotNull()), cells, [*by, "_cell"], "inner").groupBy(*by, "_g", "_lo", "_hi", "_cell", "_x").agg(F.count("*").alias("_n"))
    fine = fine.join(wanted, [*by, "_g", "_cell"]).filter((F.col("_i") >= F.col("_lo")) & (F.col("_i") < F.col("_hi")))
    fine = fine.groupBy(*one, "_cell", "_x").agg(F.sum("_n").alias("_n"), *[F.first(c).alias(c) for c in ("_from", "_low", "_high")])
    upto = F.sum("_n").over(Window.partitionBy(*one, "_cell").orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)) + F.col("_from")
    fine = fine.withColumn("_upto", upto).withColumn("_before", F.col("_upto") - F.col("_n"))
    holds = lambda rank: F.max(F.when((F.col("_before") <= F.col(rank)) & (F.col("_upto") > F.col(rank)), F.col("_x")))
    medians = fine.groupBy(*one).agg(holds("_low").alias("_a"), holds("_high").alias("_b"))
    weight = F.when(F.col("_size") % 2 == 0, F.lit(0.5)).otherwise(F.lit(0.0))
    both = means.join(medians, one, "left").withColumn("_median", between_ranks(F.col("_a"), F.col("_b"), weight))
    label = lambda values, at: F.get(F.array(*map(F.lit, values)), F.col(at))
    out = F.array(*[F.struct(F.lit(a).alias("agg"), F.col(f"_{a}").alias("value")) for a in ("mean", "median")])
    return both.select(*ids, label(steps, "_i").alias("threshold_pct"), F.col("_g").alias("group_no"), label(columns, "_c").alias("stat"), F.inline(out))


def clipped_density(stats: DataFrame, stat: str, group="group_no", bins=50, upper=0.99) -> DataFrame:
    """Density of a statistic per group on equal bins from 0 to its overall ``upper`` quantile.

    Values outside are left out; each group's density covers its counted rows.
    """
    rows = stats.select(F.col(group), F.col(stat).alias("_x"))
    top = exact_quantiles(rows, [], ["_x"], [upper], "skip").select(F.get("_x", 0).alias("top"))
    inner = F.transform(F.array(*[F.lit(i) for i in range(bins)]), lambda i: i * (F.col("top") / bins))
    edges = stage(top.select(F.concat(inner, F.array("top")).alias("edges"))).scalar()  # made once, not per row
    rows = rows.withColumn("_edges", edges).withColumn("_top", F.get("_edges", bins))
    rows = count_passed(rows, {"_bin": ("_x", "_edges")}, bins + 1)
    at = F.when(F.col("_x") == F.col("_top"), F.lit(bins - 1)).otherwise(F.col("_bin") - 1)
    counts = (
        rows.select(group, at.alias("bin"), "_top")
        .filter(F.col("bin").between(0, bins - 1))
        .groupBy(group, "bin")
        .agg(F.count("*").alias("n"), F.first("_top").alias("_top"))
    )
    width = F.col("_top") / bins
    whole = counts.groupBy(group).agg(F.sum("n").alias("_whole"))  # one row per group
    return counts.join(whole, group).select(
        group, "bin", "n", (F.col("bin") * width).alias("left_edge"), (F.col("n") / (F.col("_whole") * width)).alias("density")
    )


def distribution_summary(stats: DataFrame, columns, ids, qs=EIGHTHS) -> DataFrame:
    """Quantiles per group for box-like figures, in long form."""
    ids, columns = list(ids), list(columns)
    found = exact_quantiles(stats, ids, columns, qs, "skip")
    rows = F.array(
        *[F.struct(F.lit(c).alias("stat"), F.lit(float(q)).alias("q"), F.get(c, i).alias("value")) for c in columns for i, q in enumerate(qs)]
    )
    return found.select(*ids, F.col("n_rows").alias("n"), F.inline(rows))


def size_annotations(stats: DataFrame, facets=(), split_modified=False) -> DataFrame:
    """Counts by facet, group and, if asked, known state, sorted."""
    ids = [*facets, "group_no", *(["modified"] if split_modified else [])]
    return stats.groupBy(*ids).agg(F.count("*").alias("n")).orderBy(*ids)
