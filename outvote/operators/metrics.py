"""How well the groups of equally marked entries match the entries known to be wrong."""

from functools import reduce

import numpy as np
from numpy import concatenate, geomspace
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..defaults import DATA_OFFSET, DATA_OFFSETS, ENTRY_ID, MODELS, REF_VALUE, THRESHOLD, THRESHOLDS, TOL, VALUE
from ..functions.expr import INF, clean_number, f1_columns, ratio, total
from ..plans.batches import FEW, level_counts
from ..plans.levels import count_passed
from ..plans.quantiles import exact_quantiles, quantiles_in_batches
from ..plans.staging import lookup, row_bytes, stage
from .cards import as_list, card_levels, card_quantiles, cut_arrays, falling, level_columns, with_errors
from .errors import align_reference, basic_stats, dataset_keys, is_modified

# The names of the metrics.
METRICS = ("group_len", "group_pos", "group_ratio", "group_pos_ratio", "precision", "recall", "f1")


def _with_truth(df, reference, value, keys, models=None):
    """Rows that belong to a dataset, with the flag of known errors.

    ``reference`` is the name of an aligned column or a frame with (id, value). The join with a frame is done
    once and staged, with no more columns than ``models`` and the others that metrics need.
    """
    if isinstance(reference, DataFrame):
        needed = df.columns if models is None else dict.fromkeys([ENTRY_ID, value, *keys, *models])
        df, reference = stage(align_reference(df.select(*needed), reference, value)), REF_VALUE
    df = df.withColumn("_mod", is_modified(value, reference))
    return df.dropna(subset=keys) if keys else df


def _pos(count="cnt"):
    return F.sum(F.when(F.col("_mod"), F.col(count)).otherwise(0))


def _metric_frame(counts, keep):
    """Adds the metric columns to group_len, group_pos, ds_pos, ds_len."""
    columns = f1_columns(F.col("group_pos"), F.col("group_len"), F.col("ds_pos"), F.col("ds_len"), TOL)
    return counts.select(*keep, "group_len", "group_pos", *[c.alias(n) for n, c in columns.items()])


def dataset_totals(df: DataFrame, reference=REF_VALUE, value=VALUE, data_offsets=DATA_OFFSET, keys=None) -> DataFrame:
    """Known errors, other entries and size of every dataset, once per offset."""
    keys = dataset_keys(df, keys)
    rows = _with_truth(df, reference, value, keys)
    totals = rows.groupBy(*keys).agg(
        F.count_if("_mod").alias("ds_pos"), F.count_if(~F.col("_mod")).alias("neg_ds"), F.count("*").alias("ds_len")
    )
    offsets = F.array(*map(F.lit, as_list(data_offsets)))
    return totals.select(*keys, F.explode(offsets).alias("data_offset"), "ds_pos", "neg_ds", "ds_len")


def _at_least_counts(rows, keys, levels):
    """Rows with at least g marks: one row per dataset, offset number, known error, g and level.

    The g-th largest level of a row says at how many thresholds it has g or more marks, so
    m small histograms per dataset hold every group at every threshold. Rows are never
    multiplied by thresholds, and the counts combine before they are shuffled.
    """
    base = rows.select(*keys, "_j", "_mod", F.sort_array(F.array(*levels), asc=False).alias("_s"))
    return (
        base.select(*keys, "_j", "_mod", F.posexplode("_s").alias("_g", "_level"))
        .groupBy(*keys, "_j", "_mod", (F.col("_g") + 1).alias("_g"), "_level")
        .agg(F.count("*").alias("cnt"))
    )


def classification_metrics(
    df: DataFrame, reference=REF_VALUE, models=MODELS, thresholds=THRESHOLD, data_offsets=DATA_OFFSET,
    group_stat="abs", value=VALUE, keys=None, complete=True, null_policy="poison",
) -> DataFrame:
    """Size, precision, recall and F1 of each exact group, per dataset, threshold and offset.

    ``complete`` adds all-zero rows for every combination of the key, threshold, offset and
    group values that occur. An unknown ``group_stat`` means ``abs``; ``norm`` puts all rows
    into group 0.
    """
    keys, offsets, given = dataset_keys(df, keys), as_list(data_offsets), as_list(thresholds)
    steps, models = falling(given), list(models)
    kind = group_stat if group_stat in ("abs", "rel", "both", "norm") else "abs"
    rows = _with_truth(df, reference, value, keys, models)
    n_models = len(models)
    if kind == "norm":
        rows, levels = rows.withColumn("_j", F.lit(0)), [F.lit(0)] * n_models
    else:
        rows = card_levels(rows, models, steps, offsets, (kind,), value, keys, null_policy, [*keys, "_mod"])
        levels = level_columns(models, kind)
    # Absolute errors do not depend on the offset: count once, label with all.
    shared = kind in ("abs", "norm")
    marks = _at_least_counts(rows, keys, levels)
    return _metrics_from_marks(marks, keys, steps, offsets, n_models, shared, complete)


def _metrics_from_marks(marks, keys, steps, offsets, n_models, shared, complete):
    # The m histograms of a dataset become one row: level counts for each g, split by truth.
    by_threshold = F.array(*[F.struct(F.lit(i).alias("_i"), F.lit(t).alias("threshold_pct")) for i, t in enumerate(steps)])
    passed = (
        marks.select(*keys, "_j", "_mod", "cnt", "_g", "_level", F.inline(by_threshold))
        .groupBy(*keys, "_j", "threshold_pct", "_g")
        .agg(
            F.sum(F.when(F.col("_level") > F.col("_i"), F.col("cnt")).otherwise(0)).alias("_len"),
            F.sum(F.when(F.col("_mod") & (F.col("_level") > F.col("_i")), F.col("cnt")).otherwise(0)).alias("_pos"),
            F.sum("cnt").alias("ds_len"),
            _pos().alias("ds_pos"),
        )
        .groupBy(*keys, "_j", "threshold_pct")
        .agg(
            F.sort_array(F.collect_list(F.struct("_g", "_len", "_pos"))).alias("_marks"),
            F.max("ds_len").alias("ds_len"),
            F.max("ds_pos").alias("ds_pos"),
        )
    )

    def upto(field, g, whole):
        return F.col(whole) if g == 0 else F.get("_marks", g - 1)[field]

    def exactly(field, g, whole):
        above = upto(field, g + 1, whole) if g < n_models else F.lit(0)
        return upto(field, g, whole) - above

    groups = F.array(
        *[
            F.struct(
                F.lit(g).alias("group_no"),
                exactly("_len", g, "ds_len").alias("group_len"),
                exactly("_pos", g, "ds_pos").alias("group_pos"),
            )
            for g in range(n_models + 1)
        ]
    )
    labels = F.array(*[F.struct(F.lit(d).alias("data_offset")) for d in offsets])
    labels = labels if shared else F.array(F.get(labels, F.col("_j")))
    counted = (
        passed.select(*keys, "threshold_pct", "ds_len", "ds_pos", F.inline(groups), labels.alias("_labels"))
        .filter("group_len > 0")
        .select("*", F.inline("_labels"))
    )
    names = ["threshold_pct", *keys, "data_offset", "group_no"]
    metrics = _metric_frame(counted, names)
    return complete_domain(metrics, names) if complete else metrics


def complete_domain(metrics: DataFrame, names) -> DataFrame:
    """All combinations of the values seen in ``names``; metrics that were not there become 0.

    The product of the distinct thresholds, offsets, groups and dataset labels is the result asked
    for; it is built from one distinct list a label, none of which has to fit into a row.
    """
    metrics = stage(metrics)
    domain = reduce(DataFrame.crossJoin, [metrics.select(n).filter(F.col(n).isNotNull()).distinct() for n in names])
    return domain.join(metrics, list(names), "left").na.fill(0)


def group_slice(metrics: DataFrame, group_no: int) -> DataFrame:
    """The metrics of one group."""
    return metrics.filter(F.col("group_no") == group_no).drop("group_no")


def subsets(models):
    """All non-empty model subsets as (bit mask, size, label), smaller ones first."""
    models = list(models)
    masks = range(1, 1 << len(models))
    picked = {b: [i for i in range(len(models)) if b >> i & 1] for b in masks}
    order = sorted(masks, key=lambda b: (len(picked[b]), picked[b]))
    return [(b, len(picked[b]), ";".join(models[i] for i in picked[b])) for b in order]


def _level_patterns(rows, keys, models):
    """Rows by known error and the models' levels: the distinct ones, counted."""
    return rows.groupBy(*keys, "_mod", *[f"_k_abs_{m}" for m in models]).agg(F.count("*").alias("cnt"))


def _subset_counts(rows, keys, models, offset, least=1):
    """Top-group counts of all subsets from one histogram of mark patterns (at most 2^m per dataset).

    ``rows`` has counted level patterns; a model marks from level ``least`` on.
    """
    mask = total([(F.col(f"_k_abs_{m}") >= least).cast("int") * (1 << i) for i, m in enumerate(models)])
    patterns = rows.groupBy(*keys, "_mod", mask.alias("_mask")).agg(F.sum("cnt").alias("cnt"))
    choices = F.array(
        *[
            F.struct(F.lit(b).alias("_bits"), F.lit(n).alias("n_models"), F.lit(label).alias("model_combo"), F.lit(i).alias("combo_no"))
            for i, (b, n, label) in enumerate(subsets(models))
        ]
    )
    hit = F.when(F.col("_mask").bitwiseAND(F.col("_bits")) == F.col("_bits"), F.col("cnt")).otherwise(0)
    return (
        patterns.select("*", F.inline(choices))
        .groupBy("n_models", "model_combo", "combo_no", *keys)
        .agg(
            F.sum(hit).alias("group_len"),
            F.sum(F.when(F.col("_mod"), hit).otherwise(0)).alias("group_pos"),
            _pos().alias("ds_pos"),
            F.sum("cnt").alias("ds_len"),
        )
        .withColumn("data_offset", F.lit(float(offset)))
    )


def _subset_errors(n_models, masks, offset, sizes):
    """What makes a row's errors in Arrow batches, from its value and predictions: of all models by ``sizes``, then relative to each subset's median.

    The same operations as in columns: an error over a zero denominator ranks highest, and none is left of 0 / 0. ``absent`` gets, for
    each column, where its NaN stand for a missing number, or None; other NaN come from infinities.
    """
    members = [[i for i in range(n_models) if bits >> i & 1] for bits in masks]

    def middle(own, holes):
        """Mean of the middle one or two predictions of each row, of those present."""
        lanes = list(own)
        if any(hole is not None for hole in holes):
            lanes = [x if hole is None else np.where(hole, np.inf, x) for x, hole in zip(own, holes)]  # missing ones come last
        for i in range(len(lanes)):
            for k in range(i % 2, len(lanes) - 1, 2):
                lanes[k], lanes[k + 1] = np.minimum(lanes[k], lanes[k + 1]), np.maximum(lanes[k], lanes[k + 1])
        if all(hole is None for hole in holes):
            return (lanes[(len(lanes) - 1) // 2] + lanes[len(lanes) // 2]) / 2
        n = len(lanes) - sum(hole.astype("int8") for hole in holes if hole is not None)
        out = np.full(len(n), np.nan)
        for k in np.unique(n[n > 0]).tolist():
            out = np.where(n == k, (lanes[(k - 1) // 2] + lanes[k // 2]) / 2, out)
        return out

    def make(columns, absent=None):
        y, given = columns[0], columns[1:]
        holes = [hole if hole.any() else None for hole in map(np.isnan, given)]
        with np.errstate(all="ignore"):
            errors = [np.abs(m - y) for m in given]

        def lost(i):
            return np.isnan(y) | np.isnan(given[i])

        def told(x, i, nothing):
            if absent is not None:
                none = np.isnan(x)
                absent.append(none & (lost(i) | nothing) if none.any() else None)
            return x

        for i in range(n_models if sizes else 0):
            yield told(errors[i], i, False)
        for own in members:
            with np.errstate(all="ignore"):
                under = middle([given[i] for i in own], [holes[i] for i in own]) + offset
            zero = under == 0
            zeros = zero.any()
            for i in own:
                with np.errstate(all="ignore"):
                    x = errors[i] / under
                if zeros:
                    x = np.where(zero, np.where(lost(i) | (errors[i] == 0), np.nan, np.inf), x)
                yield told(x, i, zero & (errors[i] == 0) if zeros else False)

    return make


def _subset_levels(rows, keys, models, chosen, steps, offset, kind, value, null_policy):
    """Counted rows ``keys, n_models, model_combo, combo_no, _mod, _level``: at how many thresholds all models of a subset mark them.

    Relative errors are taken from the median of the subset's own predictions; absolute errors do not depend on the subset. All of them are
    made in Arrow batches, once for the cutoffs, in one request, and once for the counts, so that rows are never multiplied by subsets outside
    of numpy's columns. With too many datasets for that they are rows of their own (``_joined_subset_levels``).
    """
    sizes = len(models) if kind == "both" else 0
    width = sizes + sum(n for _, n, _ in chosen)
    given = {"_y": clean_number(value)} | {f"_m{i}": clean_number(m) for i, m in enumerate(models)}
    found = rows.select(*keys).distinct() if keys else rows.sparkSession.range(1).select()
    datasets = stage(found.withColumn("_d", F.monotonically_increasing_id()))
    most = FEW // width
    if datasets.limit(most + 1).count() > most:
        return _joined_subset_levels(rows, keys, models, chosen, steps, offset, kind, value, null_policy)
    bare = rows.select(*keys, "_mod", *[c.alias(n) for n, c in given.items()])
    bare = lookup(bare, datasets, keys, "inner", row_bytes(2)).select("_d", "_mod", *given)
    names, make = [f"_e{c}" for c in range(width)], _subset_errors(len(models), [bits for bits, _, _ in chosen], float(offset), bool(sizes))
    quantiles = quantiles_in_batches(bare, names, card_quantiles(steps), list(given), make, null_policy)
    cuts = {row["_d"]: list(row[1:]) for row in stage(cut_arrays(quantiles, ["_d"], names)).collect()}  # one row a dataset
    groups, at = [], sizes
    for bits, n, _ in chosen:
        groups.append([*range(at, at + n), *[i for i in range(sizes) if bits >> i & 1]])
        at += n
    counted = level_counts(bare, cuts, list(given), make, groups, len(steps)).groupBy("_d", "_j", "_mod", "_level").agg(F.sum("cnt").alias("cnt"))
    return _labelled(lookup(counted, datasets, ["_d"], "inner", row_bytes(2)), keys, chosen)


def _labelled(counted, keys, chosen):
    labels = F.array(*[F.struct(F.lit(n).alias("n_models"), F.lit(c).alias("model_combo"), F.lit(j).alias("combo_no")) for j, (_, n, c) in enumerate(chosen)])
    return counted.withColumn("_label", F.get(labels, F.col("_j"))).select(*keys, "_label.*", "_mod", "_level", "cnt")


def _joined_subset_levels(rows, keys, models, chosen, steps, offset, kind, value, null_policy):
    """``_subset_levels`` with a row for each row and subset: all medians come from one sorted array a row, and subsets are datasets of their own."""
    marks = [f"_k_abs_{m}" for m in models] if kind == "both" else []
    if marks:
        rows = card_levels(rows, models, steps, [float(offset)], ("abs",), value, keys, null_policy, [*keys, "_mod", value, *models])
    rows = rows.select(*keys, "_mod", *marks, clean_number(value).alias("_y"), *[clean_number(m).alias(f"_m{i}") for i, m in enumerate(models)])
    sizes = {f"_a{i}": F.abs(F.col(f"_m{i}") - F.col("_y")) for i in range(len(models))}
    seen = F.filter(F.array_sort(F.array(*[F.struct(F.col(f"_m{i}").alias("v"), F.lit(1 << i).alias("bit")) for i in range(len(models))])), lambda e: e["v"].isNotNull())
    own = F.transform(F.array(*[F.lit(bits) for bits, _, _ in chosen]), lambda bits: F.filter("_seen", lambda e: e["bit"].bitwiseAND(bits) != 0))
    middle = lambda o: (F.get(o, F.shiftright(F.size(o) - 1, 1))["v"] + F.get(o, F.shiftright(F.size(o), 1))["v"]) / 2 + F.lit(float(offset))
    rows = rows.withColumns(sizes | {"_seen": seen}).select(*keys, "_mod", *marks, *sizes, F.posexplode(F.transform(own, middle)).alias("_j", "_centre"))
    rows = rows.withColumn("_bits", F.get(F.array(*[F.lit(bits) for bits, _, _ in chosen]), F.col("_j")))
    member = [F.col("_bits").bitwiseAND(1 << i) != 0 for i in range(len(models))]
    # Models outside of the subset have no errors; a constant keeps them from counting as missing.
    shares = {f"_r{i}": F.when(member[i], ratio(F.col(f"_a{i}"), F.col("_centre"))).otherwise(0.0) for i in range(len(models))}
    errors = rows.select(*keys, "_mod", *marks, "_j", "_bits", *[c.alias(n) for n, c in shares.items()])
    ids, names = [*keys, "_j"], list(shares)
    cuts = stage(cut_arrays(exact_quantiles(errors, ids, names, card_quantiles(steps), null_policy), ids, names))
    marked = lookup(errors, cuts, ids, "left", row_bytes(len(steps) * len(names)))
    marked = count_passed(marked, {f"_k{n}": (n, f"_cut{n}") for n in names}, len(steps))
    levels = [F.when(member[i], F.least(f"_k_r{i}", marks[i]) if marks else F.col(f"_k_r{i}")).otherwise(len(steps)) for i in range(len(models))]
    level = F.least(*levels) if len(levels) > 1 else levels[0]
    counted = marked.groupBy(*keys, "_j", "_mod", level.alias("_level")).agg(F.count("*").alias("cnt"))
    return _labelled(counted, keys, chosen)


def _counted_subsets(marks, keys, hit, extra=()):
    return marks.groupBy("n_models", "model_combo", *extra, *keys).agg(
        F.sum(hit).alias("group_len"), F.sum(F.when(F.col("_mod"), hit).otherwise(0)).alias("group_pos"), _pos().alias("ds_pos"), F.sum("cnt").alias("ds_len")
    )


def multi_model_stats(
    df: DataFrame, reference=REF_VALUE, models=MODELS, threshold=THRESHOLD, data_offset=DATA_OFFSET,
    value=VALUE, keys=None, null_policy="poison", group_stat="abs",
) -> DataFrame:
    """Top-group metrics of every subset of the models at one threshold, by absolute, relative (``rel``) or both errors."""
    keys, models = dataset_keys(df, keys), list(models)
    rows = _with_truth(df, reference, value, keys, models)
    if group_stat in ("rel", "both"):
        levels = _subset_levels(rows, keys, models, subsets(models), [float(threshold)], data_offset, group_stat, value, null_policy)
        hit = F.when(F.col("_level") > 0, F.col("cnt")).otherwise(0)
        counts = _counted_subsets(levels, keys, hit, ["combo_no"]).withColumns({"data_offset": F.lit(float(data_offset)), "threshold_pct": F.lit(float(threshold))})
        return _zeroed(_metric_frame(counts, ["n_models", "model_combo", "threshold_pct", *keys, "data_offset", "combo_no"]))
    rows = card_levels(rows, models, [float(threshold)], [float(data_offset)], ("abs",), value, keys, null_policy, [*keys, "_mod"])
    return _subset_metrics(_level_patterns(rows, keys, models), keys, models, threshold, data_offset)


def _zeroed(metrics):
    """A subset without any top-group entry has only zeros."""
    return metrics.withColumns({n: F.when(F.col("group_len") > 0, F.col(n)).otherwise(0) for n in METRICS})


def _subset_metrics(patterns, keys, models, threshold, data_offset, least=1):
    counts = _subset_counts(patterns, keys, models, data_offset, least).withColumn("threshold_pct", F.lit(float(threshold)))
    names = ["n_models", "model_combo", "threshold_pct", *keys, "data_offset"]
    # A subset without any top-group entry has only zeros.
    metrics = _metric_frame(counts, [*names, "combo_no"])
    return metrics.withColumns({n: F.when(F.col("group_len") > 0, F.col(n)).otherwise(0) for n in METRICS})


def best_combo(stats: DataFrame, criterion="max", keys=None) -> DataFrame:
    """One subset per size: the highest F1 of any dataset, or the F1 nearest to the size's median."""
    keys = dataset_keys(stats, keys)
    if criterion == "max":
        scored = stats.withColumn("_score", -F.col("f1"))
    elif criterion == "median":
        middle = stats.groupBy("n_models").agg(F.median("f1").alias("_middle"))  # one row per size
        scored = stats.join(F.broadcast(middle), "n_models").withColumn("_score", F.abs(F.col("f1") - F.col("_middle")))
    else:
        raise ValueError(f"unknown criterion {criterion!r}")
    order = F.struct("_score", "combo_no", *keys)
    return scored.groupBy("n_models").agg(F.min_by(F.struct("model_combo", "f1"), order).alias("_best")).select(
        "n_models", "_best.model_combo", "_best.f1"
    )


def multi_model_curve(
    df: DataFrame, reference=REF_VALUE, models=MODELS, thresholds=THRESHOLDS, data_offset=DATA_OFFSET,
    criterion="max", value=VALUE, keys=None, null_policy="poison", threshold=THRESHOLD, group_stat="abs",
) -> DataFrame:
    """Top-group metrics over all thresholds for the best subset of each size, chosen at ``threshold``, by the errors of ``group_stat``.

    One level pass over all thresholds; what follows works on the counted level patterns, so rows
    are never multiplied by subsets.
    """
    keys, models, asked = dataset_keys(df, keys), list(models), falling(thresholds)
    steps = falling([*asked, float(threshold)])
    if group_stat in ("rel", "both"):
        stats = multi_model_stats(df, reference, models, threshold, data_offset, value, keys, null_policy, group_stat)
        labels = {r["model_combo"] for r in best_combo(stats, criterion, keys).collect()}  # one a size
        chosen = [s for s in subsets(models) if s[2] in labels]
        levels = _subset_levels(_with_truth(df, reference, value, keys, models), keys, models, chosen, asked, data_offset, group_stat, value, null_policy)
        by_threshold = F.array(*[F.struct(F.lit(i).alias("_i"), F.lit(t).alias("threshold_pct")) for i, t in enumerate(asked)])
        hit = F.when(F.col("_level") > F.col("_i"), F.col("cnt")).otherwise(0)
        counts = _counted_subsets(levels.select("*", F.inline(by_threshold)), keys, hit, ["threshold_pct"]).withColumn("data_offset", F.lit(float(data_offset)))
        return _zeroed(_metric_frame(counts, ["n_models", "model_combo", "threshold_pct", *keys, "data_offset"]))
    rows = _with_truth(df, reference, value, keys, models)
    rows = card_levels(rows, models, steps, [float(data_offset)], ("abs",), value, keys, null_policy, [*keys, "_mod"])
    patterns = stage(_level_patterns(rows, keys, models))
    stats = _subset_metrics(patterns, keys, models, threshold, data_offset, steps.index(float(threshold)) + 1)
    masks = F.create_map(*[F.lit(x) for b, _, label in subsets(models) for x in (label, b)])
    chosen = best_combo(stats, criterion, keys).select("n_models", "model_combo", masks[F.col("model_combo")].alias("_bits"))
    winners = chosen.agg(F.collect_list(F.struct("n_models", "model_combo", "_bits")).alias("w"))  # one entry per size
    levels = patterns.select("*", F.inline(stage(winners).scalar()))
    members = [F.when(F.col("_bits").bitwiseAND(1 << i) != 0, F.col(f"_k_abs_{m}")) for i, m in enumerate(models)]
    weakest = F.least(*members) if len(members) > 1 else members[0]
    levels = levels.groupBy("n_models", "model_combo", *keys, "_mod", weakest.alias("_level")).agg(F.sum("cnt").alias("cnt"))
    by_threshold = F.array(*[F.struct(F.lit(steps.index(t)).alias("_i"), F.lit(t).alias("threshold_pct")) for t in asked])
    hit = F.when(F.col("_level") > F.col("_i"), F.col("cnt")).otherwise(0)
    counts = (
        levels.select("*", F.inline(by_threshold))
        .groupBy("n_models", "model_combo", "threshold_pct", *keys)
        .agg(
            F.sum(hit).alias("group_len"),
            F.sum(F.when(F.col("_mod"), hit).otherwise(0)).alias("group_pos"),
            _pos().alias("ds_pos"),
            F.sum("cnt").alias("ds_len"),
        )
        .withColumn("data_offset", F.lit(float(data_offset)))
    )
    metrics = _metric_frame(counts, ["n_models", "model_combo", "threshold_pct", *keys, "data_offset"])
    return metrics.withColumns({n: F.when(F.col("group_len") > 0, F.col(n)).otherwise(0) for n in METRICS})


def quantile_thresholds(num_points=100):
    """Dense near 0 and near 100; the value both halves share is kept once. The ranges are fixed values."""
    low = geomspace(0.01, 90, num_points // 2)
    high = 100 - geomspace(0.0001, 10, num_points // 2)[::-1]
    return sorted({float(t) for t in concatenate([low, high])})


def quantile_baseline(
    df: DataFrame, reference=REF_VALUE, models=MODELS, thresholds=None, data_offset=DATA_OFFSET,
    value=VALUE, keys=None,
) -> DataFrame:
    """Plain cut: entries whose error of the median prediction exceeds its t % quantile.

    Each row gets the number of cuts below it, so one small histogram serves all thresholds.
    Thresholds above which nothing lies have no row.
    """
    keys = dataset_keys(df, keys)
    steps = quantile_thresholds() if thresholds is None else sorted(set(as_list(thresholds)))
    rows = _with_truth(df, reference, value, keys, models)
    rows = basic_stats(rows, models, None, value, data_offset).select(*keys, "_mod", "d_median_a")
    cuts = exact_quantiles(rows, keys, ["d_median_a"], [t / 100 for t in steps], "skip")
    return _plain_metrics(rows, stage(cuts.select(*keys, F.col("d_median_a").alias("_cuts"))), keys, steps)


def _plain_metrics(rows, cuts, keys, steps):
    rows = count_passed(lookup(rows, cuts, keys, "left", row_bytes(len(steps))), {"_level": ("d_median_a", "_cuts")}, len(steps), strict=True)
    levels = rows.groupBy(*keys, "_mod", "_level").agg(F.count("*").alias("cnt"))
    by_threshold = F.array(*[F.struct(F.lit(i).alias("_i"), F.lit(t).alias("threshold")) for i, t in enumerate(steps)])
    hit = F.when(F.col("_level") > F.col("_i"), F.col("cnt")).otherwise(0)
    counts = (
        levels.select("*", F.inline(by_threshold))
        .groupBy("threshold", *keys)
        .agg(
            F.sum(hit).alias("group_len"),
            F.sum(F.when(F.col("_mod"), hit).otherwise(0)).alias("group_pos"),
            _pos().alias("ds_pos"),
            F.sum("cnt").alias("ds_len"),
        )
        .filter("group_len > 0")
    )
    return _metric_frame(counts, ["threshold", *keys]).select("threshold", *keys, "precision", "recall", "f1")


def compare_threshold_methods(
    df: DataFrame, reference=REF_VALUE, models=MODELS, num_points=100, data_offset=DATA_OFFSET,
    value=VALUE, keys=None, null_policy="poison",
) -> DataFrame:
    """Quantile cuts and top card groups side by side, sorted.

    The thresholds run opposite ways: ``Quantile`` keeps the top 100 - t %, ``Cards`` the top t %.
    Both methods' cutoffs come from one request for quantiles.
    """
    keys, models, offsets = dataset_keys(df, keys), list(models), as_list(data_offset)
    rows = _with_truth(df, reference, value, keys, models)
    plain_steps, steps = quantile_thresholds(num_points), falling(geomspace(0.0001, 100, num_points))
    errors, names = with_errors(basic_stats(rows, models, None, value, data_offset), models, value, offsets, ("abs",), [*keys, "d_median_a"])
    found = exact_quantiles(
        errors, keys, [*names, "d_median_a"], {n: card_quantiles(steps) for n in names} | {"d_median_a": [t / 100 for t in plain_steps]},
        {n: null_policy for n in names} | {"d_median_a": "skip"},
    )
    found = stage(found)

    plain_rows = basic_stats(rows, models, None, value, data_offset).select(*keys, "_mod", "d_median_a")
    plain = _plain_metrics(plain_rows, found.select(*keys, F.col("d_median_a").alias("_cuts")), keys, plain_steps)
    levels = card_levels(rows, models, steps, offsets, ("abs",), value, keys, null_policy, [*keys, "_mod"], cut_arrays(found, keys, names))
    marks = _at_least_counts(levels, keys, level_columns(models, "abs"))
    marked = _metrics_from_marks(marks, keys, steps, offsets, len(models), True, True)
    top = group_slice(marked, len(models)).withColumnRenamed("threshold_pct", "threshold")
    shape = ["threshold", *keys, "precision", "recall", "f1"]
    both = plain.select(*shape, F.lit("Quantile").alias("method")).unionByName(top.select(*shape, F.lit("Cards").alias("method")))
    return both.na.fill(0).orderBy("threshold", *keys, "method")


def shifted_comparison(
    df: DataFrame, shifted: DataFrame, reference=REF_VALUE, shifted_reference=REF_VALUE, models=MODELS,
    thresholds=THRESHOLDS, data_offsets=DATA_OFFSETS, shift=1.5, value=VALUE, keys=None, null_policy="poison",
) -> DataFrame:
    """Top-group metrics by both errors on data and on the same data shifted by a constant.

    Offsets are lowered by the shift for the shifted data and labelled as the original ones.
    """
    keys, offsets, n_models = dataset_keys(df, keys), as_list(data_offsets), len(list(models))

    def top(frame, truth, used):
        return group_slice(
            classification_metrics(frame, truth, models, thresholds, used, "both", value, keys, True, null_policy), n_models
        )

    moved = top(shifted, shifted_reference, [d - shift for d in offsets])
    names = F.create_map(*[F.lit(x) for d in offsets for x in (d - shift, d)])
    moved = moved.withColumn("data_offset", names[F.col("data_offset")])
    return top(df, reference, offsets).withColumn("df_type", F.lit("orig")).unionByName(
        moved.withColumn("df_type", F.lit("shifted"))
    )


def aggregate_metrics(metrics: DataFrame, stats=("f1",), agg="max", keys=None, group_no=None) -> DataFrame:
    """One number per dataset and metric over all thresholds and offsets, in long form."""
    keys = dataset_keys(metrics, keys)
    if group_no is not None:
        metrics = group_slice(metrics, group_no)
    fold = {"max": F.max, "min": F.min, "mean": F.avg, "median": F.median, "std": F.stddev_samp, "sum": F.sum}[agg]
    wide = metrics.groupBy(*keys).agg(*[fold(F.col(s).cast("double")).alias(s) for s in stats])
    return wide.unpivot(list(keys), list(stats), "stat", agg)


def group_size_log_ratio(metrics: DataFrame, n_models=len(MODELS), keys=None) -> DataFrame:
    """ln of the top group's size over the next one's: above 0 where the top group stands out."""
    keys = dataset_keys(metrics, keys)
    ids = ["threshold_pct", *keys, "data_offset"]

    def size(g):
        return F.max(F.when(F.col("group_no") == g, F.col("group_len"))).cast("double")

    sizes = metrics.groupBy(*ids).agg(size(n_models).alias("top"), size(n_models - 1).alias("below"))
    log = (
        F.when((F.col("top") == 0) & (F.col("below") == 0), None)
        .when(F.col("below") == 0, F.lit(INF))
        .when(F.col("top") == 0, F.lit(-INF))
        .otherwise(F.ln(F.col("top") / F.nullif(F.col("below"), F.lit(0.0))))
    )
    return sizes.select(*ids, log.alias("log_ratio"))
