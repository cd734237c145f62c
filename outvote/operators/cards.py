"""Cards: each model marks the worst share of a dataset's entries; marks are counted per entry."""

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..defaults import DATA_OFFSET, MODELS, THRESHOLD, VALUE
from ..functions.expr import check_free, clean_number, own_method, ratio, total, with_row_stats
from ..plans.levels import count_passed
from ..plans.quantiles import exact_quantiles
from ..plans.staging import lookup, row_bytes, stage
from .errors import dataset_keys

KINDS = ("abs", "rel", "both")


def as_list(numbers):
    return [float(numbers)] if isinstance(numbers, (int, float)) else [float(x) for x in numbers]


def falling(thresholds):
    """Distinct thresholds from loose to strict, that is, with rising cutoffs."""
    return sorted(set(as_list(thresholds)), reverse=True)


def with_errors(df, models, value, offsets, kinds, carry):
    """``carry`` and the error columns, with the names of the latter.

    ``_abs_<model>``, and ``_rel<j>_<model>`` for the j-th offset. Relative errors keep the sign
    of their denominator. Each step is a projection of its own: what is used often is not
    repeated.
    """
    names = [f"_abs_{m}" for m in models]
    relative = "rel" in kinds or "both" in kinds
    check_free(df, "_y", "_centre")
    df = df.withColumn("_y", clean_number(value))
    if relative:
        df = with_row_stats(df, models, "_centre")
    rows = df.select(*carry, *(["_centre"] if relative else []), *[F.abs(clean_number(m) - F.col("_y")).alias(f"_abs_{m}") for m in models])
    if relative:
        rows = own_method(rows).withColumns({f"_den{j}": F.col("_centre") + F.lit(d) for j, d in enumerate(offsets)})
        ratios = {f"_rel{j}_{m}": ratio(F.col(f"_abs_{m}"), F.col(f"_den{j}")) for j in range(len(offsets)) for m in models}
        names = (names if "abs" in kinds or "both" in kinds else []) + list(ratios)
        rows = own_method(rows.withColumns(ratios))
    return rows.select(*carry, *names), names


def errors_in_batches(df, models, value, offsets, kinds, keys):
    """What makes the columns of ``with_errors`` from numpy columns, by the same operations: ``made`` of ``exact_quantiles``."""
    relative, sizes_too = "rel" in kinds or "both" in kinds, "abs" in kinds or "both" in kinds or "rel" not in kinds
    offsets = list(offsets)

    def make(columns):
        y, given = columns[0], columns[1:]
        with np.errstate(all="ignore"):
            sizes = [np.abs(m - y) for m in given]
        if not relative:
            return sizes
        # As in ``ratio``: an error that is no number, of two infinities, is none of 0 either; a missing one is none at all.
        most = [np.where(np.isnan(m) | np.isnan(y) | (s == 0), np.nan, np.inf) for m, s in zip(given, sizes)]
        n = sum((~np.isnan(m)).astype("int8") for m in given)
        lanes = [np.where(np.isnan(m), np.inf, m) for m in given]  # missing ones come last
        for i in range(len(lanes)):
            for k in range(i % 2, len(lanes) - 1, 2):
                lanes[k], lanes[k + 1] = np.minimum(lanes[k], lanes[k + 1]), np.maximum(lanes[k], lanes[k + 1])
        out = sizes if sizes_too else []
        with np.errstate(all="ignore"):
            centre = np.full(len(y), np.nan)
            for k in np.unique(n[n > 0]).tolist():
                centre = np.where(n == k, (lanes[(k - 1) // 2] + lanes[k // 2]) / 2, centre)
            for d in offsets:
                den = centre + d
                out = out + [np.where(den == 0, top, s / den) for top, s in zip(most, sizes)]
        return out

    names = ["_y", *[f"_m{i}" for i in range(len(models))]]
    frame = df.select(*keys, *[clean_number(c).alias(n) for n, c in zip(names, [value, *models])])
    return frame, names, make


def _cut_arrays(errors, keys, names, thresholds, null_policy, made):
    return stage(cut_arrays(exact_quantiles(errors, keys, names, card_quantiles(thresholds), null_policy, made), keys, names))


def card_quantiles(thresholds):
    """The quantiles that marks at these thresholds start at."""
    return [(100 - t) / 100.0 for t in thresholds]


def cut_arrays(quantiles: DataFrame, keys, names) -> DataFrame:
    """``_cut<name>`` of each column of exact quantiles."""
    return quantiles.select(*keys, *[_ascending(F.col(n)).alias(f"_cut{n}") for n in names])


def _ascending(cuts):
    """The array; an error if it has NaN or falls anywhere, since levels are searched by halving."""
    fine = F.forall(F.sequence(F.lit(1), F.size(cuts)), lambda i: (i == F.size(cuts)) | (F.get(cuts, i - 1) <= F.get(cuts, i)))
    fine = fine & ~F.exists(cuts, F.isnan)
    return F.when(cuts.isNull() | fine, cuts).otherwise(F.raise_error(F.lit("cutoffs must ascend")).cast("array<double>"))


def cutoffs(
    df: DataFrame, models=MODELS, thresholds=THRESHOLD, data_offsets=DATA_OFFSET, kinds=("abs", "rel"),
    value=VALUE, keys=None, null_policy="poison",
) -> DataFrame:
    """The error each model's marks start at, per dataset, kind, offset and threshold."""
    keys, offsets = dataset_keys(df, keys), as_list(data_offsets)
    thresholds = falling(thresholds)
    errors, columns = with_errors(df, models, value, offsets, kinds, keys)
    cuts = _cut_arrays(errors, keys, columns, thresholds, null_policy, errors_in_batches(df, models, value, offsets, kinds, keys))
    cells = []
    for m in models:
        for i, t in enumerate(thresholds):
            if f"_abs_{m}" in columns:
                cells.append(("abs", None, m, t, F.get(f"_cut_abs_{m}", i)))
            for j, d in enumerate(offsets):
                if f"_rel{j}_{m}" in columns:
                    cells.append(("rel", d, m, t, F.get(f"_cut_rel{j}_{m}", i)))
    rows = F.array(
        *[
            F.struct(
                F.lit(kind).alias("kind"),
                F.lit(d).cast("double").alias("data_offset"),
                F.lit(m).alias("model_name"),
                F.lit(t).alias("threshold_pct"),
                cut.alias("cutoff"),
            )
            for kind, d, m, t, cut in cells
        ]
    )
    return cuts.select(*keys, F.inline(rows))


def card_levels(
    df: DataFrame, models, thresholds, offsets, kinds, value=VALUE, keys=(), null_policy="poison", carry=None, cuts=None,
) -> DataFrame:
    """Adds, per kind and model, how many of the thresholds the model marks the row at.

    A model that marks a row at a strict threshold marks it at every looser one, so one small
    number says it all: row marked at the i-th loosest threshold <=> level > i. Columns are
    ``_k_<kind>_<model>``. If relative errors take part there is one row per offset, numbered
    ``_j``; else ``_j`` is 0. ``carry`` names the columns to keep (default: all). ``cuts`` are the
    cutoffs as ``cut_arrays`` gives them, where they are known already.
    """
    keys, carry = list(keys), df.columns if carry is None else list(carry)
    errors, columns = with_errors(df, models, value, offsets, kinds, carry)
    if cuts is None:
        cuts = _cut_arrays(errors, keys, columns, thresholds, null_policy, errors_in_batches(df, models, value, offsets, kinds, keys))
    absolute = [f"_abs_{m}" for m in models if f"_abs_{m}" in columns]

    def by_offset(prefix):
        """One entry per offset, with its own relative columns under common names."""
        return F.inline(
            F.array(
                *[
                    F.struct(F.lit(j).alias("_j"), *[F.col(f"{prefix}_rel{j}_{m}").alias(f"{prefix}_rel_{m}") for m in models])
                    for j in range(len(offsets))
                ]
            )
        )

    on, names = keys, absolute
    if len(columns) > len(absolute):
        errors = errors.select(*carry, *absolute, by_offset(""))
        cuts = cuts.select(*keys, *[f"_cut{n}" for n in absolute], by_offset("_cut"))
        on, names = [*keys, "_j"], absolute + [f"_rel_{m}" for m in models]
    else:
        errors = errors.withColumn("_j", F.lit(0))
    rows = lookup(errors, cuts, on, "left", row_bytes(len(thresholds) * len(names)))

    pair = {n: (n, f"_cut{n}") for n in names}
    probes = {f"_k{n}": pair[n] for n in names if n.split("_")[1] in kinds}
    least = {}
    if "both" in kinds and "abs" in kinds and "rel" in kinds:
        least = {f"_k_both_{m}": F.least(f"_k_abs_{m}", f"_k_rel_{m}") for m in models}
    elif "both" in kinds:
        probes.update({f"_k_both_{m}": [pair[f"_abs_{m}"], pair[f"_rel_{m}"]] for m in models})
    rows = count_passed(rows, probes, len(thresholds))
    return rows.withColumns(least).select(*carry, "_j", *[f"_k_{kind}_{m}" for kind in kinds for m in models])


def level_columns(models, kind):
    return [F.col(f"_k_{kind}_{m}") for m in models]


def cards(
    df: DataFrame, models=MODELS, thresholds=THRESHOLD, data_offsets=DATA_OFFSET, kinds=KINDS,
    value=VALUE, keys=None, null_policy="poison",
) -> DataFrame:
    """Every row once per (threshold, offset), with its number of marks by kind of error.

    ``cards_both`` counts the models that mark by absolute and by relative error.
    ``cards_norm`` is a constant 0, kept so that the fourth kind can be asked for. Rows without
    dataset get no marks.
    """
    keys, offsets = dataset_keys(df, keys), as_list(data_offsets)
    given = as_list(thresholds)
    steps = falling(given)
    levels = card_levels(df, models, steps, offsets, kinds, value, keys, null_policy)
    by_offset = tuple(kinds) != ("abs",)
    grid = F.array(
        *[
            F.struct(F.lit(t).alias("threshold_pct"), F.lit(steps.index(t)).alias("_i"), *([] if by_offset else [F.lit(d).alias("data_offset")]))
            for t in given
            for d in (offsets[:1] if by_offset else offsets)
        ]
    )
    out = levels.select(*levels.columns, F.inline(grid))
    if by_offset:
        out = out.withColumn("data_offset", F.get(F.array(*map(F.lit, offsets)), F.col("_j")))
    counts = {f"cards_{kind}": total([(k > F.col("_i")).cast("int") for k in level_columns(models, kind)]) for kind in kinds}
    counts["cards_norm"] = F.lit(0)
    return out.withColumns(counts).select(*df.columns, "threshold_pct", "data_offset", *counts)


def flag_errors(df: DataFrame, models=MODELS, threshold=THRESHOLD, value=VALUE, keys=None, null_policy="poison") -> DataFrame:
    """The entries that every model marks by absolute error."""
    marked = cards(df, models, threshold, DATA_OFFSET, ("abs",), value, keys, null_policy)
    return marked.filter(F.col("cards_abs") == len(models)).select(*df.columns)
