"""Out-of-fold predictions of several diverse regressors, and their fold errors."""

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import (
    DecisionTreeRegressor,
    FMRegressor,
    GBTRegressor,
    LinearRegression,
    RandomForestRegressor,
)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..defaults import ENTRY_ID, SEED, VALUE
from ..functions.expr import clean_number
from ..plans.staging import stage
from .injection import kfold

FITS_AT_ONCE = 4
FIT_ROW_BYTES = 250  # of a row that Spark's trees hold in memory between their passes, besides its features
PRODUCTS_OF = 12  # most features whose pairs get moments of their own


def default_estimators(seed=SEED):
    """Five regressors that err differently. They stand in for five separately built models."""
    return {
        "linear": LinearRegression(regParam=0.01),
        "tree": DecisionTreeRegressor(maxDepth=6, seed=seed),
        "forest": RandomForestRegressor(numTrees=20, maxDepth=6, seed=seed),
        "boosted": GBTRegressor(maxIter=20, maxDepth=4, seed=seed),
        "factor": FMRegressor(factorSize=4, maxIter=60, stepSize=0.05, seed=seed),
    }


def oof_predict(df: DataFrame, features, label=VALUE, estimators=None, k=5, id_col=ENTRY_ID, seed=SEED, balanced=True) -> DataFrame:
    """One prediction column per model; every row is predicted by models that never saw it.

    Folds are cut once and staged with one folder a fold, so a fit reads only its own. The k * m fits, each over the cluster,
    are submitted by up to ``FITS_AT_ONCE`` threads, so that one fills the cores that another leaves idle, but by no more than have room for
    their rows in memory side by side: large fits fill the cores alone, and rows that do not stay in memory are read from disk in each of some
    hundred passes. Factorization machines that step by the gradient of all rows take it from moments, summed up once for all folds (``_factor_line``).
    """
    estimators = estimators or default_estimators(seed)
    vectors = VectorAssembler(inputCols=list(features), outputCol="_features", handleInvalid="error")
    folded = stage(vectors.transform(kfold(df, k, id_col, seed, balanced)), ["fold"])
    summed = [name for name, estimator in estimators.items() if _steps_by_all_rows(estimator)]
    moments = _product_moments(folded, label) if summed else {}

    def fit(task):
        fold, name = task
        estimator = estimators[name]
        others = [moments[f] for f in sorted(moments) if f != fold] if name in summed else []
        if others and all(np.isfinite(m).all() for m in others):
            return _factor_line(estimator, sum(others), df.sparkSession)
        params = {
            estimator.getParam("featuresCol"): "_features",
            estimator.getParam("labelCol"): label,
            estimator.getParam("predictionCol"): name,
        }
        return estimator.fit(folded.filter(F.col("fold") != fold), params)

    tasks = [(fold, name) for fold in range(k) for name in estimators]
    with ThreadPoolExecutor(_fits_at_once(folded, k, len(vectors.getInputCols()))) as pool:
        models = dict(zip(tasks, pool.map(fit, tasks)))
    parts = []
    for fold in range(k):
        part = folded.filter(F.col("fold") == fold)
        for name in estimators:
            model = models[fold, name]
            part = part.withColumn(name, _factor_value(*model)) if isinstance(model, tuple) else model.transform(part)
        parts.append(part.drop("_features"))
    return reduce(DataFrame.unionByName, parts)


def _fits_at_once(folded, k, n_features):
    """How many fits on k - 1 of k folds have their rows in the executors' memory for stored data at the same time, ``FITS_AT_ONCE`` at most."""
    sizes, found = folded.sparkSession.sparkContext._jsc.sc().getExecutorMemoryStatus().values().iterator(), []
    while sizes.hasNext():
        found.append(sizes.next()._1())
    memory = sum(found) * (len(found) - 1) // len(found) if len(found) > 1 else found[0]  # the driver of a cluster stores nothing
    own = folded.count() * (k - 1) // k * (FIT_ROW_BYTES + 8 * n_features)
    return max(1, min(FITS_AT_ONCE, memory // max(own, 1)))


def _steps_by_all_rows(estimator):
    """Factorization machines whose steps depend on nothing but the mean gradient of all rows."""
    return type(estimator) is FMRegressor and estimator.getSolver() == "adamW" and estimator.getMiniBatchFraction() == 1.0 and not estimator.getRegParam()


def _product_moments(folded, label):
    """Per fold, the sums of all products of two among 1, the features, the products of two features and the label.

    One pass: tasks give a matrix a fold, which are summed up by their places. Empty with no rows or too many features.
    """
    rows = folded.select("fold", vector_to_array("_features").alias("x"), F.col(label).cast("double").alias("y"))
    first = rows.first()
    if first is None or len(first["x"]) > PRODUCTS_OF:
        return {}
    d = len(first["x"])

    def summed(batches):
        import numpy as np
        import pyarrow as pa

        one, two = np.triu_indices(d, 1)
        sums = {}
        for batch in batches:
            fold, y = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 2))
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(y), d)
            z = np.column_stack([np.ones(len(y)), x, x[:, one] * x[:, two], y])
            for f in np.unique(fold):
                own = z[fold == f]
                sums[int(f)] = sums.get(int(f), 0.0) + own.T @ own
        if sums:
            cells = pa.array([m.ravel().tolist() for m in sums.values()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), cells], ["fold", "cells"])

    cells = rows.mapInArrow(summed, "fold int, cells array<double>").select("fold", F.posexplode("cells").alias("at", "v"))
    width, out = d + d * (d - 1) // 2 + 2, {}
    for row in cells.groupBy("fold", "at").agg(F.sum("v").alias("v")).collect():  # a matrix a fold
        out.setdefault(row["fold"], np.zeros(width * width))[row["at"]] = row["v"]
    return {fold: m.reshape(width, width) for fold, m in out.items()}


def _factor_line(estimator, moments, spark):
    """Base, weights and weights of products of the factorization machine that the estimator fits, by AdamW on mean squared error.

    Its prediction is linear in the products of two features, so the gradient over all rows follows from their moments, at every
    one of its steps. The start is the estimator's own: the factors of its fit without a step.
    """
    get = estimator.getOrDefault
    width = len(moments) - 1
    d = int(round((np.sqrt(8 * width - 7) - 1) / 2))
    zero = spark.createDataFrame([(Vectors.dense([0.0] * d), 0.0)], ["_features", "_label"])
    start = estimator.copy({estimator.maxIter: 0, estimator.featuresCol: "_features", estimator.labelCol: "_label"}).fit(zero)
    k, (one, two) = get("factorSize"), np.triu_indices(d, 1)
    at = np.concatenate([start.factors.toArray().ravel(), np.zeros(d + 1)])
    free = np.concatenate([np.ones(d * k), np.full(d, float(get("fitLinear"))), [float(get("fitIntercept"))]])

    def line(at):
        factors = at[: d * k].reshape(d, k)
        return np.concatenate([at[-1:], at[d * k : -1], (factors @ factors.T)[one, two]])

    mean, square = np.zeros_like(at), np.zeros_like(at)
    for step in range(1, get("maxIter") + 1):
        slope = 2 * (moments[:-1, :-1] @ line(at) - moments[:-1, -1]) / moments[0, 0]
        pairs = np.zeros((d, d))
        pairs[one, two] = pairs[two, one] = slope[d + 1 :]
        gradient = free * np.concatenate([(pairs @ at[: d * k].reshape(d, k)).ravel(), slope[1 : d + 1], slope[:1]])
        mean, square = 0.9 * mean + 0.1 * gradient, 0.999 * square + 0.001 * gradient**2
        move = mean / (1 - 0.9**step) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
        before, at = at, at - get("stepSize") * move
        if np.linalg.norm(before - at) < get("tol") * max(np.linalg.norm(at), 1.0):
            break
    found = line(at).tolist()
    return found[0], found[1 : d + 1], {(int(i), int(j)): w for i, j, w in zip(one, two, found[d + 1 :])}


def _factor_value(base, weights, products):
    x = [F.get(vector_to_array("_features"), i) for i in range(len(weights))]
    parts = [F.lit(w) * x[i] for i, w in enumerate(weights)] + [F.lit(w) * x[i] * x[j] for (i, j), w in products.items()]
    return reduce(lambda total, part: total + part, parts, F.lit(base))


def fold_statistics(folded: DataFrame, features, label=VALUE, fold="fold") -> dict:
    """``(n, means, scatter)`` of each fold: rows, means of features and label, and their products about the means.

    One aggregate: the moments of a fold are combined in tasks before they are shuffled. Rows with a missing feature or label take no part.
    """
    names = [*features, label]
    rows = folded.select(fold, *[clean_number(c).alias(f"_x{i}") for i, c in enumerate(names)]).dropna()
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    sums = rows.groupBy(fold).agg(
        F.count("*").alias("n"), *[F.avg(f"_x{i}").alias(f"m{i}") for i in range(len(names))],
        *[F.covar_pop(f"_x{i}", f"_x{j}").alias(f"c{i}_{j}") for i, j in pairs],
    )
    out = {}
    for row in sums.collect():  # one row a fold
        scatter = np.zeros((len(names), len(names)))
        for i, j in pairs:
            scatter[i, j] = scatter[j, i] = row[f"c{i}_{j}"] * row["n"]
        out[row[fold]] = row["n"], np.array([row[f"m{i}"] for i in range(len(names))]), scatter
    return out


def _merged(parts):
    """Moments of several folds together."""
    n = sum(p[0] for p in parts)
    mean = sum(p[0] * p[1] for p in parts) / n
    return n, mean, sum(p[2] + p[0] * np.outer(p[1] - mean, p[1] - mean) for p in parts)


def oof_linear(
    df: DataFrame, features, label=VALUE, k=5, id_col=ENTRY_ID, seed=SEED, balanced=True, ridge=0.0, out="linear"
) -> DataFrame:
    """Out-of-fold predictions of least squares, with all k fits from one scan.

    A fit without a fold needs only the moments of the other folds, a matrix as wide as the features. ``ridge`` is added to the
    diagonal of the features' covariance; directions without variance get no weight. Training needs at least one other
    fold with complete rows; else the prediction is NULL, as it is where a feature is missing.
    """
    features = list(features)
    folded = stage(kfold(df, k, id_col, seed, balanced))
    moments = fold_statistics(folded, features, label)
    lines = {}
    for fold in range(k):
        others = [moments[f] for f in sorted(moments) if f != fold]
        if others:
            n, mean, scatter = _merged(others)
            own = scatter[:-1, :-1] / n + ridge * np.eye(len(features))
            weights = np.linalg.pinv(own, hermitian=True) @ (scatter[:-1, -1] / n)
            lines[fold] = [*weights.tolist(), float(mean[-1] - weights @ mean[:-1])]
    made = None
    for fold, (*weights, base) in lines.items():
        line = reduce(lambda total, part: total + part, [clean_number(c) * F.lit(w) for c, w in zip(features, weights)], F.lit(base))
        made = F.when(F.col("fold") == fold, line) if made is None else made.when(F.col("fold") == fold, line)
    return folded.withColumn(out, F.lit(None).cast("double") if made is None else made)


def fold_mae(df: DataFrame, models, value=VALUE, fold="fold") -> DataFrame:
    """Mean absolute error of each model in each fold."""
    errors = df.groupBy(fold).agg(*[F.avg(F.abs(clean_number(m) - clean_number(value))).alias(m) for m in models])
    return errors.unpivot([fold], list(models), "model_name", "mae")


def best_fold(maes: DataFrame, fold="fold") -> DataFrame:
    """Each model's lowest fold error; the lower fold number where equal."""
    return maes.groupBy("model_name").agg(
        F.min_by(F.col(fold), F.struct("mae", fold)).alias(fold), F.min("mae").alias("mae")
    )
