"""Quality classifier: conjunctive rules from trees, weighted by lasso, compiled to column expressions."""

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import trees
from .statistics import FEATURES, labelled, with_statistics

#: Most labelled documents the rules and weights are fitted on.
SAMPLE = 20_000
HELD_OUT = 2


@dataclass(frozen=True)
class Rule:
    """Holds where every ``(feature, above, threshold)`` does: ``x > t`` if above, else ``x <= t``."""

    terms: tuple

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for j, above, t in self.terms:
            out &= (x[:, j] > t) if above else (x[:, j] <= t)
        return out

    def column(self) -> Column:
        out = F.lit(True)
        for j, above, t in self.terms:
            c = F.col(FEATURES[j])
            out = out & ((c > F.lit(t)) if above else (c <= F.lit(t)))
        return out


def extract_rules(forest: trees.Forest) -> list[Rule]:
    """Every path from a root to another node, tightest bounds only, without repetitions."""
    found: dict[Rule, None] = {}
    for feature, threshold in zip(forest.feature, forest.threshold):
        paths: dict[int, dict] = {0: {}}
        for node in range(len(feature)):
            for above in (False, True):
                path = dict(paths.get(node, {}))
                j = int(feature[node])
                if j < 0 and above:
                    continue
                if j >= 0:
                    t = float(threshold[node])
                    old = path.get((j, above), t)
                    path[(j, above)] = max(old, t) if above else min(old, t)
                    found[Rule(tuple((k, up, v) for (k, up), v in sorted(path.items())))] = None
                paths[2 * node + 1 + above] = path
    return list(found)


def lasso_logistic(x: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Weights and intercept of L1-penalised logistic regression, by accelerated proximal gradient."""
    n, m = x.shape
    step = 4 / max(1e-9, np.linalg.norm(np.column_stack([x, np.ones(n)]), 2) ** 2 / n)
    w, b = np.zeros(m), float(np.log(np.clip(y.mean(), 1e-3, 0.999) / np.clip(1 - y.mean(), 1e-3, 0.999)))
    v, c, t = w, b, 1.0
    for _ in range(rounds):
        error = 1 / (1 + np.exp(-(x @ v + c))) - y
        w2 = v - step * (x.T @ error) / n
        w2 = np.sign(w2) * np.maximum(np.abs(w2) - step * penalty, 0)
        b2 = c - step * error.mean()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - b)
        w, b, t = w2, b2, t2
    return w, b


@dataclass
class RuleEnsemble:
    rules: list[Rule]
    weights: list[float]
    intercept: float

    def column(self) -> Column:
        """Score between 0 and 1 over the statistics columns."""
        total = F.lit(self.intercept)
        for rule, weight in zip(self.rules, self.weights):
            total = total + F.when(rule.column(), F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def held_out(doc_id: Column) -> Column:
    """Rows never learned from; null ids are none of them."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == HELD_OUT, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, penalty: float = 0.001) -> RuleEnsemble:
    """Ensemble for ``labels.quality``, learned from labelled documents that are not held out, at most ``sample``.

    Only statistics of the text are inputs. Without labels of both kinds there are no rules and the
    score is near the one label there is, or 1.
    """
    x, y = labelled(docs, labels.filter(~held_out(F.col("doc_id"))), "quality", sample)
    forest = trees.fit(x, y, trees=30, depth=3)
    rules = extract_rules(forest)
    if not rules:
        return RuleEnsemble([], [], forest.start)
    active = np.column_stack([r.holds(x) for r in rules])
    _, first = np.unique(active, axis=1, return_index=True)  # rules that mark the same rows count once
    rules, active = [rules[i] for i in sorted(first)], active[:, sorted(first)].astype(float)
    weights, intercept = lasso_logistic(active, y, penalty)
    some = np.flatnonzero(np.abs(weights) > 1e-6)
    return RuleEnsemble([rules[i] for i in some], [float(weights[i]) for i in some], float(intercept))


def classify(docs: DataFrame, model: RuleEnsemble, threshold: float = 0.7) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of each row; a null or empty text has the statistics of no words."""
    rows = with_statistics(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ["doc_id"])
    scored = rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), model.column().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
