"""Quality rules: fixed base rules, then gradient-boosted trees over document statistics."""

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from . import trees
from .statistics import COUNTS, FEATURES, labelled, with_statistics

#: Most labelled documents the trees are fitted on.
SAMPLE = 20_000
#: More of these never makes a document better.
WORSE = ["symbol_rate", "dup_line_rate", "repeat_rate", "same_next_rate", "exclaim_rate", "pipe_rate"]


@dataclass
class QualityModel:
    forest: trees.Forest
    threshold: float = 0.5


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> QualityModel:
    """Trees for ``labels.quality`` (``doc_id, quality``), fitted on at most ``sample`` labelled documents.

    Statistics in WORSE may only lower the score. Without labels of both kinds every document
    gets the score of the one there is, and passes if there are none.
    """
    x, y = labelled(docs, labels, "quality", sample)
    signs = [-1 if f in WORSE else 0 for f in FEATURES]
    return QualityModel(trees.fit(x, y, signs=signs))


def judge(docs: DataFrame, model: QualityModel, keep=("doc_id",), text: str = "text") -> DataFrame:
    """Columns ``keep``, then ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept``.

    Words are runs of anything but ASCII white space; a null text has none. The base rules reject
    fewer than 10 words, and texts of which over 20 % of the words lie in five-word windows found twice or
    more; others are kept if the trees score at least the threshold. Rows are judged one by one, so
    repeated rows and null ids stay as they are.
    """
    forest, threshold = model.forest, model.threshold

    def extra(found):
        failed = (found["n_words"] < 10) | (100 * found["n_repeat_words"] > 20 * found["n_words"])
        score = forest.score(np.stack([found[f] for f in FEATURES], axis=1).astype(float))
        return {c: found[c] for c in COUNTS} | {"base_failed": failed, "score": score, "kept": ~failed & (score >= threshold)}

    schema = ", ".join([*(f"{c} long" for c in COUNTS), "base_failed boolean", "score double", "kept boolean"])
    return with_statistics(docs, list(keep), extra, schema, text)


def passing(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs``, all columns, that are kept."""
    model = fit(docs, labels, sample)
    own = [f"own_{i}" for i in range(len(docs.columns))]  # no clash with the statistics
    text = own[docs.columns.index("text")]
    return judge(docs.toDF(*own), model, own, text).filter("kept").select(*own).toDF(*docs.columns)
