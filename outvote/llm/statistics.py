"""Document statistics, computed in one pass over Arrow text batches."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import CONTINUED, SPACE, Words, slices, utf8, windows

#: Counts of the base rules, then numbers without dimension that models read.
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = [
    "log_words", "word_length", "symbol_rate", "dup_line_rate", "repeat_rate", "same_next_rate", "distinct_rate",
    "upper_rate", "exclaim_rate", "pipe_rate", "digit_rate", "stop_rate", "line_words",
]
_WHITE = b" \t\n\x0b\x0c\r"


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_SYMBOL, _UPPER, _EXCLAIM = _class(b"#*$%&|<>"), _class(bytes(range(65, 91))), _class(b"!")
_PIPE, _DIGIT, _STOP = _class(b"|"), _class(b"0123456789"), _class(b".?")


def _per_text(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many bytes of each text are in the mask."""
    at = np.flatnonzero(mask)
    return np.diff(np.searchsorted(at, offsets))


def repeated_words(hashes: np.ndarray, width: int = 5) -> int:
    """Words inside windows of ``width`` words that occur at least twice in the text."""
    runs = windows(hashes, width)
    if len(runs) < 2:
        return 0
    order = np.argsort(runs, kind="stable")
    same = runs[order][1:] == runs[order][:-1]
    if not same.any():
        return 0
    hit = np.zeros(len(runs), bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    cover = np.zeros(len(hashes) + 1, np.int64)
    at = np.flatnonzero(hit)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + width, -1)
    return int((np.cumsum(cover) > 0).sum())


def _repeated_lines(text: bytes) -> tuple[int, int]:
    lines = [x for x in text.split(b"\n") if x.strip(_WHITE)]
    return len(lines), len(lines) - len(set(lines))


def statistics_of(column) -> dict[str, np.ndarray]:
    """Statistics of each text of an Arrow string column; null counts as empty."""
    data, offsets = utf8(column)
    words = Words(column, lower=False)
    n = words.counts().astype(np.int64)
    chars = _per_text(~SPACE[data] & ~CONTINUED[data], offsets)
    symbols = _per_text(_SYMBOL[data], offsets)
    lines = [_repeated_lines(data[offsets[i] : offsets[i + 1]].tobytes()) for i in range(len(n))]
    n_lines, dup = np.array(lines, np.int64).reshape(-1, 2).T
    repeat, same, distinct = (np.zeros(len(n), np.int64) for _ in range(3))
    for i in range(len(n)):
        own = words.hashes[words.at[i] : words.at[i + 1]]
        repeat[i] = repeated_words(own)
        same[i] = (own[1:] == own[:-1]).sum()
        distinct[i] = len(np.unique(own))
    w, c = np.maximum(n, 1), np.maximum(chars, 1)
    rate = {k: _per_text(mask[data], offsets) for k, mask in (("up", _UPPER), ("ex", _EXCLAIM), ("pi", _PIPE), ("di", _DIGIT), ("st", _STOP))}
    return {
        "n_words": n, "word_chars": chars.astype(np.int64), "n_symbols": symbols.astype(np.int64), "n_dup_lines": dup, "n_repeat_words": repeat,
        "log_words": np.log1p(n), "word_length": chars / w, "symbol_rate": symbols / w, "dup_line_rate": dup / np.maximum(n_lines, 1),
        "repeat_rate": repeat / w, "same_next_rate": same / w, "distinct_rate": distinct / w, "upper_rate": rate["up"] / c,
        "exclaim_rate": rate["ex"] / w, "pipe_rate": rate["pi"] / w, "digit_rate": rate["di"] / c, "stop_rate": rate["st"] / w,
        "line_words": n / np.maximum(n_lines, 1),
    }


def with_statistics(docs: DataFrame, keep, extra=None, schema: str = "", text: str = "text") -> DataFrame:
    """Columns ``keep`` of ``docs`` followed by all statistics of the column ``text``, or by what ``extra`` makes of them.

    ``extra`` gets the statistics of a batch and returns the arrays of ``schema`` by name.
    """
    made = schema or ", ".join([*(f"{c} long" for c in COUNTS), *(f"{c} double" for c in FEATURES)])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields)

    def run(batches):
        for batch in batches:
            for part in slices(batch, text):
                found = statistics_of(part.column(text))
                found = extra(found) if extra else found
                yield pa.RecordBatch.from_pydict({c: part.column(c) for c in keep} | {k: pa.array(v) for k, v in found.items()})

    rows = docs.withColumn(text, F.col(text).cast("string"))
    return rows.select(*dict.fromkeys([*keep, text])).mapInArrow(run, f"{fields}, {made}")


def labelled(docs: DataFrame, labels: DataFrame, label: str, most: int):
    """Statistics and labels of at most ``most`` labelled documents, as two arrays on the driver.

    The labelled ids come in the order of a hash, so the choice is repeatable; rows without label or
    id count as unlabelled. A repeated id gives each of its rows.
    """
    ids = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    ids = ids.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col(label) > 0).cast("int").alias("label"))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(most)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids), "doc_id")  # bounded by ``most``
    found = with_statistics(rows, ["doc_id", "label"]).toPandas().sort_values(["doc_id", "label", *COUNTS])
    found = found.head(most)
    return found[FEATURES].to_numpy(float), found["label"].to_numpy(float)
