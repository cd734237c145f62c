"""Substring dedup by sliding sentence spans.

A run of consecutive sentences counts if it has at least two sentences and ``least_words`` words, or is one
sentence with twice as many words. Of equal runs the first one, by doc_id and then by place, stays, and sentences
covered by any other are removed. Hashed are the shortest runs from each start and the shortest ones to each end: these lie in
a passage wherever it stands and cover all of it, so they tell the same as all runs. Spans meet by a 128-bit hash.
"""

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, without
from .kernels import slices

LEAST_WORDS = 25
_END = re.compile(rb"[.!?]+[ \t]+|\n+")


def sentences(text: bytes) -> list[bytes]:
    """Pieces that make up the text: each ends behind ``.``, ``!`` or ``?`` and blanks, behind line feeds, or with the text."""
    out, at = [], 0
    for m in _END.finditer(text):
        out.append(text[at : m.end()])
        at = m.end()
    if at < len(text):
        out.append(text[at:])
    return out


def spans(pieces: list[bytes], least: int) -> tuple[list[bytes], list[int], list[int]]:
    """Digest, first and last piece of each span. Keys are words joined by one blank, A-Z lower-cased; blank pieces are no sentences."""
    words = [p.lower().split() for p in pieces]
    some = [i for i, w in enumerate(words) if w]
    keys = [b" ".join(words[i]) for i in some]
    size = [len(words[i]) for i in some]
    ends = []  # the shortest run from i holds keys[i : ends[i]]
    end, total = 0, 0  # the run holds keys[i:end]
    for i in range(len(some)):
        if end <= i:
            end, total = i, 0
        while end < len(some) and not (total >= least and (end - i > 1 or total >= 2 * least)):
            total += size[end]
            end += 1
        if not (total >= least and (end - i > 1 or total >= 2 * least)):
            break  # too little is left, also for later starts
        ends.append(end)
        total -= size[i]
    digests, first, last = [], [], []
    for i, end in enumerate(ends):
        hashed = xxhash.xxh3_128(b"\n".join(keys[i:end]))
        digests.append(hashed.digest())
        first.append(some[i])
        last.append(some[end - 1])
        # Up to where the next start's run ends, the shortest runs to an end begin here too.
        for k in range(end, ends[i + 1] - 1 if i + 1 < len(ends) else len(some)):
            hashed.update(b"\n" + keys[k])
            digests.append(hashed.digest())
            first.append(some[i])
            last.append(some[k])
    return digests, first, last


def _span_rows(docs: DataFrame, least: int) -> DataFrame:
    """``h1, h2, doc_id``, once for each different span of a row."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                ids, digests = [], []
                texts = part.column("text").cast(pa.binary()).to_pylist()
                for doc, text in zip(part.column("doc_id").to_pylist(), texts):
                    own = spans(sentences(text or b""), least)[0]
                    counts = dict.fromkeys(own, 1)
                    if len(counts) < len(own):
                        for d in own:
                            counts[d] += 1
                    digests += [d for d, c in counts.items() for _ in range(2 if c > 2 else 1)]
                    ids += [doc for c in counts.values() for _ in range(2 if c > 2 else 1)]
                h = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(ids, pa.int64())], names=["h1", "h2", "doc_id"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "h1 long, h2 long, doc_id long")


def dedup_spans(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """``docs`` with repeated passages taken out of ``text``, and ``n_sentences``, ``n_removed`` (both long).

    Null and empty texts have no sentences and become empty. Rows with the same doc_id are one document:
    what one of them holds is not removed from another, only repetitions inside each text. A null doc_id
    comes last, so it never makes another document lose a passage. Exact copies end up empty but for their first document.
    Other columns stay; columns named ``n_sentences`` or ``n_removed`` are replaced.
    """
    docs = without(docs, "n_sentences", "n_removed")
    own, lost = fresh(docs, "span_doc", "span_lost")
    rows = _span_rows(docs, least_words)
    repeated = rows.groupBy("h1", "h2").agg(F.min("doc_id").alias("keeper"), F.count("*").alias("n")).filter("n > 1").drop("n")
    found = rows.join(repeated, ["h1", "h2"]).select("doc_id", F.struct("h1", "h2", F.col("doc_id").eqNullSafe(F.col("keeper")).alias("own")).alias("s"))
    per_doc = found.groupBy(F.col("doc_id").alias(own)).agg(F.collect_set("s").alias(lost))
    joined = docs.join(per_doc, F.col("doc_id").cast("long").eqNullSafe(F.col(own)), "left").drop(own)
    columns = list(docs.columns)
    fields = [f if f.name != "text" else T.StructField("text", T.StringType()) for f in docs.schema.fields]
    schema = T.StructType([*fields, T.StructField("n_sentences", T.LongType()), T.StructField("n_removed", T.LongType())])

    def run(batches):
        for batch in batches:
            batch = batch.set_column(columns.index("text"), "text", batch.column("text").cast(pa.large_string()))
            for part in slices(batch, "text"):
                texts, n, gone = [], [], []
                for text, lose in zip(part.column("text").cast(pa.large_binary()).to_pylist(), part.column(lost).to_pylist()):
                    kept, count, removed = _cut(text or b"", lose, least_words)
                    texts.append(kept)
                    n.append(count)
                    gone.append(removed)
                out = {c: part.column(c) for c in columns}
                out["text"] = pa.array(texts, pa.large_binary()).cast(pa.large_string()).cast(pa.string())
                yield pa.RecordBatch.from_pydict(out | {"n_sentences": pa.array(n, pa.int64()), "n_removed": pa.array(gone, pa.int64())})

    return joined.mapInArrow(run, schema)


def _cut(text: bytes, lose, least: int) -> tuple[bytes, int, int]:
    pieces = sentences(text)
    n = sum(1 for p in pieces if p.strip(b" \t\n\x0b\x0c\r"))
    if not lose:
        return text, n, 0
    own = {np.array([x["h1"], x["h2"]], np.int64).tobytes(): x["own"] for x in lose}
    bad, seen = set(), set()
    for digest, a, b in zip(*spans(pieces, least)):
        if digest in own:
            if not own[digest] or digest in seen:
                bad.update(i for i in range(a, b + 1) if pieces[i].strip(b" \t\n\x0b\x0c\r"))
            seen.add(digest)
    return b"".join(p for i, p in enumerate(pieces) if i not in bad), n, len(bad)
