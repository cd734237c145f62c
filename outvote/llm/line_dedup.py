"""Reversible removal of repeated lines: exact reference counts behind sharded cuckoo filters.

The exact state is a table of references ``h1, h2, doc_id, n_lines``: how often a document holds a
line key (128-bit digest). Inserting or deleting documents adds a layer of references, negative ones for deletions, so any
history of insertions and deletions ends in the state of the documents that are left. A change looks up its own keys
in the layers and counts only these anew; layers are summed into one when there are many. Keys held by
enough documents are *repeated*; they are also kept in cuckoo filters, one a shard, that support
deletion. A decision first asks the filters, which drops nearly all references before anything is
shuffled, and then the exact table, so a filter's false positives change nothing.
"""

from array import array
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.staging import stage
from .common import BROADCAST_BYTES, fresh, without
from .kernels import draw, slices

_WHITE = b" \t\n\x0b\x0c\r"
SHARD_KEYS = 1 << 16  # keys a shard, about
PIECE_ROWS = 1 << 20  # references of a shard that meet its filter in one task, about
MOST_LAYERS = 8  # of references, before they are summed into one
_SLOTS, _KICKS = 4, 500
_KEY = ["h1", "h2"]


def line_key(line: bytes, least: int) -> bytes | None:
    """Stripped, A-Z lower-cased line; None if it has fewer than ``least`` code points."""
    key = line.strip(_WHITE).lower()
    if len(key) < least or len(key) < 4 * least and len(key.decode("utf-8", "replace")) < least:
        return None
    return key


class CuckooFilter:
    """16-bit fingerprints in buckets of four; keys are pairs of 64-bit hashes."""

    def __init__(self, n_keys: int, slots: bytes | None = None):
        self.n = 1 << max(0, int(np.ceil(np.log2(max(1, n_keys) / (_SLOTS * 0.8)))))
        self.slots = array("H", slots if slots is not None else bytes(2 * _SLOTS * self.n))
        self.n = len(self.slots) // _SLOTS

    @staticmethod
    def _hop(prints):
        return draw(prints.astype(np.uint64), 5)

    def _places(self, h1, h2):
        prints = (h1.view(np.uint64) >> np.uint64(48)) | np.uint64(1)
        mask = np.uint64(self.n - 1)
        first = h2.view(np.uint64) & mask
        return prints, first, first ^ (self._hop(prints) & mask)

    def add(self, h1, h2) -> bool:
        """Adds each key once; False if the filter is full (it then has to be built larger)."""
        if not len(h1):
            return True
        slots, mask = self.slots, self.n - 1
        hop = self._hop(np.arange(1 << 16)).tolist()
        for turn, (p, i, j) in enumerate(zip(*(x.tolist() for x in self._places(h1, h2)))):
            for bucket in (i, j):
                row = slots[_SLOTS * bucket : _SLOTS * bucket + _SLOTS]
                if 0 in row:
                    slots[_SLOTS * bucket + row.index(0)] = p
                    break
            else:
                bucket = j
                for kick in range(_KICKS):
                    at = _SLOTS * bucket + (turn + kick) % _SLOTS
                    p, slots[at] = slots[at], p
                    bucket ^= hop[p] & mask
                    row = slots[_SLOTS * bucket : _SLOTS * bucket + _SLOTS]
                    if 0 in row:
                        slots[_SLOTS * bucket + row.index(0)] = p
                        break
                else:
                    return False
        return True

    def remove(self, h1, h2) -> None:
        """Removes keys that were added before."""
        if not len(h1):
            return
        for p, i, j in zip(*(x.tolist() for x in self._places(h1, h2))):
            for bucket in (i, j):
                row = self.slots[_SLOTS * bucket : _SLOTS * bucket + _SLOTS]
                if p in row:
                    self.slots[_SLOTS * bucket + row.index(p)] = 0
                    break

    def holds(self, h1, h2) -> np.ndarray:
        prints, first, second = self._places(h1, h2)
        table = np.frombuffer(self.slots, np.uint16).reshape(self.n, _SLOTS)
        prints = prints.astype(np.uint16)[:, None]
        return (table[first.astype(np.int64)] == prints).any(1) | (table[second.astype(np.int64)] == prints).any(1)


def references(docs: DataFrame, least_chars: int) -> DataFrame:
    """``h1, h2, doc_id, n_lines``: the keyed lines of each document, counted."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                ids, digests, counts = [], [], []
                texts = part.column("text").cast(pa.binary()).to_pylist()
                for doc, text in zip(part.column("doc_id").to_pylist(), texts):
                    own: dict[bytes, int] = {}
                    for line in (text or b"").split(b"\n"):
                        key = line_key(line, least_chars)
                        if key is not None:
                            digest = xxhash.xxh3_128_digest(key)
                            own[digest] = own.get(digest, 0) + 1
                    ids += [doc] * len(own)
                    digests += own.keys()
                    counts += own.values()
                h = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(ids, pa.int64()), pa.array(counts, pa.int64())],
                    names=["h1", "h2", "doc_id", "n_lines"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "h1 long, h2 long, doc_id long, n_lines long")


class LineIndex:
    """State over all documents inserted and not deleted; every method returns a new index."""

    def __init__(self, layers: list[DataFrame], repeated: DataFrame, filters: DataFrame | None, n_shards: int, least_chars: int, least_docs: int):
        self.layers, self.repeated, self.least_chars, self.least_docs = layers, repeated, least_chars, least_docs
        self.n_shards = n_shards or max(1, -(-repeated.count() // SHARD_KEYS))
        self.filters = filters if filters is not None else self._built()

    @classmethod
    def of(cls, docs: DataFrame, least_chars: int = 20, least_docs: int = 3) -> "LineIndex":
        refs = stage(_summed(references(docs, least_chars)))
        return cls([refs], stage(_repeated(refs, least_docs)), None, 0, least_chars, least_docs)

    def _sharded(self, keys):
        return keys.withColumn("shard", F.pmod("h1", F.lit(self.n_shards)).cast("int"))

    def _built(self) -> DataFrame:
        def build(pdf):
            h1, h2, room = pdf["h1"].to_numpy(), pdf["h2"].to_numpy(), len(pdf)
            while not (made := CuckooFilter(room)).add(h1, h2):
                room *= 2
            return pd.DataFrame({"shard": pdf["shard"].iloc[:1], "slots": [made.slots.tobytes()]})

        return stage(self._sharded(self.repeated.select("h1", "h2")).groupBy("shard").applyInPandas(build, "shard int, slots binary"))

    def _changed(self, change: DataFrame) -> "LineIndex":
        """The index with a layer of references more; only their keys are counted anew."""
        change = stage(_summed(change))
        keys = stage(change.select(*_KEY).distinct())
        held = [layer.join(keys, _KEY, "left_semi") for layer in self.layers]
        both = stage(_summed(reduce(DataFrame.unionByName, [*held, change])))
        now = stage(_repeated(both.filter("n_lines > 0"), self.least_docs))
        # what was deleted but never inserted is taken back out of the layer
        absent = both.filter("n_lines < 0").withColumn("n_lines", -F.col("n_lines"))
        layers = [*self.layers, stage(_summed(change.unionByName(absent)).filter("n_lines <> 0"))]
        before = self.repeated.join(keys, _KEY, "left_semi")
        moves = now.join(before, _KEY, "left_anti").select(*_KEY, F.lit(1).alias("up"))
        moves = stage(self._sharded(moves.union(before.join(now, _KEY, "left_anti").select(*_KEY, F.lit(0)))))
        repeated = stage(self.repeated.join(keys, _KEY, "left_anti").unionByName(now))

        def update(before, moved):
            shard = (before if len(before) else moved)["shard"].iloc[0]
            made = CuckooFilter(1, before["slots"].iloc[0]) if len(before) else CuckooFilter(2 * len(moved))
            up = moved["up"].to_numpy() == 1
            made.remove(moved["h1"].to_numpy()[~up], moved["h2"].to_numpy()[~up])
            good = made.add(moved["h1"].to_numpy()[up], moved["h2"].to_numpy()[up])
            return pd.DataFrame({"shard": [shard], "slots": [made.slots.tobytes() if good else b""]})

        touched = moves.select("shard").distinct()
        both = self.filters.join(touched, "shard", "left_semi").groupBy("shard").cogroup(moves.groupBy("shard"))
        updated = both.applyInPandas(update, "shard int, slots binary")
        filters = stage(self.filters.join(touched, "shard", "left_anti").unionByName(updated))
        full = filters.filter(F.length("slots") == 0).count()  # then all are built anew, larger
        if len(layers) > MOST_LAYERS:
            layers = [stage(_live(layers))]
        return LineIndex(layers, repeated, None if full else filters, 0 if full else self.n_shards, self.least_chars, self.least_docs)

    def insert(self, docs: DataFrame) -> "LineIndex":
        return self._changed(references(docs, self.least_chars))

    def delete(self, docs: DataFrame) -> "LineIndex":
        """``docs`` are rows as they were inserted."""
        return self._changed(references(docs, self.least_chars).withColumn("n_lines", -F.col("n_lines")))

    def maybe_repeated(self) -> DataFrame:
        """The references whose key passes its shard's filter.

        Filters go out in one map if all of them have at most BROADCAST_BYTES; else references and filters meet by shard.
        """
        refs = reduce(DataFrame.unionByName, self.layers)
        refs = refs.select("h1", "h2", "doc_id") if len(self.layers) == 1 else refs
        size = self.filters.agg(F.sum(F.length("slots"))).first()[0] or 0
        if size > BROADCAST_BYTES:
            out = self._met_by_shard(refs)
        else:
            held = {r["shard"]: bytes(r["slots"]) for r in self.filters.collect()}
            out = refs.mapInArrow(_passing(held, self.n_shards), refs.schema)
        return out if len(self.layers) == 1 else _live([out]).select("h1", "h2", "doc_id")

    def _met_by_shard(self, refs: DataFrame) -> DataFrame:
        """As one map would: shards in pieces of about PIECE_ROWS references, so that no hot key fills a task, each sorted behind its filter."""
        rows = self._sharded(refs)
        pieces = rows.groupBy("shard").agg(F.ceil(F.count("*") / PIECE_ROWS).cast("int").alias("pieces"))
        pieces = stage(pieces.join(self.filters.select("shard"), "shard"))
        piece = F.pmod(F.xxhash64(F.lit(3), "h2", "doc_id"), F.col("pieces")).cast("int")
        rows = rows.join(pieces, "shard").select("shard", piece.alias("piece"), F.lit(None).cast("binary").alias("slots"), *refs.columns)
        ahead = self.filters.join(pieces, "shard").withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
        ahead = ahead.select("shard", "piece", "slots", *(F.lit(None).cast(f.dataType).alias(f.name) for f in refs.schema))
        both = ahead.union(rows).repartition("shard", "piece").sortWithinPartitions("shard", "piece", F.col("slots").isNull())
        return both.mapInArrow(_passing_next, refs.schema)

    def drops(self) -> DataFrame:
        """``h1, h2, doc_id``: keys that a document loses, which is all its repeated ones but where it is the last holder."""
        found = self.maybe_repeated().join(self.repeated, ["h1", "h2"])
        return found.filter(~F.col("doc_id").eqNullSafe(F.col("last"))).select("h1", "h2", "doc_id")


def _summed(refs):
    return refs.groupBy("h1", "h2", "doc_id").agg(F.sum("n_lines").alias("n_lines"))


def _live(layers):
    """The references that insertions and deletions leave."""
    return _summed(reduce(DataFrame.unionByName, layers)).filter("n_lines > 0")


def _repeated(refs, least_docs):
    counts = refs.groupBy("h1", "h2").agg(F.count("doc_id").alias("docs"), F.max("doc_id").alias("last"))
    return counts.filter(F.col("docs") >= least_docs).select("h1", "h2", "last")


def _passing(held: dict[int, bytes], n_shards: int):
    def run(batches):
        filters = {k: CuckooFilter(1, v) for k, v in held.items()}
        for batch in batches:
            h1, h2 = batch.column("h1").to_numpy(), batch.column("h2").to_numpy()
            shard, good = np.mod(h1, n_shards), np.zeros(len(h1), bool)
            for k, made in filters.items():
                mine = np.flatnonzero(shard == k)
                good[mine] = made.holds(h1[mine], h2[mine])
            yield batch.filter(pa.array(good))

    return run


def _passing_next(batches):
    """Of references that stand behind their piece's filter, those that pass it; one filter is held at a time."""
    made = None
    for batch in batches:
        slots = batch.column("slots")
        rows = batch.drop_columns(["shard", "piece", "slots"])
        starts = np.flatnonzero(slots.is_valid().to_numpy(zero_copy_only=False)).tolist()
        for begin, end in zip([-1, *starts], [*starts, len(batch)]):
            if begin >= 0:
                made = CuckooFilter(1, slots[begin].as_py())
            part = rows.slice(begin + 1, end - begin - 1)
            if part.num_rows:
                yield part.filter(pa.array(made.holds(part.column("h1").to_numpy(), part.column("h2").to_numpy())))


def dedup_lines(docs: DataFrame, least_chars: int = 20, least_docs: int = 3) -> DataFrame:
    """``docs`` with repeated lines taken out of ``text``, and ``n_lines``, ``n_dropped`` (both long).

    A text splits at line feeds; null or empty is one empty line, and the result is never null. A line's
    key is the line without ASCII white space at its ends, A-Z lower-cased. Keys of at least
    ``least_chars`` code points held by at least ``least_docs`` documents lose all their lines except in the
    largest doc_id that holds them, which keeps all of its own. Rows with the same doc_id are one
    document. A null doc_id is no document: it counts in no key and keeps no repeated line.
    Other columns stay; columns named ``n_lines`` or ``n_dropped`` are replaced.
    """
    return apply_drops(docs, LineIndex.of(docs, least_chars, least_docs))


def apply_drops(docs: DataFrame, index: LineIndex) -> DataFrame:
    """Takes an index' decisions to the texts of ``docs``."""
    least = index.least_chars
    docs = without(docs, "n_lines", "n_dropped")
    own, lost = fresh(docs, "ld_doc", "ld_lost")
    digest = F.struct("h1", "h2")
    per_doc = index.drops().groupBy("doc_id").agg(F.collect_set(digest).alias(lost)).withColumnRenamed("doc_id", own)
    rows = docs.join(per_doc, F.col("doc_id").cast("long").eqNullSafe(F.col(own)), "left").drop(own)
    columns = list(docs.columns)
    fields = [f if f.name != "text" else T.StructField("text", T.StringType()) for f in docs.schema.fields]
    schema = T.StructType([*fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])

    def run(batches):
        for batch in batches:
            for part in slices(batch.set_column(columns.index("text"), "text", batch.column("text").cast(pa.large_string())), "text"):
                texts, n, gone = [], [], []
                for text, lose in zip(part.column("text").cast(pa.large_binary()).to_pylist(), part.column(lost).to_pylist()):
                    lines = (text or b"").split(b"\n")
                    n.append(len(lines))
                    if lose:
                        lose = {np.array([x["h1"], x["h2"]], np.int64).tobytes() for x in lose}
                        lines = [x for x in lines if (k := line_key(x, least)) is None or xxhash.xxh3_128_digest(k) not in lose]
                    texts.append(b"\n".join(lines))
                    gone.append(n[-1] - len(lines))
                out = {c: part.column(c) for c in columns}
                out["text"] = pa.array(texts, pa.large_binary()).cast(pa.large_string()).cast(pa.string())
                out |= {"n_lines": pa.array(n, pa.int64()), "n_dropped": pa.array(gone, pa.int64())}
                yield pa.RecordBatch.from_pydict(out)

    return rows.mapInArrow(run, schema)
