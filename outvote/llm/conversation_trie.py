"""Prefix trie of conversations: which turns are shared, and how many tokens sharing them saves.

Steps, each a Spark job over staged tables:

1. Turns are told apart by the SHA-256 of role and text; a dictionary gives each distinct one a number, in the
   order of the digests. Texts go no further.
2. Conversations become arrays of these numbers and are rebuilt from the head of another one and their own tail.
3. Range partitioning by (array, id) brings conversations with a common head together. A partition is cut into shards
   of about ``SHARD_TURNS`` turns, however many conversations are equal.
4. Each shard builds a ternary search tree, the median sequence first, so that it is balanced. One pass over its
   nodes from the last made to the first adds up members, leaves and savings.
5. Nodes on the path that two neighbouring shards share are merged. Everything a node reports is a sum (or the
   smallest) over shards, once each shard knows how long the path is that it shares with its neighbours:
   the shard where a node begins counts it as a child and takes off its first copy, the one where it ends counts the leaf.

A task holds one shard; a conversation is never split, so it also holds the numbers (16 bytes a turn) of the longest one.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.ranks import distributed_rank
from ..plans.staging import lookup, row_bytes, stage
from .common import spread_join, word_count

SHARD_TURNS = 200_000
NOBODY = hashlib.sha256(b"").hexdigest()


def coded_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, code, words``: dictionary numbers of the turns, and the words of their texts."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    whole = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.unhex(F.sha2(whole, 256)).alias("digest"), word_count(text).alias("words"),
    )
    turns = stage(turns.filter("conv_id is not null"))
    distinct = turns.groupBy("digest").agg(F.max("words").alias("words"), F.count("*").alias("n"))
    dictionary = stage(distributed_rank(distinct, ["digest"], "code"))
    return spread_join(turns.select("conv_id", "turn", "digest"), dictionary, "digest", "n").select("conv_id", "turn", "code", "words")


def sequences(turns: DataFrame) -> DataFrame:
    """``conv_id, codes, words``: a conversation's turns in order."""
    order = F.struct(F.col("turn").isNotNull().alias("some"), F.coalesce("turn", F.lit(0)).alias("turn"), "code", "words")
    own = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(order)).alias("t"))
    return own.select("conv_id", F.col("t.code").alias("codes"), F.col("t.words").alias("words"))


def rebuilt(own: DataFrame, stride: int = 20, heads: int = 4) -> DataFrame:
    """The first h turns of conversation ``c - c % stride``, then c's own after its first h; h = crc32(c) % heads."""
    own = stage(own)
    names = ("codes", "words")
    heads_of = own.select(F.col("conv_id").alias("base"), *[F.slice(c, 1, heads - 1).alias(f"head_{c}") for c in names])
    rows = own.withColumns({"base": F.col("conv_id") - F.col("conv_id") % stride, "h": (F.crc32(F.col("conv_id").cast("string")) % heads).cast("int")})
    rows = rows.join(heads_of, "base", "left")  # at most 2 * stride - 1 conversations have the same base
    empty = F.array().cast("array<bigint>")
    head = lambda c: F.slice(F.coalesce(f"head_{c}", empty), F.lit(1), F.col("h"))
    tail = lambda c: F.slice(c, F.col("h") + 1, F.greatest(F.size(c) - F.col("h"), F.lit(0)))
    return rows.select("conv_id", *[F.concat(head(c), tail(c)).alias(c) for c in names])


_SHARD = "part long, k long, ids binary, lengths binary, codes binary, words binary, first array<long>, last array<long>"


def _shards(rows: DataFrame) -> DataFrame:
    """Rows of consecutive conversations in the order of their codes, about SHARD_TURNS turns each."""
    rows = stage(rows)
    turns = rows.agg(F.sum(F.size("codes") + 1)).first()[0] or 0
    ordered = rows.repartitionByRange(max(1, -(-turns // SHARD_TURNS)), "codes", "conv_id").sortWithinPartitions("codes", "conv_id")
    kinds = [pa.int64(), pa.int64(), *[pa.binary()] * 4, pa.list_(pa.int64()), pa.list_(pa.int64())]
    names = [c.split()[0] for c in _SHARD.split(", ")]

    def run(batches):
        from pyspark import TaskContext

        part, k, held, size = TaskContext.get().partitionId(), 0, [], 0

        def shard():
            nonlocal k, held, size
            ids, lengths, codes, words = (np.concatenate([h[i] for h in held]) for i in range(4))
            first, last = codes[: lengths[0]], codes[len(codes) - lengths[-1] :]
            data = [part, k, ids.tobytes(), lengths.tobytes(), codes.tobytes(), words.tobytes(), first, last]
            k, held, size = k + 1, [], 0
            return pa.RecordBatch.from_arrays([pa.array([d], t) for d, t in zip(data, kinds)], names=names)

        for batch in batches:
            ids = batch.column("conv_id").to_numpy()
            lengths = batch.column("codes").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            codes, words = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("codes", "words"))
            at = np.concatenate([[0], np.cumsum(lengths)])
            lo = 0
            while lo < len(ids):
                room = max(SHARD_TURNS - size, 1)
                hi = max(lo + 1, int(np.searchsorted(at[1:] - at[lo] + np.arange(1, len(at)) - lo, room, "right")))
                held.append((ids[lo:hi], lengths[lo:hi], codes[at[lo] : at[hi]], words[at[lo] : at[hi]]))
                size += int(at[hi] - at[lo]) + hi - lo
                lo = hi
                if size >= SHARD_TURNS:
                    yield shard()
        if held:
            yield shard()

    return stage(ordered.mapInArrow(run, _SHARD))


def _common(a, b) -> int:
    """Length of the common head of two sequences; -1 if one is missing."""
    if a is None or b is None:
        return -1
    n = min(len(a), len(b))
    differ = np.flatnonzero(np.asarray(a[:n]) != np.asarray(b[:n]))
    return int(differ[0]) if len(differ) else n


def _shared_paths(shards: DataFrame) -> DataFrame:
    """``part, k, before, after``: how many turns of its first (last) sequence a shard shares with the one before (after) it.

    One row a shard is brought into order, with two sequences of numbers.
    """
    over = Window.orderBy("part", "k")
    ends = shards.select("part", "k", "first", "last")
    ends = ends.select("*", F.lag("last").over(over).alias("prior"), F.lead("first").over(over).alias("next"))

    def run(batches):
        for batch in batches:
            columns = {c: batch.column(c).to_pylist() for c in ("first", "last", "prior", "next")}
            before = [_common(a, b) for a, b in zip(columns["prior"], columns["first"])]
            after = [_common(a, b) for a, b in zip(columns["last"], columns["next"])]
            found = [batch.column("part"), batch.column("k"), pa.array(before, pa.int64()), pa.array(after, pa.int64())]
            yield pa.RecordBatch.from_arrays(found, names=["part", "k", "before", "after"])

    return stage(ends.mapInArrow(run, "part long, k long, before long, after long"))


def _median_order(n: int):
    """0..n-1, the middle one first, then the middles of both halves, and so on."""
    waiting = [(0, n)]
    while waiting:
        lo, hi = waiting.pop()
        if lo < hi:
            middle = (lo + hi) // 2
            yield middle
            waiting += [(middle + 1, hi), (lo, middle)]


class TernarySearchTree:
    """Symbols below a root without one; node ``i`` was made after its parent ``up[i]``."""

    def __init__(self):
        self.symbol, self.low, self.high, self.down = [None], [-1], [-1], [-1]
        self.up, self.depth, self.words = [-1], [0], [0]

    def _add(self, symbol, words, parent) -> int:
        for column, value in ((self.symbol, symbol), (self.low, -1), (self.high, -1), (self.down, -1)):
            column.append(value)
        self.up.append(parent)
        self.depth.append(self.depth[parent] + 1)
        self.words.append(words)
        return len(self.up) - 1

    def insert(self, sequence, words) -> int:
        """The node where the sequence ends, made with its path if it is new."""
        at = 0
        for symbol, size in zip(sequence, words):
            here = self.down[at]
            if here < 0:
                here = self.down[at] = self._add(symbol, size, at)
            while self.symbol[here] != symbol:
                side = self.low if symbol < self.symbol[here] else self.high
                if side[here] < 0:
                    side[here] = self._add(symbol, size, at)
                here = side[here]
            at = here
        return at

    def path(self, node) -> list[int]:
        """Nodes from the root to this one."""
        out = [node]
        while self.up[out[-1]] >= 0:
            out.append(self.up[out[-1]])
        return out[::-1]


_NODES = (
    "key binary, conv_id long, depth long, parent_conv_id long, parent_key binary, n_convs long, n_children long, n_leaves long, saved_tokens long, "
    "ends_sha256 string, ends string, part long, k long"
)


def _node_rows(row) -> pa.RecordBatch:
    """All nodes of a shard. Those shared with a neighbour have a ``key`` and hold this shard's part of the sums."""
    ids, lengths, codes, words = (np.frombuffer(row[c], np.int64) for c in ("ids", "lengths", "codes", "words"))
    at = np.concatenate([[0], np.cumsum(lengths)])
    n = len(ids)
    groups = [0]  # where a new sequence begins
    for i in range(1, n):
        if lengths[i] != lengths[i - 1] or not np.array_equal(codes[at[i] : at[i + 1]], codes[at[i - 1] : at[i]]):
            groups.append(i)
    groups.append(n)

    tree, ends = TernarySearchTree(), {}
    for g in _median_order(len(groups) - 1):
        lo, hi = at[groups[g]], at[groups[g] + 1]
        ends[tree.insert(codes[lo:hi].tolist(), words[lo:hi].tolist())] = g
    first = tree.path(next(node for node, g in ends.items() if g == 0))
    last = tree.path(next(node for node, g in ends.items() if g == len(groups) - 2))
    begun, going = set(first[: row["before"] + 1]), set(last[: row["after"] + 1])
    keys = {}
    for path, shared, sequence in ((first, begun, codes[: lengths[0]]), (last, going, codes[len(codes) - lengths[-1] :])):
        digest = hashlib.sha256()
        for d, node in enumerate(path):
            if node not in shared:
                break
            if d:
                digest.update(sequence[d - 1].tobytes())
            keys[node] = digest.digest()

    size = len(tree.up)
    members, children, fresh, leaves, saved = ([0] * size for _ in range(5))
    least, text = [None] * size, [""] * size
    for node in range(size - 1, -1, -1):
        if node in ends:
            own = ids[groups[ends[node]] : groups[ends[node] + 1]]
            members[node] += len(own)
            least[node] = int(own[0]) if least[node] is None else min(least[node], int(own[0]))
            text[node] = ",".join(map(str, own.tolist()))
        if not children[node] and node not in going:
            leaves[node] += 1
        saved[node] += members[node] * tree.words[node] - (0 if node in begun else tree.words[node])
        up = tree.up[node]
        if up >= 0:
            members[up] += members[node]
            children[up] += 1
            fresh[up] += node not in begun
            leaves[up] += leaves[node]
            saved[up] += saved[node]
            least[up] = least[node] if least[up] is None else min(least[up], least[node])

    open_ = [i in keys for i in range(size)]
    columns = [
        [keys.get(i) for i in range(size)], least, tree.depth,
        [None if up < 0 or open_[up] else least[up] for up in tree.up], [keys.get(up) if up >= 0 else None for up in tree.up],
        members, fresh, leaves, saved,
        [None if o else hashlib.sha256(t.encode()).hexdigest() for o, t in zip(open_, text)], [t if o and t else None for o, t in zip(open_, text)],
        [row["part"]] * size, [row["k"]] * size,
    ]
    kinds = {"binary": pa.binary(), "long": pa.int64(), "string": pa.string()}
    fields = [f.split() for f in _NODES.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, (_, t) in zip(columns, fields)], names=[f for f, _ in fields])


def _ends_digests(pieces: DataFrame) -> DataFrame:
    """``key, ends_sha256`` of ``key, part, k, ends``; a hash takes its pieces in order, one text of a shard at a time."""

    def run(batches):
        key, digest = None, None
        for batch in batches:
            for own, ends in zip(batch.column("key").to_pylist(), batch.column("ends").to_pylist()):
                if own != key:
                    if key is not None:
                        yield _found(key, digest)
                    key, digest = own, hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(ends.encode())
        if key is not None:
            yield _found(key, digest)

    def _found(key, digest):
        return pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([digest.hexdigest()])], names=["key", "ends_sha256"])

    ordered = pieces.select("key", "part", "k", "ends").repartition("key").sortWithinPartitions("key", "part", "k")
    return ordered.mapInArrow(run, "key binary, ends_sha256 string")


RESULT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie_nodes(rows: DataFrame) -> DataFrame:
    """One row a node of the trie of ``conv_id, codes, words`` (ids must be unique, arrays as long as each other)."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                yield _node_rows(row)

    shards = _shards(rows)
    ready = lookup(shards.drop("first", "last"), _shared_paths(shards), ["part", "k"], "inner", row_bytes(4))
    nodes = stage(ready.mapInArrow(run, _NODES))
    open_ = nodes.filter("key is not null")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    merged = open_.groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.max("parent_key").alias("parent_key"), *sums)
    merged = merged.join(_ends_digests(open_.filter("ends is not null")), "key", "left")
    merged = stage(merged.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NOBODY))))

    parents = merged.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("of_parent"))
    closed = nodes.filter("key is null").select(*RESULT, "parent_key")
    rest = merged.withColumn("parent_conv_id", F.lit(None).cast("long")).select(*RESULT, "parent_key")
    whole = lookup(closed.unionByName(rest), parents, ["parent_key"], "left", row_bytes(8))
    return whole.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "of_parent")).select(*RESULT)


def conversation_trie(conversations: DataFrame, stride: int = 20, heads: int = 4) -> DataFrame:
    """The trie of all rebuilt conversations of ``conv_id, turn, role, text``; one row a node.

    Turns are ordered by ``turn``, null first; equal ones by the SHA-256 of role and text. Null roles and texts count as
    empty. Rows without conv_id belong to no conversation and are left out; a repeated row is a turn of its own.
    ``n_children`` and the like are those of the contract: ``conv_id`` is the smallest member, the root has depth
    0 and no parent, ``ends_sha256`` digests the members that end at the node. An empty table has no nodes. Other columns,
    whatever their names, are ignored.
    """
    return trie_nodes(rebuilt(sequences(coded_turns(conversations)), stride, heads))
