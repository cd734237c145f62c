"""Jaccard join of word n-gram sets by prefix trees.

A set is the ascending sequence of its n-grams' 64-bit hashes, which is one global order for all sets. A prefix tree
stores sequences with shared heads once; a probe walks it with the overlap so far, and leaves a subtree
as soon as what remains of the probe or of every set below is too short to reach the wanted similarity.

Which sets meet in one tree: sets a and b with ``|a & b| / |a | b| >= p`` differ in at most
``(|a| + |b|) (1 - p) / (1 + p)`` n-grams. If all n-grams are dealt by a second hash to one segment more than
that, the sets agree in a whole segment. Sizes are cut into classes, each with its number of segments, and a set
has one key for each segment: in its own class, where it may be the smaller set of a pair, and in the classes
below whose sets may be its smaller partners. So linked sets share a key, always.

A set also has a vector for each of its classes: ``FINE`` times as many segments, and a byte of the digest of each. Sets of
a pair differ in no more bytes than they may differ in n-grams, so most sets that only share a key are told apart by
vectors, without their n-grams.

Steps, each a Spark job over staged tables:

1. One pass over the texts: size, 128-bit digest and keys of each set. Equal sets become one node.
2. Keys of one node only are dropped; vectors and full sets of the nodes left are made and staged.
3. Star rounds. In the bucket of a key the smallest node is the centre; each node is compared with the centre it
   shares most keys with, then with the centres of its other buckets that are in another component, first by vectors. The
   nodes of a centre are stored in prefix trees of about ``TREE_BYTES``, which the centre probes.
4. Buckets that still hold several components: nodes whose vectors are near that of a node of another component in
   their bucket go into trees, and probe them.

Nothing is approximate but the hashes: 64 bits for an n-gram, 128 for a set.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.staging import lookup, row_bytes, stage
from .common import spread_join
from .components import components
from .filters import BitFilter
from .kernels import Words, draw, mix, shingle_set, slices

GROWTH = 1.25  # of the sizes of a class
FINE = 8
TREE_BYTES = 8 << 20
_CLASS_BITS = 7  # a key ends with the number of its class


def _sets(column, width):
    words = Words(column, lower=True)
    return [shingle_set(words.hashes[words.at[i] : words.at[i + 1]], width) for i in range(len(column))]


class SizeClasses:
    """Sizes ``[start[j], start[j + 1])`` form class j; ``segments[j]`` is 1 more than sets of a pair can differ in if the smaller is of class j."""

    def __init__(self, percent: int, most: int = 1 << 33):
        start = [1]
        while start[-1] <= most:
            start.append(max(start[-1] + 1, int(start[-1] * GROWTH)))
        self.percent, self.start = percent, np.array(start, np.int64)
        last = self.start[1:] - 1
        self.segments = (last + 100 * last // percent) * (100 - percent) // (100 + percent) + 1

    def of(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.start, sizes, "right") - 1

    def reach(self, classes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Whether some set of the class can be the smaller partner of a set of this size."""
        last = self.start[np.maximum(classes, 0) + 1] - 1
        return (classes >= 0) & (100 * last >= self.percent * sizes)


def _segments(sets: list[np.ndarray], classes: SizeClasses, fine: int):
    """Yields, for a set's own class and then each lower one that it reaches: the sets' classes, segment numbers, their bounds and digests.

    Entries of set i are ``at[i]:at[i + 1]``; there are none for sets out of reach and for classes whose pairs cannot differ.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    elements = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    place, value = draw(elements, 7), draw(elements, 31)
    own = classes.of(np.maximum(sizes, 1))
    for back in range(len(classes.segments)):
        cls = own - back
        fits = (sizes > 0) & classes.reach(cls, sizes)
        if not fits.any():
            return
        m = np.where(fits, classes.segments[np.maximum(cls, 0)], 0)
        m = np.where(m > 1, m * fine, 0)
        at = np.concatenate([[0], np.cumsum(m)])
        use = m[owner] > 0
        total = np.zeros(at[-1], np.uint64)
        np.add.at(total, at[owner[use]] + (place[use] % m[owner[use]].astype(np.uint64)).astype(np.int64), value[use])
        number = np.arange(at[-1]) - np.repeat(at[:-1], m)
        yield cls, number.astype(np.uint64), at, total


def segment_keys(sets: list[np.ndarray], classes: SizeClasses) -> list[bytes]:
    """All keys of each set, eight bytes each."""
    found = [b""] * len(sets)
    for cls, number, at, total in _segments(sets, classes, 1):
        label = np.repeat(cls.clip(0).astype(np.uint64), np.diff(at))
        keys = mix(total ^ mix((label << np.uint64(48)) + number + np.uint64(1)))
        keys = (keys >> np.uint64(_CLASS_BITS) << np.uint64(_CLASS_BITS)) | label
        for i in np.flatnonzero(np.diff(at)):
            found[i] += keys[at[i] : at[i + 1]].tobytes()
    return found


def vectors(sets: list[np.ndarray], classes: SizeClasses) -> list[list[tuple[int, bytes]]]:
    """``(class, vector)`` of each set, its own class first."""
    found: list[list[tuple[int, bytes]]] = [[] for _ in sets]
    for cls, _, at, total in _segments(sets, classes, FINE):
        data = (mix(total) & np.uint64(255)).astype(np.uint8)
        for i in np.flatnonzero(np.diff(at)):
            found[i].append((int(cls[i]), data[at[i] : at[i + 1]].tobytes()))
    return found


def _digests(sets):
    """Two sums over the elements of each set, which need no order."""
    elements = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    out = []
    for k in (101, 102):
        total = np.zeros(len(sets), np.uint64)
        np.add.at(total, owner, draw(elements, k))
        out.append(pa.array(total.view(np.int64)))
    return out


def _signatures(docs: DataFrame, percent: int, width: int) -> DataFrame:
    """``doc_id, n_shingles, d1, d2, keys`` of each row."""
    classes = SizeClasses(percent)

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                sets = _sets(part.column("text"), width)
                size = pa.array(np.array([len(s) for s in sets], np.int64))
                found = [part.column("doc_id"), size, *_digests(sets), pa.array(segment_keys(sets, classes), pa.binary())]
                yield pa.RecordBatch.from_arrays(found, names=["doc_id", "n_shingles", "d1", "d2", "keys"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, d1 long, d2 long, keys binary")


def _exploded(nodes: DataFrame, sieve: BitFilter | None = None) -> DataFrame:
    """``key, node``, without most of the keys that ``sieve`` does not hold."""

    def run(batches):
        for batch in batches:
            sizes = np.array([len(k) // 8 for k in batch.column("keys").to_pylist()], np.int64)
            keys = np.frombuffer(b"".join(batch.column("keys").to_pylist()), np.int64)
            ids = np.repeat(batch.column("node").to_numpy(), sizes)
            if sieve is not None:
                some = sieve.holds(keys)
                keys, ids = keys[some], ids[some]
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(ids)], names=["key", "node"])

    return nodes.select("node", "keys").mapInArrow(run, "key long, node long")


def _made_sets(docs: DataFrame, wanted: DataFrame, percent: int, width: int) -> tuple[DataFrame, DataFrame]:
    """Vectors ``node, size, own, cls, vector`` and full sets ``node, d1, d2, size, set`` of the wanted ``node, d1, d2``.

    Vectors have one row a node and class. Among the sets are some that are not wanted, and those of repeated rows more
    than once; ``_sets_of`` settles that for those it takes.
    """
    sieve, classes = BitFilter.of(wanted, "node"), SizeClasses(percent)

    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id")
            hit = sieve.holds(ids.fill_null(0).to_numpy()) & ids.is_valid().to_numpy(zero_copy_only=False)
            for part in slices(batch.filter(pa.array(hit)), "text"):
                sets, ids = _sets(part.column("text"), width), part.column("doc_id").to_pylist()
                d1, d2 = (d.to_pylist() for d in _digests(sets))
                rows = []
                for i, found in enumerate(vectors(sets, classes)):
                    for k, (cls, vector) in enumerate(found):
                        rows.append((ids[i], d1[i], d2[i], len(sets[i]), None if k else sets[i].tobytes(), found[0][0], cls, vector))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary()]
                columns = list(zip(*rows)) or [[]] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["node", "d1", "d2", "size", "set", "own", "cls", "vector"])

    made = stage(docs.mapInArrow(run, "node long, d1 long, d2 long, size long, set binary, own long, cls long, vector binary"))
    near = made.select("node", "d1", "d2", "size", "own", "cls", "vector").join(wanted, ["node", "d1", "d2"], "left_semi")
    near = stage(near.dropDuplicates(["node", "cls"]).select("node", "size", "own", "cls", "vector"))
    return near, made.filter("set is not null").select("node", "d1", "d2", "size", "set")


def _sets_of(sets: DataFrame, wanted: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, size, set`` of some nodes, one row each."""
    some = stage(wanted.join(nodes.select("node").distinct(), "node", "left_semi"))
    found = lookup(sets, some.select("node", "d1", "d2"), ["node", "d1", "d2"], "inner", row_bytes(3))
    return stage(found.select("node", "size", "set").dropDuplicates(["node"]))


def _most_apart(a, b, percent: int):
    """In how many elements linked sets of these sizes can differ."""
    return (a + b) * (100 - percent) // (100 + percent)


class PrefixTree:
    """Ascending sequences with shared heads stored once.

    A node is a range ``low:high`` of the sorted sequences and the run of elements ``start:end`` that all of them have there;
    the sequence that ends with the run, if any, is the first of the range.
    """

    def __init__(self, sets: list[np.ndarray]):
        order = sorted(range(len(sets)), key=lambda i: sets[i].byteswap().tobytes())  # big-endian bytes sort as the numbers do
        self.order, self.sets = order, [sets[i] for i in order]
        self.sizes = np.array([len(s) for s in self.sets], np.int64)
        self.common = np.zeros(len(sets) + 1, np.int64)
        for i in range(1, len(sets)):
            a, b = self.sets[i - 1], self.sets[i]
            n = min(len(a), len(b))
            differ = np.flatnonzero(a[:n] != b[:n])
            self.common[i] = differ[0] if len(differ) else n
        self.nodes: list[tuple] = []  # low, high, start, end, least size, largest size, children
        waiting = [(0, len(sets), 0, None)] if sets else []
        while waiting:
            low, high, start, parent = waiting.pop()
            inner = self.common[low + 1 : high]
            end = int(inner.min()) if len(inner) else len(self.sets[low])
            sizes = self.sizes[low:high]
            children: list[int] = []
            self.nodes.append((low, high, start, end, int(sizes.min()), int(sizes.max()), children))
            if parent is not None:
                self.nodes[parent][-1].append(len(self.nodes) - 1)
            if high - low > 1:
                cuts = [low, *(low + 1 + np.flatnonzero(inner == end)).tolist(), high]
                own = len(self.nodes) - 1
                waiting += [(a, b, end, own) for a, b in zip(cuts, cuts[1:])]

    def similar(self, probe: np.ndarray, percent: int) -> list[int]:
        """Numbers of the sets with ``100 * |a & b| >= percent * |a | b|``; ``probe`` ascends."""
        found, n = [], len(probe)
        waiting = [(0, 0)] if self.nodes else []
        while waiting:
            node, overlap = waiting.pop()
            low, high, start, end, least, largest, children = self.nodes[node]
            rest = n
            if end > start:
                run = self.sets[low][start:end]
                at = np.searchsorted(probe, run)
                rest = n - int(np.searchsorted(probe, run[-1], "right"))
                overlap += int((probe[np.minimum(at, n - 1)] == run).sum()) if n else 0
            elif end:
                rest = n - int(np.searchsorted(probe, self.sets[low][end - 1], "right"))
            # Of all sizes below, the one that leaves as much as the probe has left is the most favourable.
            size = min(max(end + rest, least), largest)
            if (100 + percent) * (overlap + min(size - end, rest)) < percent * (size + n):
                continue
            if self.sizes[low] == end and high - low == 1:
                found.append(self.order[low])
            waiting += [(child, overlap) for child in children]
        return found


def _groups(batches, by):
    """Tables of all rows of one group, from rows that come group by group."""
    held = []
    for batch in batches:
        if not batch.num_rows:
            continue
        new = np.zeros(batch.num_rows, bool)
        for c in by:
            values = batch.column(c).to_numpy()
            new[1:] |= values[1:] != values[:-1]
        if held:
            new[0] = any(held[-1].column(c)[held[-1].num_rows - 1] != batch.column(c)[0] for c in by)
        cuts = np.flatnonzero(new).tolist()
        for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows]):
            if lo in cuts and held:
                yield pa.Table.from_batches(held)
                held = []
            if hi > lo:
                held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def _as_sets(column) -> list[np.ndarray]:
    return [np.frombuffer(s, np.uint64) for s in column.to_pylist()]


def _links(pairs) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], names=["a", "b"])


def _parts(size):
    """Trees for so many elements."""
    return F.ceil(size * 8 / TREE_BYTES).cast("int")


def _near(pairs: DataFrame, near: DataFrame, percent: int) -> DataFrame:
    """The pairs ``node, centre`` whose vectors allow a link."""
    names = ("size", "own", "vector")
    rows = pairs.join(near.withColumnsRenamed({c: f"{c}_a" for c in names}), "node")
    rows = rows.join(near.withColumnsRenamed({"node": "centre"} | {c: f"{c}_b" for c in names}), ["centre", "cls"])
    rows = rows.filter(F.col("cls") == F.least("own_a", "own_b"))  # the class of the smaller set

    def run(batches):
        for batch in batches:
            x, y = (batch.column(c).to_pylist() for c in ("vector_a", "vector_b"))
            most = _most_apart(*(batch.column(c).to_numpy() for c in ("size_a", "size_b")), percent)
            apart = np.array([np.count_nonzero(np.frombuffer(p, np.uint8) != np.frombuffer(q, np.uint8)) for p, q in zip(x, y)], np.int64)
            yield batch.select(["node", "centre"]).filter(pa.array(apart <= most))

    return rows.select("node", "centre", "size_a", "size_b", "vector_a", "vector_b").mapInArrow(run, "node long, centre long")


def _star_links(pairs: DataFrame, near: DataFrame, sets_of, percent: int) -> DataFrame:
    """Links among pairs ``node, centre``: the sets of a centre's nodes are stored in trees, which the centre probes."""
    pairs = stage(_near(pairs, near, percent))
    sets = sets_of(pairs.select("node").union(pairs.select("centre")))
    stored = stage(pairs.join(sets.select("node", "size"), "node"))
    parts = stage(stored.groupBy("centre").agg(_parts(F.sum("size")).alias("parts"), F.count("*").alias("n")))
    block = F.pmod(F.xxhash64("node", F.lit(7)), F.col("parts")).cast("int")
    rows = spread_join(stored, parts, "centre", "n").withColumn("block", block).select("centre", "block", "node")
    rows = rows.join(sets.select("node", "set"), "node").select("centre", "block", F.lit(1).alias("stored"), "node", "set")
    probes = parts.join(sets.select(F.col("node").alias("centre"), "set"), "centre")
    probes = probes.select("centre", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("block"), F.lit(0).alias("stored"), F.col("centre").alias("node"), "set")
    by = ["centre", "block"]

    def run(batches):
        for table in _groups(batches, by):
            probe, *stored = _as_sets(table.column("set"))
            nodes = table.column("node").to_pylist()
            yield _links([(nodes[0], nodes[1 + i]) for i in PrefixTree(stored).similar(probe, percent)])

    together = rows.unionByName(probes).repartition(*by).sortWithinPartitions(*by, "stored")
    return together.mapInArrow(run, "a long, b long")


def _dealt(rows: DataFrame, size: str) -> DataFrame:
    """Deals the rows of a bucket ``key`` to tasks, one for each pair of blocks: adds ``own`` block and ``lo, hi`` of the pair."""
    rows = stage(rows)
    parts = stage(rows.groupBy("key").agg(_parts(F.sum(size)).alias("parts"), F.count("*").alias("n")))
    rows = spread_join(rows, parts, "key", "n").withColumn("own", F.pmod(F.xxhash64("node", F.lit(7)), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return rows.withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other")}).drop("parts", "n", "other", size)


_PAIR_OF_BLOCKS = ["key", "lo", "hi"]


def _together(rows: DataFrame, *columns) -> DataFrame:
    return rows.select(*_PAIR_OF_BLOCKS, *columns).repartition(*_PAIR_OF_BLOCKS).sortWithinPartitions(*_PAIR_OF_BLOCKS)


def _likely(rows: DataFrame, near: DataFrame, percent: int) -> DataFrame:
    """The rows ``key, node, comp`` with a node of another component near them in their bucket."""
    rows = rows.withColumn("cls", F.col("key").bitwiseAND((1 << _CLASS_BITS) - 1)).join(near.drop("own").withColumnRenamed("size", "n_shingles"), ["node", "cls"])
    dealt = _dealt(rows.select("key", "node", "comp", "n_shingles", "vector", (F.length("vector") / 8).alias("size")), "size")

    def run(batches):
        for table in _groups(batches, _PAIR_OF_BLOCKS):
            data = np.frombuffer(b"".join(table.column("vector").to_pylist()), np.uint8).reshape(len(table), -1)
            comp, own, sizes = (table.column(c).to_numpy() for c in ("comp", "own", "n_shingles"))
            across = table.column("lo")[0] != table.column("hi")[0]
            hit = np.zeros(len(table), bool)
            for i in range(len(table) - 1):
                others = i + 1 + np.flatnonzero((comp[i + 1 :] != comp[i]) & (~across | (own[i + 1 :] != own[i])))
                others = others[(data[others] != data[i]).sum(axis=1) <= _most_apart(sizes[others], sizes[i], percent)]
                hit[others] = True
                hit[i] |= len(others) > 0
            yield from table.select(["key", "node", "comp"]).filter(pa.array(hit)).to_batches()

    return _together(dealt, "own", "node", "comp", "n_shingles", "vector").mapInArrow(run, "key long, node long, comp long").distinct()


def _bucket_links(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between components inside the buckets of ``key, node, comp``: a spanning set of them for each task."""
    dealt = _dealt(rows.join(sets.select("node", "size"), "node"), "size").join(sets.select("node", "set"), "node")

    def run(batches):
        for table in _groups(batches, _PAIR_OF_BLOCKS):
            node, comp, own = (table.column(c).to_pylist() for c in ("node", "comp", "own"))
            up: dict[int, int] = {}

            def root(x):
                while (y := up.get(x, x)) != x:
                    x = y
                return x

            sets_, links = _as_sets(table.column("set")), []
            stored, probes = ([i for i in range(len(node)) if own[i] == table.column(c)[0].as_py()] for c in ("lo", "hi"))
            tree = PrefixTree([sets_[i] for i in stored])
            for i in probes:
                for j in tree.similar(sets_[i], percent):
                    a, b = root(comp[i]), root(comp[stored[j]])
                    if a != b:
                        up[max(a, b)] = min(a, b)
                        links.append((node[i], node[stored[j]]))
            yield _links(links)

    return _together(dealt, "own", "node", "comp", "set").mapInArrow(run, "a long, b long")


def _mixed(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows ``key, node, comp`` of the buckets that hold several components; of buckets with the same nodes one."""
    rows = stage(members.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("comp")))
    nodes = [F.bit_xor(F.xxhash64(F.lit(i), "node")).alias(f"h{i}") for i in (1, 2)]
    keys = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("comp").alias("x"), F.max("comp").alias("y"), *nodes)
    keys = stage(keys.filter("x <> y").groupBy("n", "h1", "h2").agg(F.min("key").alias("key")).select("key", "n"))
    return spread_join(rows, keys, "key", "n").select("key", "node", "comp")


def _all_links(members: DataFrame, near: DataFrame, sets_of, percent: int) -> DataFrame:
    shared = members.filter("node <> centre").groupBy("node", "centre").agg(F.count("*").alias("c"))
    best = shared.groupBy("node").agg(F.max(F.struct("c", "centre")).alias("m")).select("node", F.col("m.centre").alias("centre"))
    links = stage(_star_links(best, near, sets_of, percent))

    roots = components(links)
    others = members.filter("node <> centre").select("node", "centre").distinct().join(roots.select("node", F.col("root").alias("x")), "node", "left")
    others = others.join(roots.select(F.col("node").alias("centre"), F.col("root").alias("y")), "centre", "left")
    others = others.filter(F.coalesce("x", "node") != F.coalesce("y", "centre")).select("node", "centre")
    links = stage(links.union(_star_links(others, near, sets_of, percent)))

    likely = stage(_likely(_mixed(members, components(links)), near, percent))
    return links if likely.isEmpty() else stage(links.union(_bucket_links(likely, sets_of(likely), percent)))


def jaccard_components(docs: DataFrame, percent: int = 90, width: int = 3) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for each row of ``docs`` (columns ``doc_id``, ``text``).

    Words are runs of anything but ASCII white space, A-Z lower-cased; a text of fewer than ``width`` words is one
    n-gram, an empty, blank or null text has none and is linked with nothing. Documents with ``100 * |A & B| >=
    percent * |A | B|`` are linked (``percent`` from 1 to 100); ``component_id`` is the smallest doc_id reachable.
    Documents are told apart by ``doc_id``: rows that repeat it are one document, linked by each of their texts. A null doc_id
    counts nowhere as the smallest; such a row takes its copies' component, or null. Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = stage(_signatures(docs, percent, width))
    classes = rows.filter("n_shingles > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("node"), F.count("*").alias("copies"))
    classes = stage(classes.filter("node is not null"))
    first = classes.select("d1", "d2", F.col("node").alias("doc_id"))
    nodes = rows.filter(F.length("keys") > 0).join(first, ["d1", "d2", "doc_id"], "left_semi").dropDuplicates(["d1", "d2", "doc_id"])
    nodes = stage(nodes.select(F.col("doc_id").alias("node"), "d1", "d2", "keys"))

    repeated = _exploded(nodes).groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("centre")).filter("n > 1")
    repeated = stage(repeated)
    members = stage(spread_join(_exploded(nodes, BitFilter.of(repeated, "key")), repeated, "key", "n").select("key", "node", "centre"))
    wanted = stage(nodes.select("node", "d1", "d2").join(members.select("node").distinct(), "node", "left_semi"))
    near, sets = _made_sets(docs, wanted, percent, width)
    links = _all_links(members, near, lambda nodes: _sets_of(sets, wanted, nodes), percent)

    node_of = classes.filter("copies > 1").select("d1", "d2", "node")
    rows = rows.select("doc_id", "n_shingles", "d1", "d2").join(node_of, ["d1", "d2"], "left")
    rows = stage(rows.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("node", "doc_id")).otherwise(F.col("doc_id")).alias("node")))
    same_id = rows.filter("n_shingles > 0").groupBy("doc_id").agg(F.min("node").alias("x"), F.max("node").alias("y")).filter("x <> y")
    roots = components(links.union(same_id.select("x", "y")).union(same_id.select("x", "doc_id")))
    out = rows.join(roots, "node", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("root", "node").alias("component_id"))
