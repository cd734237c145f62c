"""Near-duplicate documents: SuperMinHash signatures, banding, exact verification, components.

Steps, each a Spark job over staged tables:

1. One pass over the texts: shingle set, 128-bit digest of the set, signature.
2. Documents with equal sets become one node (the smallest doc_id of the class), so a group of
   exact copies costs one node however large it is.
3. Band keys are counted; keys of one node are dropped. Nodes left get their full sets, staged once.
4. Star round: in each bucket the node seen in most company is compared with all others by
   signature, each node's best match is verified on full sets, and components are formed.
5. Rest: in buckets that still hold several components, all pairs across components are
   compared by signature inside the bucket's tasks, at the first band they share, and the likely
   ones on full sets. Tasks return a spanning set of links, never pairs. A bucket larger than
   ``BLOCK`` nodes is dealt in blocks to several tasks.

Rows meet the facts of their bucket by ``spread_join``: those of hot buckets by broadcast, so that no task gets a whole one.

Nothing is capped: a pair is lost only if it shares no band (for a similarity of 0.85 with 32
bands of 4 slots: 5 in 10^11) or if its signatures agree in 0.18 less than the wanted similarity
(5.7 standard deviations).
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.staging import stage
from .common import spread_join
from .components import components
from .filters import BitFilter
from .kernels import Words, draw, shingle_set, slices
from .sketches import bands, superminhash

SLOTS, BANDS = 128, 32
MARGIN = 0.18
BLOCK = 1024


def _sets(column, width):
    words = Words(column, lower=True)
    return [shingle_set(words.hashes[words.at[i] : words.at[i + 1]], width) for i in range(len(column))]


def _digests(elements, owner, n):
    """Two sums over a set's elements: a 128-bit digest that needs no order."""
    out = []
    for k in (101, 102):
        total = np.zeros(n, np.uint64)
        np.add.at(total, owner, draw(elements, k))
        out.append(total.view(np.int64))
    return out


def _joined(sets):
    elements = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    return elements, np.repeat(np.arange(len(sets)), [len(s) for s in sets])


def _binary(rows) -> pa.Array:
    return pa.array([r.tobytes() for r in rows], pa.binary())


def signatures(docs: DataFrame, width: int = 5) -> DataFrame:
    """``doc_id, n_shingles, d1, d2, keys, sketch`` of each row: set size, set digest, band keys, one byte a slot."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                sets = _sets(part.column("text"), width)
                elements, owner = _joined(sets)
                sig = superminhash(elements, owner, len(sets), SLOTS)
                d1, d2 = _digests(elements, owner, len(sets))
                size = np.array([len(s) for s in sets], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"), pa.array(size), pa.array(d1), pa.array(d2),
                        _binary(bands(sig, BANDS)), _binary((sig & np.uint64(255)).astype(np.uint8)),
                    ],
                    names=["doc_id", "n_shingles", "d1", "d2", "keys", "sketch"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_shingles long, d1 long, d2 long, keys binary, sketch binary")


def _explode_keys(nodes: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            keys = [np.frombuffer(k, np.int64) for k in batch.column("keys").to_pylist()]
            ids = np.repeat(batch.column("node").to_numpy(), BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64)), pa.array(ids)], names=["key", "node"])

    return nodes.select("node", "keys").mapInArrow(run, "key long, node long")


def _wanted_sets(docs, wanted: DataFrame, width) -> DataFrame:
    """``node, set`` of the rows whose doc_id is a wanted node.

    A bit filter of bounded size keeps most other texts from being split into words; the join decides.
    """
    sieve = BitFilter.of(wanted, "node")

    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id")
            hit = pa.array(sieve.holds(ids.fill_null(0).to_numpy()) & ids.is_valid().to_numpy(zero_copy_only=False))
            batch = batch.filter(hit)
            for part in slices(batch, "text"):
                sets = _sets(part.column("text"), width)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), _binary(sets)], names=["node", "set"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = rows.mapInArrow(run, "node long, set binary").filter(F.length("set") > 0)
    return stage(found.join(wanted, "node", "left_semi"))


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            x, y = (batch.column(c).to_pylist() for c in ("sa", "sb"))
            good = [_similar(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64), percent) for p, q in zip(x, y)]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    full = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("sa")), "a")
    full = full.join(sets.select(F.col("node").alias("b"), F.col("set").alias("sb")), "b")
    return full.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _star_links(members, nodes, sets, percent):
    """Links between nodes and the best of their buckets' centres."""
    company = members.groupBy("node").agg(F.sum("n").alias("company"))
    centre = members.join(company, "node").groupBy("key").agg(F.max(F.struct("company", "node")).alias("c"), F.first("n").alias("n"))
    pairs = spread_join(members.drop("n"), stage(centre), "key", "n").select(F.col("node").alias("a"), F.col("c.node").alias("b")).filter("a <> b")
    sketch = nodes.select("node", "sketch")
    pairs = pairs.join(sketch.withColumnRenamed("node", "a").withColumnRenamed("sketch", "ka"), "a")
    pairs = pairs.join(sketch.withColumnRenamed("node", "b").withColumnRenamed("sketch", "kb"), "b")
    least = _least_agreement(percent)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, SLOTS) for c in ("ka", "kb"))
            same = (x == y).sum(axis=1)
            part = batch.select(["a", "b"]).append_column("same", pa.array(same.astype(np.int64)))
            yield part.filter(pa.array(same >= least))

    likely = pairs.select("a", "b", "ka", "kb").mapInArrow(run, "a long, b long, same long")
    best = likely.groupBy("a").agg(F.max(F.struct("same", "b")).alias("m")).select("a", F.col("m.b").alias("b"))
    return _verified(best, sets, percent)


def _least_agreement(percent):
    return int(np.ceil((percent / 100 - MARGIN) * SLOTS))


def _whole_groups(batches):
    """Tables of rows sorted by ``key, lo, hi``, cut between groups: a group is never in two of them."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table])
        new = np.zeros(len(table), bool)
        for c in ("key", "lo", "hi"):
            values = table.column(c).to_numpy()
            new[1:] |= values[1:] != values[:-1]
        cut = int(np.flatnonzero(new)[-1]) if new.any() else 0
        if cut:
            yield table.slice(0, cut)
        held = table.slice(cut)
    if held is not None:
        yield held


def _likely(table, least: int):
    """Yields row numbers ``i, j`` of a table of whole groups that have to be compared: rows of a group in different
    components that agree in ``least`` slots and share no earlier band; in a group of two blocks, one row of each."""
    key, lo, hi, block, comp = (table.column(c).to_numpy() for c in ("key", "lo", "hi", "block", "comp"))
    keys = np.frombuffer(b"".join(table.column("keys").to_pylist()), np.int64).reshape(-1, BANDS)
    sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(-1, SLOTS)

    def fit(i, j):
        some = comp[i] != comp[j]
        some &= (lo[i] == hi[i]) | (block[i] != block[j])
        i, j = i[some], j[some]
        some = (sketch[i] == sketch[j]).sum(axis=1) >= least
        i, j = i[some], j[some]
        first = (keys[i] == keys[j]).argmax(axis=1)
        some = keys[i, first] == key[i]
        return i[some], j[some]

    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, len(key)))
    twos = start[size == 2]  # by far the most
    for at in range(0, len(twos), 8192):
        yield fit(twos[at : at + 8192], twos[at : at + 8192] + 1)
    for begin, n in zip(start[size > 2].tolist(), size[size > 2].tolist()):
        for i in range(begin, begin + n - 1):
            others = np.arange(i + 1, begin + n)
            yield fit(np.full(len(others), i), others)


def _blocks(rows: DataFrame) -> DataFrame:
    """Deals the rows of a bucket of ``n`` rows to tasks: one for each pair of blocks of about BLOCK rows."""
    rows = rows.withColumn("parts", F.ceil(F.col("n") / BLOCK).cast("int"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node", F.lit(7)), F.col("parts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    rows = rows.withColumn("other", other)
    return rows.withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other")).drop("n", "parts", "other")


def _rest_links(members, nodes, sets, comp, percent):
    """All remaining links between components that share a bucket."""
    least = _least_agreement(percent)
    rows = members.join(comp.select("node", "root"), "node", "left").select("key", "node", F.coalesce("root", "node").alias("comp"))
    mixed = rows.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("n")).filter("x <> y")
    rows = stage(spread_join(rows, stage(mixed.select("key", "n")), "key", "n"))
    dealt = _blocks(rows.join(nodes.select("node", "keys", "sketch"), "node"))

    def active(batches):
        for table in _whole_groups(batches):
            hit = np.zeros(len(table), bool)
            for i, j in _likely(table, least):
                hit[i] = True
                hit[j] = True
            yield from table.filter(pa.array(hit)).to_batches()

    def exact(batches):
        up: dict[int, int] = {}

        def root(x):
            while (y := up.get(x, x)) != x:
                x = y
            return x

        for table in _whole_groups(batches):
            node, comp, found = table.column("node").to_numpy(), table.column("comp").to_numpy(), table.column("set")
            links = []
            for i, j in _likely(table, least):
                for a, b in zip(i.tolist(), j.tolist()):
                    p, q = root(int(comp[a])), root(int(comp[b]))
                    if p != q and _similar(*(np.frombuffer(found[k].as_py(), np.uint64) for k in (a, b)), percent):
                        up[max(p, q)] = min(p, q)
                        links.append((int(node[a]), int(node[b])))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])

    def together(df):
        return df.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")

    order = "key long, lo int, hi int, block int, node long, comp long, keys binary, sketch binary"
    names = [c.split()[0] for c in order.split(", ")]
    some = together(dealt.select(*names)).mapInArrow(active, order).join(sets, "node")
    return together(some.select(*names, "set")).mapInArrow(exact, "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = 85, width: int = 5) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for each row of ``docs`` (columns ``doc_id``, ``text``).

    Words are runs of anything but ASCII white space, A-Z lower-cased; a text of fewer than ``width``
    words is one shingle, an empty, blank or null text has none and is linked with nothing.
    Documents with ``100 * |A & B| >= percent * |A | B|`` are linked; ``component_id`` is the smallest
    doc_id reachable. Documents are told apart by ``doc_id``: rows that repeat it are one
    document, linked by each of their texts. A null doc_id counts nowhere as the smallest; such a
    row takes its copies' component, or null, and is kept only if that is null. Other columns are ignored.
    """
    rows = stage(signatures(docs, width))
    classes = rows.filter("n_shingles > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("node"), F.count("*").alias("copies"))
    classes = stage(classes.filter("node is not null"))
    node_of = classes.filter("copies > 1").select("d1", "d2", "node")
    first = classes.select("d1", "d2", F.col("node").alias("doc_id"))
    nodes = rows.join(first, ["d1", "d2", "doc_id"], "left_semi").dropDuplicates(["d1", "d2", "doc_id"])
    nodes = stage(nodes.select(F.col("doc_id").alias("node"), "keys", "sketch"))

    keyed = _explode_keys(nodes)
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    members = stage(spread_join(keyed, stage(sizes), "key", "n"))
    wanted = stage(members.select("node").distinct())
    nodes = stage(nodes.join(wanted, "node", "left_semi"))
    sets = _wanted_sets(docs, wanted, width)

    row_node = rows.select("doc_id", "n_shingles", "d1", "d2").join(node_of, ["d1", "d2"], "left")
    row_node = row_node.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("node", "doc_id")).otherwise(F.col("doc_id")).alias("node"))
    row_node = stage(row_node)
    repeated = row_node.filter("n_shingles > 0").groupBy("doc_id").agg(F.min("node").alias("x"), F.max("node").alias("y"))
    repeated = repeated.filter("x <> y")
    same_id = repeated.select("x", "y").union(repeated.select("x", "doc_id"))

    star = stage(_star_links(members, nodes, sets, percent))
    rest = stage(_rest_links(members, nodes, sets, components(star), percent))
    roots = components(star.union(rest).union(same_id))
    out = row_node.join(roots, "node", "left").withColumn("component_id", F.coalesce("root", "node"))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
