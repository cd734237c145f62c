"""Connected components of a link table, without bringing links or groups into one task."""

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.staging import stage


LINKS_A_TASK = 200_000


def _contract(batches):
    """A task's links become a forest of stars with the same components."""
    up: dict[int, int] = {}

    def root(x):
        top = x
        while up[top] != top:
            top = up[top]
        while up[x] != top:
            up[x], x = top, up[x]
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            up.setdefault(a, a)
            up.setdefault(b, b)
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    stars = [(x, root(x)) for x in up if root(x) != x]
    yield pa.RecordBatch.from_arrays([pa.array([s[i] for s in stars], pa.int64()) for i in (0, 1)], names=["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """``links`` has two long columns; returns ``node, root`` for each linked node, ``root`` being the smallest node it reaches.

    Each round first contracts what a task of about LINKS_A_TASK links holds, which ends the work as soon as one
    task holds all of them. Else two rewrites follow: every node hands its larger neighbours, then
    its smaller ones, to its smallest neighbour. Minima are combined before they are shuffled, so a
    hub costs one row a task; the join back to a hub's links is left to adaptive execution. Each
    step is staged, rounds grow with the logarithm of a group's size, and only a few numbers a round
    reach the driver. Null nodes and self links are ignored.
    """
    a, b = links.columns
    pairs = links.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b"))
    pairs = stage(pairs.filter("a is not null and b is not null and a <> b"))
    seen = None
    while True:
        parts = max(1, -(-pairs.count() // LINKS_A_TASK))
        pairs = stage(pairs.coalesce(parts).mapInArrow(_contract, "a long, b long"))
        if parts > 1:
            pairs = stage(_rewritten(pairs))
            now = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.sum(F.col("b").cast("decimal(38,0)"))).first()
        if parts == 1 or now == seen:
            return pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = now


def _rewritten(pairs):
    both = pairs.select("a", "b").union(pairs.select("b", "a"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    larger = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    least = larger.groupBy("a").agg(F.min("b").alias("m"))
    smaller = larger.join(least, "a")
    return smaller.select("a", F.col("m").alias("b")).union(smaller.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct()
