"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Native: DataFrame functions only. Each source is cut into shards of about ``SHARD_DOCS`` documents by
a hash, so a hot source is many cells of bounded size. A shard's documents, in seeded order, are
one stream of words, cut into blocks of equal length: BLOCK_WORDS words, less in shards of under
``LEAST_BLOCKS * BLOCK_WORDS`` words. All shards compete for the blocks of the mix:
the next block always goes to the shard with the highest quotient ``votes / (2 k + 1)``, k being the blocks
it has and votes its target in blocks of its own. Only the blocks near the last quotient are ranked; how many are certain follows
from a bound. A shard's quota is then dealt as whole passes plus a seeded choice of blocks.
"""

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.ranks import distributed_rank
from ..plans.staging import stage
from .common import fresh, without, word_count

BLOCK_WORDS = 100
LEAST_BLOCKS = 64  # a shard has so many blocks, or one a word if it has fewer words
SHARD_DOCS = 10_000
SEED = 7
_PRIME = 2_147_483_647  # spreads the chosen blocks; no multiple of it is a number of blocks


def _number(text: Column) -> Column:
    """The first 60 bits of a text's md5."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights=(5, 2, 1), share=(3, 2)) -> DataFrame:
    """``source, source_size, target`` from ``source, size`` rows.

    Sources by code point, null last, get the weights in turn and share ``share`` times all words; a
    target stops at twice its source's size and the excess is shared anew by weight until none is above.
    ``share`` may be at most 2.
    """
    sources = stage(sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs")))
    ranked = distributed_rank(sources.withColumn("none", F.col("source").isNull()), ["none", "source"], "place").drop("none")
    cycle = F.array(*[F.lit(w) for w in weights])
    ranked = stage(ranked.withColumn("weight", F.element_at(cycle, (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int"))))
    up, down = share
    total = int(sources.agg(F.sum(F.col("source_size").cast("decimal(38,0)"))).first()[0] or 0)
    # Level at which a source of weight 1 is filled: (up * total - down * capped) / (down * open).
    above, below, n_full = None, None, -1
    while True:
        full = F.lit(False) if above is None else _wide("weight") * F.lit(Decimal(above)) > _wide("source_size") * F.lit(Decimal(2 * below))
        row = ranked.select(full.alias("full"), "source_size", "weight").agg(
            F.count_if("full").alias("n"),
            F.sum(F.when(F.col("full"), 2 * _wide("source_size")).otherwise(0)).alias("capped"),
            F.sum(F.when(F.col("full"), 0).otherwise(_wide("weight"))).alias("open"),
        ).first()
        if row["n"] == n_full or not row["open"]:
            break
        n_full = row["n"]
        above, below = up * total - down * int(row["capped"]), down * int(row["open"])
    if above is None:
        level = F.lit(0.0)
    else:
        level = (F.col("weight") * F.lit(Decimal(above))).cast("double") / F.lit(float(below))
    most = (2 * F.col("source_size")).cast("double")
    return ranked.select("source", "source_size", "docs", F.least(level, most).alias("target"))


def _wide(column):
    return F.col(column).cast("decimal(19,0)")


def quotas(cells: DataFrame, n_blocks: int) -> DataFrame:
    """``source, shard, quota``: blocks won by the cells ``source, shard, votes`` (double), ``n_blocks`` in all.

    Equal quotients go by source (null last), then shard, then number of blocks. With c cells and V votes, a quotient above
    ``V / (2 (n - c))`` is among the n highest, and at least n are above ``V / (2 (n + c))``;
    so at most about five candidates a cell are ranked.
    """
    row = cells.agg(F.count("*").alias("c"), F.sum("votes").alias("v")).first()
    c, votes = row["c"], row["v"] or 0.0
    if not votes or not n_blocks:
        return cells.select("source", "shard", F.lit(0).cast("long").alias("quota"))
    won = lambda t: F.floor((F.col("votes") / F.lit(t) + 1) / 2)
    sure = F.greatest(won(votes / (2 * (n_blocks - c))) - 1, F.lit(0)) if n_blocks > c else F.lit(0)
    cells = stage(cells.withColumn("sure", sure.cast("long")).withColumn("end", (won(votes / (2 * (n_blocks + c))) + 1).cast("long")))
    left = n_blocks - int(cells.agg(F.sum("sure")).first()[0])
    near = cells.filter("end > sure").withColumn("k", F.explode(F.sequence("sure", F.col("end") - 1)))
    near = near.select("source", "shard", "k", (-F.col("votes") / (2 * F.col("k") + 1)).alias("quotient"), F.col("source").isNull().alias("none"))
    ranked = distributed_rank(near, ["quotient", "none", "source", "shard", "k"], "place")
    extra = ranked.filter(F.col("place") <= left).groupBy("source", "shard").agg(F.count("*").alias("extra"))
    extra = extra.withColumnsRenamed({"source": "s", "shard": "p"})
    joined = cells.join(extra, F.col("source").eqNullSafe(F.col("s")) & (F.col("shard") == F.col("p")), "left")
    return joined.select("source", "shard", (F.col("sure") + F.coalesce("extra", F.lit(0))).cast("long").alias("quota"))


def mix(docs: DataFrame, weights=(5, 2, 1), share=(3, 2), keep: bool = False) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` of each row of ``docs`` (columns ``doc_id``, ``text``, ``source``).

    ``size`` counts runs of anything but ASCII white space (null text: 0); ``target`` is that of the
    row's source; ``taken`` is how many of its words the mix takes, repeats counted, at most twice its
    size. A null source is a source; the place of a row in its shard depends on its doc_id (null as
    empty) and size only, so reruns agree. Repeated rows are separate rows; no words at all take
    nothing. With ``keep`` the result has all columns of ``docs`` but such as clash, then the five.
    """
    docs = docs.withColumn("source", F.col("source").cast("string"))
    if keep:
        row, = fresh(docs, "mix_row")
        docs = stage(docs.withColumn(row, F.monotonically_increasing_id()))
    own = [F.col(row).alias("row")] if keep else []
    rows = stage(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", word_count(F.col("text")).alias("size"), *own))
    wanted = stage(targets(rows, weights, share))
    parts = wanted.withColumn("parts", F.ceil(F.col("docs") / SHARD_DOCS).cast("long"))
    parts = parts.withColumnRenamed("source", "s")
    placed = rows.join(parts, F.col("source").eqNullSafe(F.col("s")), "left").drop("s", "docs")
    placed = placed.withColumn("draw", _number(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(str(SEED)))))
    placed = stage(placed.withColumn("shard", F.pmod("draw", "parts")).drop("parts"))

    cells = placed.groupBy("source", "shard").agg(
        F.sum("size").alias("cell_size"), F.any_value("target").alias("target"), F.any_value("source_size").alias("source_size")
    )
    length = F.greatest(F.lit(1), F.least(F.lit(BLOCK_WORDS), F.ceil(F.col("cell_size") / LEAST_BLOCKS))).cast("long")
    cells = cells.withColumn("block", length).withColumn("blocks", F.ceil(F.col("cell_size") / F.col("block")).cast("long"))
    # the last block of a shard is shorter, so votes are shares of its blocks, not words by the length of a block
    votes = F.when(F.col("source_size") > 0, F.col("target") * F.col("blocks") / F.col("source_size")).otherwise(0.0)
    cells = stage(cells.select("source", "shard", "block", "blocks", votes.alias("votes")))
    # thousandths, as whole numbers have the same sum in any order
    thousandths = cells.agg(F.sum(F.floor(F.col("votes") * 1000).cast("decimal(38,0)"))).first()[0]
    n_blocks = (int(thousandths or 0) + 500) // 1000
    won = quotas(cells.select("source", "shard", "votes"), n_blocks).withColumnsRenamed({"source": "s", "shard": "p"})
    cells = cells.join(won, F.col("source").eqNullSafe(F.col("s")) & (F.col("shard") == F.col("p"))).drop("s", "p", "votes")
    cells = cells.select(
        F.col("source").alias("s"), F.col("shard").alias("p"), "block", "blocks",
        F.least("quota", 2 * F.col("blocks")).alias("quota"),
        _number(F.concat_ws("|", F.coalesce("source", F.lit("")), F.col("shard").cast("string"), F.lit(str(SEED)))).alias("turn"),
    )

    over = Window.partitionBy("source", "shard").orderBy("draw", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.withColumn("end", F.sum("size").over(over))
    placed = placed.join(cells, F.col("source").eqNullSafe(F.col("s")) & (F.col("shard") == F.col("p"))).drop("s", "p")
    taken = F.expr(f"""case when size = 0 then 0L else quota div blocks * size + aggregate(
        sequence((end - size) div block, (end - 1) div block), 0L,
        (sum, i) -> sum + case when (i * {_PRIME} + turn % blocks) % blocks < quota % blocks
            then least((i + 1) * block, end) - greatest(i * block, end - size) else 0L end) end""")
    placed = placed.withColumn("taken", taken)
    names = ["size", "source_size", "target", "taken"]
    if not keep:
        return placed.select("doc_id", *names)
    other = without(docs, *names)
    return other.join(placed.select(F.col("row").alias(row), *names), row).drop(row)
