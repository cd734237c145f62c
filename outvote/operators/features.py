"""Scaling, weighted mixing, repeatable noise, dictionary codes, graph signatures, histograms."""

from math import pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..defaults import SEED
from ..functions.expr import digest128, total
from ..plans.levels import count_passed
from ..plans.ranks import distributed_rank, draw_key
from ..plans.staging import lookup, stage

# Two-letter symbols that count as one, and the code width.
SYMBOL_REPLACEMENTS = {"Si": "X", "Cl": "Y", "Br": "Z"}
SYMBOL_WIDTH = 256


def fit_scaler(df: DataFrame, columns) -> DataFrame:
    """One row per column: mean and population deviation, 1 where the column is constant."""
    stats = df.agg(
        F.array(
            *[
                F.struct(
                    F.lit(i).alias("position"),
                    F.lit(c).alias("name"),
                    F.avg(c).alias("mean"),
                    F.coalesce(F.nullif(F.stddev_pop(c), F.lit(0.0)), F.lit(1.0)).alias("scale"),
                )
                for i, c in enumerate(columns)
            ]
        ).alias("p")
    )
    return stats.select(F.inline("p"))


def _params(params: DataFrame) -> Column:
    """Parameters as one array, looked up once; as many entries as there are columns."""
    return params.agg(F.array_sort(F.collect_list(F.struct("position", "mean", "scale"))).alias("p")).scalar()


def apply_scaler(df: DataFrame, columns, params: DataFrame) -> DataFrame:
    rows = df.withColumn("_p", _params(params))
    scaled = {c: (F.col(c) - F.get("_p", i)["mean"]) / F.get("_p", i)["scale"] for i, c in enumerate(columns)}
    return rows.withColumns(scaled).drop("_p")


def weighted_score(columns, weights) -> Column:
    """Weighted mean of columns with fixed weights."""
    return total([F.col(c) * F.lit(float(w)) for c, w in zip(columns, weights, strict=True)]) / F.lit(float(sum(weights)))


def uniform_pair(id_col, seed):
    """Two repeatable uniforms of an entry: the first in (0, 1], the second in [0, 1)."""
    key = draw_key(id_col, seed)

    def part(start):
        return F.conv(F.substring(key, start, 8), 16, 10).cast("long")

    return (part(1) + 1) / F.lit(4294967296.0), part(9) / F.lit(4294967296.0)


def gaussian_noise(id_col, sigma=0.015, seed=SEED) -> Column:
    """Normal noise from the entry id, the same under any partitioning."""
    first, second = uniform_pair(id_col, seed)
    return F.sqrt(F.lit(-2.0) * F.ln(first)) * F.cos(F.lit(2 * pi) * second) * F.lit(sigma)


def add_noise(df: DataFrame, column: str, id_col: str, sigma=0.015, seed=SEED) -> DataFrame:
    return df.withColumn(column, F.col(column) + gaussian_noise(id_col, sigma, seed))


def _replaced(text, replacements):
    out = F.col(text)
    for old, new in replacements.items():
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def split_symbols(text, replacements=SYMBOL_REPLACEMENTS) -> Column:
    """One array entry per character, after two-letter symbols became one."""
    return F.array_remove(F.split(_replaced(text, replacements), ""), "")


def symbol_vocabulary(df: DataFrame, text: str, order: str, replacements=SYMBOL_REPLACEMENTS) -> DataFrame:
    """Codes 1, 2, ... of characters by first appearance in the row order.

    A row's distinct characters are counted, not all of them, and into plain numbers, which needs no sort: first the
    row that each character is first seen in (a missing order comes first), then the place in those rows alone.
    """
    rows = df.select(F.col(order).alias("_order"), _replaced(text, replacements).alias("_text"))
    symbols = F.array_distinct(F.array_remove(F.split("_text", ""), ""))
    rows_of = rows.select("_order", F.explode(symbols).alias("symbol")).groupBy("symbol")
    first = rows_of.agg(F.min("_order").alias("_least"), F.max(F.col("_order").isNull()).alias("_none"))
    first = stage(first.select("symbol", F.when(~F.col("_none"), F.col("_least")).alias("_row")))
    # At most as many rows as Unicode has characters.
    places = rows.join(F.broadcast(first), F.col("_order").eqNullSafe(F.col("_row"))).select("symbol", "_order", F.position("symbol", "_text").alias("_pos"))
    seen = places.filter("_pos > 0").groupBy("symbol").agg(F.min(F.struct("_order", "_pos")).alias("_first"))
    return distributed_rank(seen, ["_first"], "code").select("symbol", F.col("code").cast("int").alias("code"))


def encode_symbols(df: DataFrame, text: str, order: str, width=SYMBOL_WIDTH, replacements=SYMBOL_REPLACEMENTS, out="codes") -> DataFrame:
    """Adds zero-padded character codes; a text longer than ``width`` is an error.

    Codes sit in an array indexed by code point, at most as long as Unicode has characters.
    """
    vocabulary = stage(symbol_vocabulary(df, text, order, replacements)).select(F.ascii("symbol").alias("_cp"), "code")
    points = vocabulary.agg(F.max("_cp").alias("_top")).select(F.explode(F.sequence(F.lit(0), "_top")).alias("_cp"))
    table = points.join(F.broadcast(vocabulary), "_cp", "left").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_cp", F.coalesce("code", F.lit(0)).alias("code")))), lambda e: e["code"]).alias("t")
    )
    rows = df.withColumns({"_symbols": split_symbols(text, replacements), "_table": table.scalar()})
    codes = F.transform("_symbols", lambda s: F.get("_table", F.ascii(s)))
    length = F.size("_symbols")
    padded = F.when(
        length > width, F.raise_error(F.concat(F.lit("text longer than code width: "), length.cast("string"))).cast("array<int>")
    ).otherwise(F.concat(codes, F.array_repeat(F.lit(0), F.lit(width) - length)))
    return rows.withColumn(out, padded).drop("_symbols", "_table")


def node_signatures(nodes: DataFrame, edges: DataFrame, own=("label", "degree", "hydrogens", "charge"), graph="graph_id", node="node_id") -> DataFrame:
    """Adds ``signature``: own labels joined by ``-``, then ``_`` and the sorted neighbour labels.

    Edges count in both directions. Equal neighbour labels are counted before they are
    gathered, so a node holds one item per distinct label however many neighbours it has.
    """
    around = (
        _neighbours(nodes, edges, own[0], graph, node)
        .groupBy(graph, node, "_label")
        .agg(F.count("*").alias("_n"))
        .groupBy(graph, node)
        .agg(F.array_sort(F.collect_list(F.struct("_label", "_n"))).alias("_around"))
    )
    text = F.array_join(F.transform("_around", lambda e: F.repeat(e["_label"], e["_n"].cast("int"))), "")
    return (
        nodes.join(around, [graph, node], "left")
        .withColumn("signature", F.concat(_own_labels(own), F.lit("_"), F.coalesce(text, F.lit(""))))
        .drop("_around")
    )


def _neighbours(nodes, edges, label, graph, node):
    """One row per node and neighbour, with the neighbour's label.

    Nodes are shuffled, never broadcast: they grow with the graph, and Spark's guess of their size may miss rows that a generator adds.
    """
    ends = edges.select(graph, F.inline(F.array(F.struct(F.col("src").alias(node), F.col("dst").alias("_other")), F.struct(F.col("dst").alias(node), F.col("src").alias("_other")))))
    others = nodes.select(graph, F.col(node).alias("_other"), F.col(label).cast("string").alias("_label"))
    return ends.join(others.hint("merge"), [graph, "_other"])


def _own_labels(own):
    return F.concat_ws("-", *[F.col(c).cast("string") for c in own])


def signature_keys(nodes: DataFrame, edges: DataFrame, own=("label", "degree", "hydrogens", "charge"), graph="graph_id", node="node_id") -> DataFrame:
    """Adds ``signature_key``, two numbers that stand for the signature and are as short for a hub as for a leaf.

    The neighbour labels enter as a multiset: each label's hash is cut into four lanes of 32 bits, which are summed over the
    neighbours, so that no order and no list is needed and sums combine before the shuffle. Own labels, number of
    neighbours and lanes make 128 bits. Neighbours without a label do not count, as in the text. Keys tell
    neighbours ``C``, ``O`` from one neighbour ``CO``, whose texts are equal; otherwise equal keys are equal texts.
    """
    words = [F.xxhash64(F.lit(i), F.col("_label")) for i in (1, 2)]
    lanes = [lane for w in words for lane in (w.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(w, 32))]
    names = [f"_lane{i}" for i in range(len(lanes))]
    sums = (
        _neighbours(nodes, edges, own[0], graph, node)
        .dropna(subset=["_label"])
        .groupBy(graph, node)
        .agg(F.count("*").alias("_n"), *[F.sum(lane).alias(n) for lane, n in zip(lanes, names)])
    )
    rows = nodes.join(sums, [graph, node], "left").withColumn("_mine", _own_labels(own))
    high, low = digest128(["_mine", "_n", *names])
    return rows.withColumn("signature_key", F.struct(high.alias("high"), low.alias("low"))).drop("_mine", "_n", *names)


def signature_codes(signed: DataFrame, order=("graph_id", "node_id"), key="signature") -> DataFrame:
    """Adds ``code`` 0, 1, ... of signatures by first appearance, and the dictionary size + 1.

    ``key`` is ``signature`` or, for graphs with hubs, ``signature_key``. ``signed`` is read twice, so it is staged first.
    """
    signed = stage(signed)
    first = signed.groupBy(key).agg(F.min(F.struct(*order)).alias("_first"))
    codes = stage(distributed_rank(first, ["_first"], "_rank").select(key, (F.col("_rank") - 1).alias("code")))
    size = codes.agg((F.count("*") + 1).alias("n")).scalar()
    return lookup(signed, codes, [key], "inner").withColumn("n_signatures", size)


def signature_dictionary(coded: DataFrame, nodes: DataFrame, edges: DataFrame, own=("label", "degree", "hydrogens", "charge"), graph="graph_id", node="node_id") -> DataFrame:
    """``code, signature`` of coded nodes: the text is written for one node of each code only.

    There may be as many codes as nodes, so nothing here is broadcast.
    """
    first = coded.groupBy("code").agg(F.min(F.struct(graph, node)).alias("_first"))
    first = stage(first.select("code", F.col("_first")[graph].alias(graph), F.col("_first")[node].alias(node)))
    ends = F.array(F.struct(F.col("src").alias(node), F.col("dst").alias("_other")), F.struct(F.col("dst").alias(node), F.col("src").alias("_other")))
    # Edges of those nodes only, turned to start at them; a turned edge must not be turned again.
    around = edges.select(graph, F.inline(ends)).join(first.hint("merge"), [graph, node])
    labels = nodes.select(graph, F.col(node).alias("_other"), F.col(own[0]).cast("string").alias("_label"))
    counts = around.join(labels.hint("merge"), [graph, "_other"]).groupBy("code", "_label").agg(F.count("*").alias("_n"))
    runs = counts.groupBy("code").agg(F.array_sort(F.collect_list(F.struct("_label", "_n"))).alias("_around"))
    text = F.array_join(F.transform("_around", lambda e: F.repeat(e["_label"], e["_n"].cast("int"))), "")
    mine = nodes.join(first.hint("merge"), [graph, node]).select("code", _own_labels(own).alias("_mine"))
    return mine.join(runs, "code", "left").select("code", F.concat("_mine", F.lit("_"), F.coalesce(text, F.lit(""))).alias("signature"))


def symmetrise_edges(edges: DataFrame, graph="graph_id", slot="bond_no") -> DataFrame:
    """Each of a graph's B edges also reversed; the copy of edge b takes slot 2B - 1 - b."""
    sizes = stage(edges.groupBy(graph).agg(F.count("*").alias("_b")))
    both = F.array(
        F.struct(F.col(slot).alias("slot"), F.col("src").alias("src"), F.col("dst").alias("dst")),
        F.struct((2 * F.col("_b") - 1 - F.col(slot)).alias("slot"), F.col("dst").alias("src"), F.col("src").alias("dst")),
    )
    return lookup(edges, sizes, [graph]).select(graph, F.inline(both))


def assemble(df: DataFrame, columns, out="features") -> DataFrame:
    """Numbers and arrays of numbers side by side in one array."""
    kinds = dict(df.dtypes)
    blocks = [F.col(c).cast("array<double>") if kinds[c].startswith("array") else F.array(F.col(c).cast("double")) for c in columns]
    return df.withColumn(out, F.concat(*blocks))


def histogram(df: DataFrame, column: str, edges, keys=(), normalised=False) -> DataFrame:
    """Counts between edges, the last bin closed on the right; empty bins are kept.

    ``normalised`` divides by all rows of the dataset, including those outside the edges.
    """
    keys, edges = list(keys), [float(e) for e in edges]
    n_bins = len(edges) - 1
    rows = df.select(*keys, F.col(column).alias("_x"), F.array(*map(F.lit, edges)).alias("_edges"))
    rows = count_passed(rows, {"_bin": ("_x", "_edges")}, len(edges))
    at = F.when(F.col("_x") == edges[-1], F.lit(n_bins - 1)).otherwise(F.col("_bin") - 1)
    at = F.when(at.between(0, n_bins - 1), at)
    counts = rows.groupBy(*keys, at.alias("_bin")).agg(F.count("*").alias("_n"))
    per_set = counts.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.when(F.col("_bin").isNotNull(), F.struct("_bin", "_n")))).alias("_found"),
        F.sum("_n").alias("_all"),
    )
    bins = F.array(*[F.struct(F.lit(i).alias("bin"), F.lit(edges[i]).alias("left_edge"), F.lit(edges[i + 1]).alias("right_edge")) for i in range(n_bins)])
    found = F.coalesce(F.try_element_at("_found", F.col("bin")), F.lit(0))
    out = per_set.select(*keys, "_found", "_all", F.inline(bins)).withColumn("n", found)
    share = [(F.col("n") / F.col("_all")).alias("share")] if normalised else []
    return out.select(*keys, "bin", "left_edge", "right_edge", "n", *share)
