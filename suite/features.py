"""Scaling, mixing, noise, dictionary codes, graph signatures, histograms."""

from math import pi

from pyspark.sql import functions as F

from outvote.defaults import SEED
from outvote.functions.expr import clean_round
from outvote.operators import features as X

from .fixtures import GRAPH_SQL, descriptors, graph, table
from .sqltext import num, r6, values_table

COLUMNS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
# The first four numbers of numpy's default generator with seed 42.
WEIGHTS = (0.7739560485559633, 0.4388784397520523, 0.8585979199113825, 0.6973680290593639)
EDGES = tuple(float(x) for x in range(0, 500, 20))


def scaler(spark, sf):
    return X.fit_scaler(descriptors(spark, sf), COLUMNS).withColumns({c: clean_round(c) for c in ("mean", "scale")})


def scaled(spark, sf):
    rows = descriptors(spark, sf)
    out = X.apply_scaler(rows, COLUMNS, X.fit_scaler(rows, COLUMNS))
    return out.select(*[clean_round(c).alias(c) for c in COLUMNS])


def weighted_score(spark, sf):
    rows = descriptors(spark, sf)
    out = X.apply_scaler(rows, COLUMNS, X.fit_scaler(rows, COLUMNS))
    return out.select(clean_round(X.weighted_score(COLUMNS, WEIGHTS)).alias("score"))


def noisy_values(spark, sf):
    rows = table(spark, sf, "events").select("event_id", "value")
    return X.add_noise(rows, "value", "event_id").withColumn("value", clean_round("value"))


def symbol_codes(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey", F.concat("p_name", F.lit(" Cl"), "p_size", F.lit("BrSi")).alias("text"))
    out = X.encode_symbols(rows, "text", "p_partkey", width=64)
    return out.select("p_partkey", F.array_join(F.col("codes").cast("array<string>"), ",").alias("codes"))


def symbol_vocabulary(spark, sf):
    return X.symbol_vocabulary(table(spark, sf, "documents"), "text", "doc_id", {})


def node_signatures(spark, sf):
    return X.node_signatures(*graph(spark, sf)).select("graph_id", "node_id", "signature")


def signature_codes(spark, sf):
    out = X.signature_codes(X.signature_keys(*graph(spark, sf)), key="signature_key")
    return out.select("graph_id", "node_id", "code", "n_signatures")


def signature_dictionary(spark, sf):
    nodes, edges = graph(spark, sf)
    return X.signature_dictionary(X.signature_codes(X.signature_keys(nodes, edges), key="signature_key"), nodes, edges)


def _bonds(spark, sf):
    """One graph per order, bonds numbered within it."""
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_partkey", "l_suppkey").agg(F.count("*").alias("n"))
    from pyspark.sql.window import Window

    slot = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_partkey", "l_suppkey")) - 1
    return lines.select(F.col("l_orderkey").alias("graph_id"), slot.alias("bond_no"), F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"))


def symmetric_edges(spark, sf):
    return X.symmetrise_edges(_bonds(spark, sf)).withColumn("slot", F.col("slot").cast("bigint"))


def assembled(spark, sf):
    rows = table(spark, sf, "lineitem").withColumn("pair", F.array("l_discount", "l_tax"))
    out = X.assemble(rows, ("l_quantity", "pair", "l_linenumber"))
    return out.select("l_orderkey", F.array_join(F.transform("features", lambda v: F.round(v * 100).cast("int").cast("string")), ",").alias("features"))


def _histogram(keys, normalised):
    def run(spark, sf):
        out = X.histogram(table(spark, sf, "events"), "value", EDGES, keys, normalised)
        return out.withColumn("share", clean_round("share")) if normalised else out

    return run


QUERIES = {
    "scaler": scaler,
    "scaled": scaled,
    "weighted_score": weighted_score,
    "noisy_values": noisy_values,
    "symbol_codes": symbol_codes,
    "symbol_vocabulary": symbol_vocabulary,
    "node_signatures": node_signatures,
    "signature_codes": signature_codes,
    "signature_dictionary": signature_dictionary,
    "symmetric_edges": symmetric_edges,
    "assembled": assembled,
    "histogram": _histogram((), True),
    "histogram_by_type": _histogram(("event_type",), False),
}

_FIT = "fit as (select " + ", ".join(f"avg({c}) as m_{c}, stddev_pop({c}) as s_{c}" for c in COLUMNS) + " from lineitem)"
_Z = {c: f"(({c} - m_{c}) / s_{c})" for c in COLUMNS}
_SIGNED = f"""with {GRAPH_SQL.strip()},
ends as (select graph_id, src as node_id, dst as other from edges union all select graph_id, dst, src from edges),
around as (select ends.graph_id, ends.node_id, string_agg(label, '' order by label) as text
  from ends join nodes on nodes.node_id = ends.other and nodes.graph_id = ends.graph_id group by ends.graph_id, ends.node_id),
signed as (select nodes.graph_id, nodes.node_id, label || '-' || degree || '-' || hydrogens || '-' || charge || '_' || coalesce(text, '') as signature from nodes left join around using (graph_id, node_id))"""
_UNIT = "((('0x' || substr(md5(event_id::varchar || '|{s}'), {a}, 8))::bigint + {p}) / 4294967296.0::double)"
_U1, _U2 = _UNIT.format(s=SEED, a=1, p=1), _UNIT.format(s=SEED, a=9, p=0)
_EDGE_ROWS = values_table("bins", "bin, left_edge, right_edge", [(str(i), num(EDGES[i]), num(EDGES[i + 1])) for i in range(len(EDGES) - 1)])
_IN_BIN = f"value >= left_edge and (value < right_edge or (value = right_edge and right_edge = {num(EDGES[-1])}))"
SQL = {
    "scaler": " union all ".join(
        f"select {i} as position, '{c}' as name, {r6(f'avg({c})', 'mean')}, {r6(f'stddev_pop({c})', 'scale')} from lineitem" for i, c in enumerate(COLUMNS)
    ),
    "scaled": f"with {_FIT} select " + ", ".join(r6(z, c) for c, z in _Z.items()) + " from lineitem, fit",
    "weighted_score": f"with {_FIT} select "
    + r6("(" + " + ".join(f"{z} * {num(w)}" for z, w in zip(_Z.values(), WEIGHTS)) + f") / {num(sum(WEIGHTS))}", "score")
    + " from lineitem, fit",
    "noisy_values": "select event_id, " + r6(f"value + sqrt(-2.0::double * ln({_U1})) * cos({num(2 * pi)} * {_U2}) * 0.015::double", "value") + " from events",
    "symbol_codes": """with rows as (select p_partkey, replace(replace(replace(p_name || ' Cl' || p_size || 'BrSi', 'Si', 'X'), 'Cl', 'Y'), 'Br', 'Z') as text from part),
        chars as (select p_partkey, unnest(string_split(text, '')) as sym, generate_subscripts(string_split(text, ''), 1) as pos from rows),
        voc as (select sym, row_number() over (order by min((p_partkey, pos))) as code from chars group by sym),
        coded as (select p_partkey, list(code order by pos) as codes from chars join voc using (sym) group by p_partkey)
        select p_partkey, array_to_string(list_concat(codes, list_resize([]::bigint[], 64 - len(codes), 0::bigint)), ',') as codes from coded""",
    "symbol_vocabulary": """with chars as (select doc_id, unnest(string_split(text, '')) as symbol, generate_subscripts(string_split(text, ''), 1) as pos from documents)
        select symbol, row_number() over (order by min((doc_id, pos)))::int as code from chars group by symbol""",
    "node_signatures": _SIGNED + " select graph_id, node_id, signature from signed",
    "signature_codes": _SIGNED
    + """, voc as (select signature, row_number() over (order by min((graph_id, node_id))) - 1 as code from signed group by signature)
        select graph_id, node_id, code, (select count(*) + 1 from voc) as n_signatures from signed join voc using (signature)""",
    "signature_dictionary": _SIGNED
    + " select row_number() over (order by min((graph_id, node_id))) - 1 as code, signature from signed group by signature",
    "symmetric_edges": """with bonds as (select l_orderkey as graph_id, l_partkey as src, l_suppkey as dst,
        row_number() over (partition by l_orderkey order by l_partkey, l_suppkey) - 1 as b, count(*) over (partition by l_orderkey) as n
        from (select distinct l_orderkey, l_partkey, l_suppkey from lineitem))
        select graph_id, b as slot, src, dst from bonds union all select graph_id, 2 * n - 1 - b, dst, src from bonds""",
    "assembled": """select l_orderkey, round(l_quantity * 100)::int || ',' || round(l_discount * 100)::int || ',' || round(l_tax * 100)::int || ',' || l_linenumber * 100 as features from lineitem""",
    "histogram": f"with {_EDGE_ROWS} select bin, left_edge, right_edge, count(value) as n, "
    + r6("count(value) / (select count(*) from events)", "share")
    + f" from bins left join events on {_IN_BIN} group by all",
    "histogram_by_type": f"with {_EDGE_ROWS}, kinds as (select distinct event_type from events) select kinds.event_type, bin, left_edge, right_edge, count(value) as n "
    f"from bins cross join kinds left join events on events.event_type = kinds.event_type and {_IN_BIN} group by all",
}
