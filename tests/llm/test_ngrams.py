"""The prefix-tree join against all pairs, its SQL twin and the bounds it rests on."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from outvote.llm import ngram_trie as nt
from outvote.llm import queries
from outvote.llm.components import components

from .conftest import SCHEMA, by_sql, messy_rows, same_rows, words

DUCK = "doc_id bigint, text varchar, lang varchar, source varchar, n_chars bigint"


def shingles(text, width=3):
    w = words(text)
    return {tuple(w)} if 0 < len(w) < width else {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


def by_all_pairs(rows, percent=90, width=3):
    """Union-find over documents; a document is all rows of an id."""
    sets = [(r[0], shingles(r[1], width)) for r in rows]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    named = [(d, s) for d, s in sets if s and d is not None]
    for i, (a, x) in enumerate(named):
        for b, y in named[:i]:
            if a == b or (min(len(x), len(y)) * 100 >= percent * max(len(x), len(y)) and 100 * len(x & y) >= percent * len(x | y)):
                p, q = root(a), root(b)
                up[max(p, q)] = min(p, q)
    of_set = {frozenset(s): root(d) for d, s in named}
    return [(d, len(s), root(d) if s and d is not None else of_set.get(frozenset(s)) if s else d) for d, s in sets]


def compare(df, rows, percent=90, width=3):
    want = pd.DataFrame(by_all_pairs(rows, percent, width), columns=["doc_id", "n_shingles", "component_id"])
    same_rows(df, want)


@pytest.mark.parametrize("percent", [90, 70])
def test_join_equals_all_pairs_on_messy_rows(spark, messy, percent):
    compare(nt.jaccard_components(messy, percent), messy_rows(), percent)


def test_sql_twin_equals_all_pairs(spark):
    rows = [r for r in messy_rows() if r[0] is not None and r[0] not in (7, 8, 10, 13)]
    want = pd.DataFrame(by_all_pairs(rows), columns=["doc_id", "n_shingles", "component_id"])
    same_rows(by_sql(queries.OP12_SQL, documents=(rows, DUCK)), want)


def chains(seed=2):
    """Groups whose members differ step by step, so that ends are alike only through the others, of many sizes."""
    r = random.Random(seed)
    rows, at = [], 0
    for n in (9, 10, 11, 12, 19, 20, 21, 40, 90, 300):
        base = [f"w{r.randrange(10**9)}" for _ in range(n + 2)]
        for _ in range(14):
            base = base.copy()
            if r.random() < 0.6:
                base[r.choice([0, -1])] = f"x{r.randrange(10**9)}"
            elif r.random() < 0.5:
                base.append(f"y{r.randrange(10**9)}")
            else:
                base = base[1:]
            at += 1
            rows.append((at * 7 % 1000, " ".join(base), "en", "s", 0))
    return rows


@pytest.mark.parametrize("tree", [8 << 20, 2000])
def test_chains_are_whole_whatever_the_blocks(spark, monkeypatch, tree):
    monkeypatch.setattr(nt, "TREE_BYTES", tree)
    rows = chains()
    compare(nt.jaccard_components(spark.createDataFrame(rows, SCHEMA).repartition(3)), rows)


def test_thousands_of_near_copies_are_one_group(spark, monkeypatch):
    monkeypatch.setattr(nt, "TREE_BYTES", 200_000)
    text = " ".join(f"word{i}" for i in range(200))
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit(text + " "), F.col("id").cast("string")).alias("text"))
    df = df.union(spark.range(3000, 3100).select("id", F.concat(F.lit("another text altogether "), F.col("id").cast("string"), F.lit(" with its own end"))))
    got = nt.jaccard_components(df)
    sizes = got.groupBy("component_id").count().orderBy("component_id").collect()
    assert (sizes[0][0], sizes[0][1]) == (0, 3000) and len(sizes) == 101


def test_empty_tables(spark, nothing):
    got = nt.jaccard_components(nothing)
    assert got.columns == ["doc_id", "n_shingles", "component_id"] and got.count() == 0


def test_linked_sets_share_a_key_always():
    """All pairs of sizes up to 60 at the least overlap that links them, with the differing elements drawn at random."""
    r = np.random.default_rng(1)
    for percent in (90, 80, 50):
        classes = nt.SizeClasses(percent)
        for a in range(1, 61):
            for b in range(a, 100 * a // percent + 1):
                both = -(-percent * (a + b) // (100 + percent))
                if both > a:
                    continue
                assert (a, b) == (both, both) or classes.segments[classes.of(np.array([a]))[0]] > a + b - 2 * both
                drawn = r.integers(0, 2**63, a + b - both).astype(np.uint64)
                x, y = np.sort(drawn[:a]), np.sort(drawn[a - both :])
                if a + b == 2 * both:
                    continue  # equal sets are one node
                keys = [set(np.frombuffer(k, np.int64).tolist()) for k in nt.segment_keys([x, y], classes)]
                assert keys[0] & keys[1]
                of = [dict(v) for v in nt.vectors([x, y], classes)]
                cls = int(classes.of(np.array([a]))[0])
                p, q = (np.frombuffer(v[cls], np.uint8) for v in of)
                assert (p != q).sum() < classes.segments[cls]


def test_tree_finds_what_comparing_finds():
    r = random.Random(3)
    pool = [np.uint64(r.randrange(2**63)) for _ in range(60)]
    sets = [np.unique(np.array(r.sample(pool[: r.choice([12, 60])], r.randint(1, 12)), np.uint64)) for _ in range(150)]
    sets += sets[:20]
    tree = nt.PrefixTree(sets)
    assert sum(end - start for _, _, start, end, *_ in tree.nodes) < sum(map(len, sets))
    for percent in (40, 75, 90, 100):
        for probe in sets[:60]:
            own = set(probe.tolist())
            want = sorted(i for i, s in enumerate(sets) if 100 * len(own & set(s.tolist())) >= percent * len(own | set(s.tolist())))
            assert sorted(tree.similar(probe, percent)) == want
    assert nt.PrefixTree([]).similar(sets[0], 90) == []


def test_bucket_links_alone_find_all_components(spark, monkeypatch):
    monkeypatch.setattr(nt, "TREE_BYTES", 600)
    r = random.Random(6)
    sets = [np.unique(np.array([r.randrange(40) for _ in range(20)], np.uint64)) for _ in range(60)]
    full = spark.createDataFrame([(i, len(s), bytearray(s.tobytes())) for i, s in enumerate(sets)], "node long, size long, set binary")
    rows = spark.createDataFrame([(i % 3, i, i) for i in range(60)], "key long, node long, comp long")
    found = {(a["node"], a["root"]) for a in components(nt._bucket_links(rows, full, 30)).collect()}
    up = list(range(60))
    for i in range(60):
        for j in range(i):
            x, y = set(sets[i].tolist()), set(sets[j].tolist())
            if i % 3 == j % 3 and 100 * len(x & y) >= 30 * len(x | y):
                old, new = max(up[i], up[j]), min(up[i], up[j])
                up = [new if u == old else u for u in up]
    assert found == {(i, u) for i, u in enumerate(up) if u != i}
