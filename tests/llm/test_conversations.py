"""The conversation trie against the SQL twin and a dictionary of prefixes, in shards of a few turns."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from outvote.llm import conversation_trie as ct
from outvote.llm import queries
from outvote.llm.common import spread_join

from .conftest import by_sql, same_rows, words

SCHEMA = "conv_id long, turn long, role string, text string"
DUCK = "conv_id bigint, turn bigint, role varchar, text varchar"


def conversations(n=90, seed=4):
    """Conversations with common heads, exact copies, nulls, ties, gaps in the ids and a long one."""
    r = random.Random(seed)
    says = ["hello there", "", "how are you", "a  b\tc", None, "é ß", "one two three four five", "x" * 3000 + " y"]
    rows, made = [], []
    for i in range(n):
        if i % 20 == 0 and i % 40:
            continue
        own = made[r.randrange(len(made))][: r.randint(1, 9)] if made and r.random() < 0.6 else []
        own = [*own, *[(r.choice(["user", "assistant", None]), r.choice(says)) for _ in range(r.randint(0 if own else 1, 4))]]
        made.append(own)
        rows += [(i, k if r.random() < 0.9 else None, *turn) for k, turn in enumerate(own)]
    rows += [(500 + i, k, "user", f"hot {k}") for i in range(60) for k in range(3)]
    rows += [(700, k, "user", f"deep {k % 3}") for k in range(60)] + [(701, k, "user", f"deep {k % 3}") for k in range(59)]
    rows += [(None, 1, "user", "nobody's"), (-5, 0, "user", "hello there"), (3, 1, "user", "tied"), (3, 1, "user", "tied"), (3, 1, "assistant", "tied too")]
    return rows


def by_prefixes(rows, stride=20, heads=4):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, hashlib.sha256(f"{len(role or '')}:{role or ''}{text or ''}".encode()).hexdigest(), (role or "", text or "")))
    own = {c: [t[-1] for t in sorted(turns)] for c, turns in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % heads
        whole[c] = tuple(own.get(c - int(np.fmod(c, stride)), [])[:h] + turns[h:])
    members, ends = {}, {}
    for c, turns in whole.items():
        ends.setdefault(turns, []).append(c)
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    out = []
    for node, held in members.items():
        below = [m for m in members if m[: len(node)] == node]
        out.append(
            (
                min(held), len(node), min(members[node[:-1]]) if node else None, len(held), sum(len(m) == len(node) + 1 for m in below),
                sum(not any(len(k) == len(m) + 1 and k[: len(m)] == m for k in members) for m in below),
                sum((len(members[m]) - 1) * len(words(m[-1][1])) for m in below if m), hashlib.sha256(",".join(map(str, sorted(ends.get(node, [])))).encode()).hexdigest(),
            )
        )
    return sorted(out, key=str)


def made(df):
    assert df.columns == ct.RESULT
    return sorted([tuple(r) for r in df.collect()], key=str)


@pytest.mark.parametrize("turns", [1, 9, 200_000])
def test_trie_equals_a_dictionary_of_prefixes(spark, monkeypatch, turns):
    monkeypatch.setattr(ct, "SHARD_TURNS", turns)
    rows = conversations()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    df = df.withColumns({c: F.lit("clash") for c in ("digest", "code", "codes", "words", "k", "part", "key", "n", "h", "base", "depth")})
    assert made(ct.conversation_trie(df)) == by_prefixes(rows)


def test_sql_twin_equals_the_dictionary(spark):
    rows = conversations(40, seed=8)
    df = ct.conversation_trie(spark.createDataFrame(rows, SCHEMA))
    same_rows(df, by_sql(queries.OP13_SQL, conversations=(rows, DUCK)))


def test_equal_conversations_are_split_over_shards(spark, monkeypatch):
    monkeypatch.setattr(ct, "SHARD_TURNS", 40)
    turns = spark.range(500).select(F.col("id").alias("conv_id"), F.explode(F.array(*map(F.lit, (0, 1, 2)))).alias("turn"))
    rows = ct.sequences(ct.coded_turns(turns.withColumns({"role": F.lit("user"), "text": F.concat(F.lit("turn number "), "turn")})))
    assert ct._shards(rows).count() > 40
    got = made(ct.trie_nodes(rows))
    ends = hashlib.sha256(",".join(map(str, range(500))).encode()).hexdigest()
    saved = 499 * 3
    assert got == [
        (0, 0, None, 500, 1, 1, 3 * saved, ct.NOBODY), (0, 1, 0, 500, 1, 1, 3 * saved, ct.NOBODY),
        (0, 2, 0, 500, 1, 1, 2 * saved, ct.NOBODY), (0, 3, 0, 500, 0, 1, saved, ends),
    ]


def test_no_conversations_have_no_nodes(spark):
    assert made(ct.conversation_trie(spark.createDataFrame([], SCHEMA))) == []
    assert made(ct.conversation_trie(spark.createDataFrame([(None, 1, "user", "x")], SCHEMA))) == []


def test_turnless_conversations_are_members_of_the_root(spark):
    c = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 >= 1)
    got = made(ct.conversation_trie(spark.createDataFrame([(c, 0, "user", "gone")], SCHEMA)))
    assert got == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


def test_tree_finds_what_was_inserted():
    r = random.Random(1)
    found = {tuple(r.randrange(6) for _ in range(r.randint(0, 5))) for _ in range(200)}
    ordered = sorted(found)
    tree = ct.TernarySearchTree()
    order = list(ct._median_order(len(ordered)))
    assert sorted(order) == list(range(len(ordered))) and order[0] == len(ordered) // 2
    ends = {ordered[i]: tree.insert(ordered[i], ordered[i]) for i in order}
    prefixes = {s[:d] for s in found for d in range(len(s) + 1)}
    assert len(tree.up) == len(prefixes)
    for s, node in ends.items():
        assert tuple(tree.symbol[i] for i in tree.path(node)[1:]) == s and tree.insert(s, s) == node


def test_spread_join_with_and_without_hot_keys(spark, monkeypatch):
    rows = spark.range(30_000).select((F.pmod(F.col("id"), F.lit(7)) * (F.col("id") % 2)).alias("g"))
    facts = rows.groupBy("g").agg(F.count("*").alias("n")).withColumn("name", F.concat(F.lit("g"), "g"))
    got = spread_join(rows, facts, "g", "n")
    assert "BroadcastHashJoin" in got._jdf.queryExecution().toString()
    assert sorted(got.groupBy("g", "n", "name").count().collect()) == sorted(facts.select("g", "n", "name", F.col("n").alias("count")).collect())
