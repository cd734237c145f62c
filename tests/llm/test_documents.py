"""Operators on documents against SQL twins and brute force, on a messy fixture."""

import hashlib
import heapq
import random
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from outvote.llm import decontamination as dc
from outvote.llm import line_dedup, mixing, near_duplicates, quality_rules, queries, rule_ensemble, sentence_spans, statistics, trees
from outvote.llm.components import components
from outvote.llm.kernels import Words, shingle_set
from outvote.llm.sketches import bands, superminhash

from .conftest import CLASHING, LOW, SCHEMA, by_sql, messy_rows, same_rows, texts, words

DUCK = "doc_id bigint, text varchar, lang varchar, source varchar, n_chars bigint"


# words and signatures


def test_words_are_those_of_the_pattern():
    column = [r[1] for r in messy_rows()]
    made = Words(pa.array(column, pa.string()), lower=True)
    codes: dict[int, str] = {}
    for i, text in enumerate(column):
        own = words(text)
        found = made.hashes[made.at[i] : made.at[i + 1]].tolist()
        assert len(found) == len(own)
        for code, word in zip(found, own):
            assert codes.setdefault(code, word) == word
    assert len(set(codes.values())) == len(codes)


def test_words_do_not_depend_on_stretches(monkeypatch):
    from outvote.llm import kernels

    column = pa.array([r[1] for r in messy_rows()], pa.string())
    whole = Words(column, True)
    monkeypatch.setattr(kernels, "STRETCH", 1000)
    parts = Words(column, True)
    assert (whole.hashes == parts.hashes).all() and (whole.at == parts.at).all() and (whole.ends == parts.ends).all()


def _superminhash_by_steps(elements, m):
    """One set, one element at a time, with the permutation written out."""
    from outvote.llm.kernels import draw

    sig = [2**64 - 1] * m
    for e in elements:
        p = list(range(m))
        for j in range(m):
            noise = int(draw(np.array([e], np.uint64), 2 * j)[0]) >> 32
            k = j + (noise * (m - j) >> 32)
            p[j], p[k] = p[k], p[j]
            offer = (int(draw(np.array([e], np.uint64), 2 * j + 1)[0]) >> 8) | (j << 56)
            sig[p[j]] = min(sig[p[j]], offer)
    return sig


@pytest.mark.parametrize("n", [1, 3, 40])
def test_signature_with_early_stopping_equals_all_steps(n):
    r = np.random.default_rng(n)
    sets = [r.integers(0, 2**63, k, np.int64).view(np.uint64) for k in (n, 2)]
    got = superminhash(np.concatenate(sets), np.repeat([0, 1], [n, 2]), 3, 32)
    assert [int(v) for v in got[0]] == _superminhash_by_steps(sets[0], 32)
    assert [int(v) for v in got[1]] == _superminhash_by_steps(sets[1], 32)
    assert (got[2] == np.uint64(2**64 - 1)).all()


def test_signatures_estimate_similarity_with_less_variance_than_independent_slots():
    r = np.random.default_rng(1)
    estimates = []
    for _ in range(300):
        both, x, y = np.split(r.integers(0, 2**63, 30, np.int64).view(np.uint64), [20, 25])
        a, b = np.concatenate([both, x]), np.concatenate([both, y])
        sig = superminhash(np.concatenate([a, b]), np.repeat([0, 1], 25), 2, 128)
        estimates.append((sig[0] == sig[1]).mean())
    assert abs(np.mean(estimates) - 20 / 30) < 0.01
    assert np.var(estimates) < 0.8 * (2 / 3) * (1 / 3) / 128
    assert bands(sig, 32).shape == (2, 32)


# near-duplicates


def _groups(rows, percent):
    """Component of each row by comparing all pairs; rows that share an id are one document."""
    sets = [(d, set(zip(*[w[i:] for i in range(5)])) if len(w) >= 5 else ({tuple(w)} if w else set())) for d, w in ((r[0], words(r[1])) for r in rows)]
    up = {d: d for d, _ in sets if d is not None}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if a is not None and b is not None and x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = root(a), root(b)
                up[max(p, q)] = min(p, q)
    out = []
    for d, s in sets:
        if d is not None:
            component = root(d)
        else:  # copies of a row without id
            component = min([root(e) for e, t in sets if e is not None and s and t == s], default=None)
        out.append((d, len(s), component, d == component))
    return pd.DataFrame(out, columns=["doc_id", "n_shingles", "component_id", "kept"])


@pytest.mark.parametrize("percent", [85, 80])
def test_near_duplicates_equal_all_pairs(messy, percent):
    same_rows(near_duplicates.near_duplicates(messy, percent), _groups(messy_rows(), percent))


def test_near_duplicates_in_blocks_and_without_rows(spark, nothing, monkeypatch):
    """A hot group of near copies whose links form a web, in blocks of a few nodes."""
    r = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(90):
        w = list(base)
        for _ in range(r.randint(0, 4)):
            w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
        rows.append((i, " ".join(w), None, None, None))
    monkeypatch.setattr(near_duplicates, "BLOCK", 16)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    same_rows(near_duplicates.near_duplicates(df, 85), _groups(rows, 85))
    assert near_duplicates.near_duplicates(nothing).count() == 0


@pytest.mark.parametrize("links_a_task", [200_000, 60])
def test_components_of_a_long_path_and_a_hub(spark, monkeypatch, links_a_task):
    from outvote.llm import components as module

    monkeypatch.setattr(module, "LINKS_A_TASK", links_a_task)
    links = [(i + 1, i) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5, 5), (None, 3)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "x long, y long").repartition(7)).collect()}
    assert got == {**{i: 0 for i in range(1, 301)}, **{1000 + i: 1000 for i in range(1, 200)}}
    assert components(spark.createDataFrame([], "x long, y long")).count() == 0


# lines


def test_line_dedup_equals_sql(messy):
    out = line_dedup.dedup_lines(messy)
    assert set(CLASHING) <= set(out.columns) and out.columns.count("n_lines") == 1
    got = out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
    expected = _dropped_lines(messy_rows())
    same_rows(got, expected)
    once = [r for r in messy_rows() if r[0] is not None and r[0] not in (10, 13)]
    twin = by_sql(queries.OP10_SQL, documents=(once, DUCK))
    same_rows(_dropped_lines(once), twin)


def _dropped_lines(rows):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOW)
    holders: dict[str, set] = {}
    for d, t, *_ in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 20 and d is not None:
                holders.setdefault(key(line), set()).add(d)
    repeated = {k: max(v) for k, v in holders.items() if len(v) >= 3}
    out = []
    for d, t, *_ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if repeated.get(key(x), d) == d]
        out.append((d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return pd.DataFrame(out, columns=["doc_id", "n_lines", "n_dropped", "kept_sha256"])


def test_line_index_takes_back_what_was_inserted(spark, nothing):
    line = lambda k: f"this is line number {k} of some documents"
    rows = [(i, "\n".join(line((i * j) % 17) for j in range(1, 6)), None, None, None) for i in range(40)]
    df = lambda part: spark.createDataFrame(part, SCHEMA)
    drops = lambda index: sorted(map(tuple, index.drops().collect()))
    start = line_dedup.LineIndex.of(df(rows[:25]))
    assert drops(start)
    grown = start.insert(df(rows[25:]))
    assert drops(grown) == drops(line_dedup.LineIndex.of(df(rows)))
    assert drops(grown.delete(df(rows[25:]))) == drops(start)
    assert drops(grown.delete(df(rows[:38]))) == []
    assert drops(line_dedup.LineIndex.of(nothing).insert(df(rows[:25]))) == drops(start)
    assert line_dedup.dedup_lines(nothing).count() == 0


def test_line_index_keeps_its_layers_and_counts_touched_keys_anew(spark, monkeypatch):
    r = random.Random(5)
    rows = [(i if i % 9 else None, "\n".join(f"this is line number {r.randrange(30)} of some documents" for _ in range(4)), None, None, None) for i in range(60)]
    df = lambda part: spark.createDataFrame(part, SCHEMA)
    state = lambda index: (sorted(map(str, index.drops().collect())), sorted(map(tuple, index.repeated.collect())))
    index = line_dedup.LineIndex.of(df(rows[:30]))
    absent = index.delete(df(rows[30:36]))  # never inserted, and none without an id
    assert state(absent) == state(index) and absent.layers[0] is index.layers[0]
    for step in (2, 8):
        monkeypatch.setattr(line_dedup, "MOST_LAYERS", step)
        grown = absent.insert(df(rows[30:])).delete(df(rows[:10]))
        assert state(grown) == state(line_dedup.LineIndex.of(df(rows[10:])))
        assert len(grown.layers) <= step


def test_filters_too_large_for_a_map_meet_references_by_shard(spark, messy, monkeypatch):
    hot = [(5000 + i, "a line that a third of all documents have\nand a line of its own, number " + str(i // 4), None, None, None) for i in range(200)]
    docs = messy.select("doc_id", "text").union(spark.createDataFrame(hot, SCHEMA).select("doc_id", "text"))
    found = lambda index: sorted(map(str, index.drops().collect()))
    expected = found(line_dedup.LineIndex.of(docs))
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 5)
    monkeypatch.setattr(line_dedup, "PIECE_ROWS", 30)
    shards = line_dedup.LineIndex.of(docs)
    grown = shards.insert(docs.filter("doc_id is null")).delete(docs.filter("doc_id < 0"))
    assert shards.n_shards > 3 and found(shards) == expected
    monkeypatch.setattr(line_dedup, "BROADCAST_BYTES", 0)
    assert found(shards) == expected and len(expected) > 250
    assert found(grown) == expected
    assert shards.maybe_repeated().groupBy("h1", "h2", "doc_id").count().filter("count > 1").count() == 0


def test_cuckoo_filter_has_no_false_negatives_and_deletes():
    r = np.random.default_rng(2)
    h = r.integers(-(2**63), 2**63 - 1, (2, 5000), np.int64)
    made = line_dedup.CuckooFilter(5000)
    assert made.add(h[0], h[1]) and made.holds(h[0], h[1]).all()
    other = r.integers(-(2**63), 2**63 - 1, (2, 20000), np.int64)
    assert made.holds(other[0], other[1]).mean() < 0.001
    made.remove(h[0, :2500], h[1, :2500])
    assert made.holds(h[0, 2500:], h[1, 2500:]).all() and made.holds(h[0, :2500], h[1, :2500]).mean() < 0.01
    assert not line_dedup.CuckooFilter(10).add(h[0], h[1])


# sentence spans


def _spans_by_definition(text, least):
    pieces, at = [], 0
    for m in re.finditer(r"[.!?]+[ \t]+|\n+", text or ""):
        pieces.append(text[at : m.end()])
        at = m.end()
    if text and at < len(text):
        pieces.append(text[at:])
    some = [i for i, p in enumerate(pieces) if words(p)]
    found = []
    for a in range(len(some)):
        for b in range(a, len(some)):
            run = [words(pieces[i]) for i in some[a : b + 1]]
            n = sum(map(len, run))
            if n >= least and (b > a or n >= 2 * least):
                found.append((str(run), set(some[a : b + 1])))
                break
    return pieces, len(some), found


def _without_repeated_spans(rows, least=25):
    first: dict[str, int | None] = {}
    count: dict[str, int] = {}
    for d, t, *_ in rows:
        for key, _ in _spans_by_definition(t, least)[2]:
            count[key] = count.get(key, 0) + 1
            old = first.get(key)
            first[key] = d if old is None else old if d is None else min(old, d)
    out = []
    for d, t, *_ in rows:
        pieces, n, found = _spans_by_definition(t, least)
        bad, seen = set(), set()
        for key, own in found:
            if count[key] > 1 and (first[key] != d or key in seen):
                bad |= own
            seen.add(key)
        out.append((d, "".join(p for i, p in enumerate(pieces) if i not in bad), n, len(bad)))
    return pd.DataFrame(out, columns=["doc_id", "text", "n_sentences", "n_removed"])


def test_sentence_spans_equal_brute_force(messy, nothing):
    short = [r for r in messy_rows() if len(r[1] or "") < 10_000]
    out = sentence_spans.dedup_spans(messy.filter("coalesce(length(text), 0) < 10000"))
    assert set(CLASHING) <= set(out.columns)
    expected = _without_repeated_spans(short)
    assert expected["n_removed"].sum() > 20
    same_rows(out.select("doc_id", "text", "n_sentences", "n_removed"), expected)
    assert sentence_spans.dedup_spans(messy).count() == len(messy_rows())
    assert sentence_spans.dedup_spans(nothing).count() == 0


def test_a_planted_passage_stays_in_its_first_document_only(spark):
    r = random.Random(8)
    sentence = lambda k: " ".join(f"v{r.randrange(10**5)}" for _ in range(k)) + "."
    passage = " ".join(sentence(13) for _ in range(5))
    rows = [(i, f"{sentence(9)} {sentence(7)} {'some words ' if i % 2 else ''}{passage} {sentence(20)}\n{sentence(4)}", None, None, None) for i in range(12)]
    got = {x["doc_id"]: x for x in sentence_spans.dedup_spans(spark.createDataFrame(rows, SCHEMA)).collect()}
    middle = passage.split(". ")[2]
    assert [d for d, x in got.items() if middle in x["text"]] == [0]
    assert all(x["n_removed"] >= 4 for d, x in got.items() if d) and got[0]["n_removed"] == 0


def _without_repeated_runs(rows, least=25):
    """As _without_repeated_spans, but every run of enough sentences and words counts."""

    def runs(text):
        pieces = [p.group() for p in re.finditer(r".+?(?:[.!?]+[ \t]+|\n+|$)", text, re.S)]
        size = [len(words(p)) for p in pieces]
        for a in range(len(pieces)):
            for b in range(a + 1, len(pieces) + 1):
                if sum(size[a:b]) >= least and (b - a > 1 or size[a] >= 2 * least):
                    yield str([words(p) for p in pieces[a:b]]), range(a, b)

    first: dict[str, tuple] = {}
    for d, t in rows:
        for key, own in runs(t):
            first[key] = min(first.get(key, (d, own[0])), (d, own[0]))
    out = {}
    for d, t in rows:
        bad = {i for key, own in runs(t) if first[key] != (d, own[0]) for i in own}
        pieces = [p.group() for p in re.finditer(r".+?(?:[.!?]+[ \t]+|\n+|$)", t, re.S)]
        out[d] = "".join(p for i, p in enumerate(pieces) if i not in bad)
    return out


def test_every_run_of_sentences_counts(spark):
    r = random.Random(3)
    sentence = lambda k: " ".join(f"v{r.randrange(10**5)}" for _ in range(k)) + ". "
    short_end, long_start = [sentence(k) for k in (20, 10, 5)], [sentence(k) for k in (55, 40)]
    rows = [(d, sentence(30) + "".join(short_end) + sentence(30) + "".join(long_start) + sentence(30)) for d in range(2)]
    pool = [sentence(r.choice((1, 3, 8, 15, 30, 60))) for _ in range(40)]
    for d in range(2, 40):
        cuts = [(r.randrange(40), r.randrange(1, 9)) for _ in range(3)]
        rows.append((d, "".join("".join(pool[a : a + n]) + sentence(r.choice((2, 9, 30))) for a, n in cuts)))
    docs = spark.createDataFrame([(d, t, None, None, None) for d, t in rows], SCHEMA)
    got = {x["doc_id"]: x["text"] for x in sentence_spans.dedup_spans(docs).collect()}
    assert got[0] == rows[0][1] and not any(p in got[1] for p in short_end + long_start)
    assert got == _without_repeated_runs(rows)


# quality


def _base_by_definition(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    runs: dict[tuple, list] = {}
    for i in range(len(w) - 4):
        runs.setdefault(tuple(w[i : i + 5]), []).append(i)
    covered = {i + k for v in runs.values() if len(v) > 1 for i in v for k in range(5)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)


def test_base_statistics_equal_brute_force(spark, messy, nothing):
    labels = spark.createDataFrame([(10, 1), (16, 1), (900, 0), (None, 0), (19, None)], "doc_id long, quality int")
    got = quality_rules.judge(messy.select(SCHEMA.replace(" long", "").replace(" string", "").split(", ")), quality_rules.fit(messy, labels))
    got = got.select("doc_id", *statistics.COUNTS, "base_failed").toPandas()
    rows = [(d, *_base_by_definition(t)) for d, t, *_ in messy_rows()]
    expected = pd.DataFrame(rows, columns=["doc_id", *statistics.COUNTS])
    expected["base_failed"] = (expected["n_words"] < 10) | (100 * expected["n_repeat_words"] > 20 * expected["n_words"])
    same_rows(got, expected)
    kept = quality_rules.passing(messy, labels)
    assert kept.columns == messy.columns and 0 < kept.count() < messy.count()
    assert quality_rules.passing(nothing, labels).count() == 0
    assert quality_rules.passing(messy, labels.limit(0)).count() == int((~expected["base_failed"]).sum())


def test_flat_trees_score_like_a_walk_and_are_monotone():
    r = np.random.default_rng(4)
    x = r.random((3000, 4))
    y = ((x[:, 0] + 0.1 * r.standard_normal(3000) > 0.5) & ((x[:, 1] > 0.8) | (x[:, 2] < 0.6))).astype(float)
    forest = trees.fit(x, y, trees=25, signs=[1, 0, -1, 0])
    assert ((forest.score(x) > 0.5) == y).mean() > 0.9

    def walk(row):
        total = forest.start
        for f, t, v in zip(forest.feature, forest.threshold, forest.value):
            at = 0
            while at < len(f):
                at = 2 * at + 1 + bool(f[at] >= 0 and row[f[at]] > t[at])
            total += v[at - len(f)]
        return total

    assert np.allclose([walk(row) for row in x[:200]], forest.margin(x[:200]))
    for j, sign in ((0, 1), (2, -1)):
        grid = np.repeat(x[:100], 50, axis=0)
        grid[:, j] = np.tile(np.linspace(-0.1, 1.1, 50), 100)
        steps = np.diff(forest.margin(grid).reshape(100, 50), axis=1)
        assert (sign * steps >= -1e-12).all() and (steps != 0).any()


def test_quality_models_on_held_out_labels(spark, sf_dir):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = queries.op7_rule_ensemble(spark, "/root/testdata/sf0.01").join(labels, "doc_id").toPandas()
    out = got[got["held_out"]]
    assert len(out) > 50 and (out["predicted"] == out["quality"]).mean() > 0.95
    six = queries.op6_quality_rules(spark, "/root/testdata/sf0.01").join(labels, "doc_id").toPandas()
    six = six[~six["base_failed"]]
    assert (six["kept"] == (six["quality"] == 1)).mean() > 0.97


def test_rules_are_paths_and_compile_to_the_same_score(spark, messy, nothing):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = rule_ensemble.fit(docs, labels)
    assert model.rules and all(r.terms for r in model.rules)
    rows = statistics.with_statistics(docs.select("doc_id", "text"), ["doc_id"]).withColumn("got", model.column()).toPandas()
    x = rows[statistics.FEATURES].to_numpy(float)
    z = model.intercept + sum(w * r.holds(x) for r, w in zip(model.rules, model.weights))
    assert np.allclose(rows["got"], 1 / (1 + np.exp(-z)))
    scored = rule_ensemble.classify(messy, model).toPandas()
    assert len(scored) == len(messy_rows()) and scored["score"].between(0, 1).all() and not scored.loc[scored["doc_id"].isna(), "held_out"].any()
    assert rule_ensemble.classify(nothing, model).count() == 0
    none = rule_ensemble.fit(docs, labels.limit(0))
    assert none.rules == [] and rule_ensemble.classify(docs.limit(3), none).filter("predicted = 1").count() == 3


def test_held_out_rows_teach_nothing(spark):
    import zlib

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    odd = F.udf(lambda d: zlib.crc32(str(d).encode()) % 4 == 2, "boolean")("doc_id")
    turned = labels.withColumn("quality", F.when(odd, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert rule_ensemble.fit(docs, labels) == rule_ensemble.fit(docs, turned)


# mixing


def test_mixing_equals_sql_on_a_messy_table(spark, messy, nothing):
    got = mixing.mix(messy)
    rows = messy_rows()
    twin = by_sql(queries.OP9_SQL, documents=(rows, DUCK))
    same_rows(got, twin)
    whole = mixing.mix(messy, keep=True)
    assert set(messy.columns) <= set(whole.columns) and whole.columns.count("size") == 1
    same_rows(whole.select("doc_id", "size", "source_size", "target", "taken"), twin)
    assert (twin["taken"] <= 2 * twin["size"]).all()
    assert sorted(twin["size"]) == sorted(len(words(r[1])) for r in rows)
    assert mixing.mix(nothing).count() == 0 and mixing.mix(spark.createDataFrame([(1, None, None)], "doc_id long, text string, source string")).first()["taken"] == 0


def test_quotas_follow_highest_quotients(spark):
    r = random.Random(1)
    votes = [r.choice([0.0, 1.0, 5.0, 5.0, r.random() * 400]) for _ in range(60)]
    cells = spark.createDataFrame([(None if i % 7 == 0 else f"s{i % 7}", i // 7, v) for i, v in enumerate(votes)], "source string, shard long, votes double")
    for n in (0, 1, 37, 200, 1001):
        heap = [(-v, i % 7 == 0, f"s{i % 7}", i // 7, 0, v) for i, v in enumerate(votes)]
        heapq.heapify(heap)
        won: dict = {}
        for _ in range(n):
            _, none, source, shard, k, v = heapq.heappop(heap)
            won[(none, source, shard)] = won.get((none, source, shard), 0) + 1
            heapq.heappush(heap, (-v / (2 * k + 3), none, source, shard, k + 1, v))
        got = {(q["source"] is None, q["source"] or "s0", q["shard"]): q["quota"] for q in mixing.quotas(cells, n).collect()}
        assert {k: v for k, v in got.items() if v} == won


def test_mix_comes_near_its_targets_with_many_shards(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_DOCS", 40)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mixing.mix(docs).join(docs.select("doc_id", "source"), "doc_id").toPandas()
    assert (rows["taken"] <= 2 * rows["size"]).all()
    for _, part in rows.groupby("source"):
        assert abs(part["taken"].sum() - part["target"].iloc[0]) < 0.05 * part["target"].iloc[0]


def test_small_sources_come_near_their_targets_too(spark):
    sizes = [5, 10, 20, 25, 26, 40, 60, 75, 99, 100, 101, 120, 149, 150]
    rows = [(1000 * i + k, "w " * (n - n // 2 if k else n // 2), f"s{i:02}") for i, n in enumerate(sizes) for k in (0, 1)]
    rows += [(100_000 + i, "w " * 90, "zz") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs)
    same_rows(got, by_sql(queries.OP9_SQL, documents=(rows, DUCK)))
    mixed = got.join(docs.select("doc_id", "source"), "doc_id").toPandas()
    for source, part in mixed.groupby("source"):
        assert abs(part["taken"].sum() - part["target"].iloc[0]) <= (5 if source < "z" else 100), source
    assert (mixed["taken"] <= 2 * mixed["size"]).all()


# decontamination


def _best_alignment(item, text):
    """Whole table of Smith-Waterman scores."""
    h = [[0] * (len(text) + 1) for _ in range(len(item) + 1)]
    best = 0
    for i in range(1, len(item) + 1):
        for j in range(1, len(text) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if item[i - 1] == text[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
            best = max(best, h[i][j])
    return best


def test_alignment_equals_the_whole_table():
    r = random.Random(3)
    for _ in range(60):
        item = [r.randrange(6) for _ in range(r.randint(1, 12))]
        text = [r.randrange(6) for _ in range(r.randint(1, 25))]
        score, end = dc.align(np.array(item), np.array(text))
        assert score == _best_alignment(item, text)
        if score:
            assert dc.align(np.array(item), np.array(text[:end]))[0] == score


def test_planted_passages_are_found_and_clean_documents_left(spark, messy, nothing):
    r = random.Random(11)
    vocabulary = ["the", "of", "and", "in"] + [f"v{i}" for i in range(3000)]
    make = lambda k: [r.choice(vocabulary[:4]) if r.random() < 0.4 else r.choice(vocabulary) for _ in range(k)]
    items = [(i, " ".join(make(r.randint(15, 50)))) for i in range(20)] + [(20, None), (21, ""), (22, "too short")]
    rows, planted = [], {}
    for d in range(300):
        w = make(r.randint(30, 300))
        if d % 3 == 0:
            i = 0 if d % 6 == 0 else r.randrange(20)  # one item in a sixth of all documents
            own = items[i][1].split()
            for k in range(len(own)):
                if d % 2 and r.random() < 0.15:
                    own[k] = "edited"
            at = r.randrange(len(w))
            w[at:at] = own
            planted[d] = i
        rows.append((d, " ".join(w).capitalize() + ".", None, None, None))
    df, bench = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(items, "item_id long, text string")
    found = dc.contaminated(df, bench).toPandas()
    pairs = set(zip(found["doc_id"], found["item_id"]))
    assert pairs >= set(planted.items()) and {d for d, _ in pairs} == set(planted)
    text = {d: t for d, t, *_ in rows}
    break_words = lambda t: [x for x in re.split(r"[\s!-/:-@\[-`{-~]+", t.translate(LOW)) if x]
    for x in found.itertuples():
        item = break_words(items[x.item_id][1])
        passage = break_words(text[x.doc_id][x.begin : x.end])
        assert abs(_best_alignment(item, passage) / (2 * len(item)) - x.score) < 1e-9 and x.score >= 0.5
    clean = dc.clean(df, bench)
    assert {x["doc_id"] for x in clean.collect()} == set(range(300)) - set(planted)
    assert dc.clean(messy, bench).columns == messy.columns and dc.contaminated(messy, bench).count() == 0
    assert dc.clean(nothing, bench).count() == 0 and dc.clean(df, bench.limit(0)).count() == 300


def test_parts_of_long_items_and_short_items_are_found(spark):
    r = random.Random(12)
    make = lambda k: [f"v{r.randrange(10**5)}" for _ in range(k)]
    long = make(400)
    common = long[:40] + ["the", "of"] * 180  # rare words at its start, a common rest
    items = [(0, " ".join(long)), (1, "Only Three, words"), (2, "短い文章"), (3, " ".join(common)), (4, "!")]
    plain = lambda w: " ".join(make(50) + w + make(50))
    rows = [plain(long[150:340]), plain(long[200:232]), plain(long[200:225]), plain(["only", "three", "WORDS."]), plain(["only", "three", "more", "words"]), "短い文章。", "a 短い文章 b", plain(common[5:37])]
    docs = spark.createDataFrame([(d, t, None, None, None) for d, t in enumerate(rows)], SCHEMA)
    found = dc.contaminated(docs, spark.createDataFrame(items, "item_id long, text string")).toPandas()
    assert {(0, 0), (1, 0), (3, 1), (6, 2)} <= set(zip(found["doc_id"], found["item_id"])) <= {(0, 0), (1, 0), (3, 1), (6, 2), (7, 3), (7, 0)}
    best = found[(found["doc_id"] == 0) & (found["item_id"] == 0)]
    assert best["score"].tolist() == [0.475] and found.loc[found["doc_id"] == 3, "score"].tolist() == [1.0]
    assert {x["doc_id"] for x in dc.clean(docs, spark.createDataFrame(items, "item_id long, text string")).collect()} == {2, 4, 5}


def test_benchmark_in_several_blocks_gives_the_same(spark, monkeypatch):
    docs, bench = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "benchmark"))
    once = sorted(map(tuple, dc.contaminated(docs, bench).collect()))
    left = sorted(r["doc_id"] for r in dc.clean(docs, bench).collect())
    monkeypatch.setattr(dc, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(dc, "VOCABULARY", 300)
    assert len(dc.blocks(docs, bench)) > 1
    assert once == sorted(map(tuple, dc.contaminated(docs, bench).collect())) and once
    assert left == sorted(r["doc_id"] for r in dc.clean(docs, bench).collect())
    assert left == sorted({r["doc_id"] for r in docs.collect()} - {x[0] for x in once})
    items = {r["item_id"]: r["text"] for r in bench.collect()}
    texts_ = {r["doc_id"]: r["text"] for r in docs.collect()}
    whole = {(d, i) for d, t in texts_.items() for i, x in items.items() if x in t}
    assert whole <= {(d, i) for d, i, *_ in once}
