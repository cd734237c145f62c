"""URL filter: longest-prefix rules as column expressions, and a Bloom filter cascade for listed keys.

The cascade is exact over the key universe it was built for. Level 1 holds the listed keys; level
2 those unlisted keys that level 1 lets pass; level 3 the listed keys that level 2 lets pass; and
so on until nothing passes wrongly. A key is listed if the first level that refuses it is an even
one, or if none refuses it and the number of levels is odd. Keys are dealt to shards by hash; a shard is built inside one task
and its size is bounded by the number of shards, so pages never meet the list in a join.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.staging import stage
from .common import BROADCAST_BYTES, ascii_lower, fresh, without
from .kernels import draw

SHARD_KEYS = 1 << 18


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: behind the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: from there up to
    ``?``, ``#`` or the end. Both are empty for null and for urls without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return ascii_lower(host), path


def rule_match(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """Text and verdict of the longest rule ``(host, path, verdict)`` that fits, else null.

    A rule fits its host and all subdomains if the path starts with the rule's. Meant for some
    hundred rules; of equally long ones the first in code point order wins.
    """
    text, verdict = None, None
    for rule_host, rule_path, decision in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1])):
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(rule_path)
        text = F.when(fits, rule_host + rule_path) if text is None else text.when(fits, rule_host + rule_path)
        verdict = F.when(fits, decision) if verdict is None else verdict.when(fits, decision)
    none = F.lit(None).cast("string")
    return (none, none) if text is None else (text, verdict)


class Bloom:
    """Bits addressed by double hashing of two 64-bit hashes; each level has probes of its own."""

    def __init__(self, level: int, bits: int, probes: int, words: np.ndarray):
        self.level, self.bits, self.probes, self.words = level, bits, probes, words

    @classmethod
    def of(cls, level, h1, h2, rate):
        n = max(1, len(h1))
        bits = max(64, int(np.ceil(1.44 * np.log2(1 / rate) * n)))
        made = cls(level, bits, max(1, round(bits / n * np.log(2))), np.zeros(-(-bits // 64), np.uint64))
        for at in made._spots(h1, h2):
            np.bitwise_or.at(made.words, at >> np.uint64(6), np.uint64(1) << (at & np.uint64(63)))
        return made

    def _spots(self, h1, h2):
        a, b = draw(h1, 2 * self.level), draw(h2, 2 * self.level + 1) | np.uint64(1)
        for k in range(self.probes):
            yield (a + np.uint64(k) * b) % np.uint64(self.bits)

    def passes(self, h1, h2) -> np.ndarray:
        good = np.ones(len(h1), bool)
        for at in self._spots(h1, h2):
            good &= (self.words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return good


def build_levels(h1, h2, listed) -> list[Bloom]:
    """Cascade over one shard's distinct keys."""
    inside, outside = np.flatnonzero(listed), np.flatnonzero(~listed)
    levels = []
    while len(inside):
        rate = 0.5 if levels else min(0.5, max(1e-4, 0.7 * len(inside) / max(1, len(outside))))
        level = Bloom.of(len(levels), h1[inside], h2[inside], rate)
        levels.append(level)
        passed = outside[level.passes(h1[outside], h2[outside])]
        if len(levels) > 200:
            raise ValueError("two keys have equal 128-bit hashes")
        inside, outside = passed, inside
    return levels


def is_listed(levels: list[Bloom], h1, h2) -> np.ndarray:
    out, open_ = np.zeros(len(h1), bool), np.arange(len(h1))
    for k, level in enumerate(levels):
        passed = level.passes(h1[open_], h2[open_])
        out[open_[~passed]] = k % 2 == 1
        open_ = open_[passed]
    out[open_] = len(levels) % 2 == 1
    return out


def _hashes(key: Column):
    """Two 64-bit hashes; the number comes first, as a hash of several columns goes on from that of those before."""
    return F.xxhash64(F.lit(1), key), F.xxhash64(F.lit(2), key)


class Cascade:
    """Built over a frame ``key, listed`` with one row a key."""

    def __init__(self, universe: DataFrame):
        h1, h2 = _hashes(F.col("key"))
        keys = stage(universe.select(h1.alias("h1"), h2.alias("h2"), F.coalesce("listed", F.lit(False)).alias("listed")))
        self.n_shards = max(1, -(-keys.count() // SHARD_KEYS))

        def build(pdf):
            a, b = (pdf[c].to_numpy().view(np.uint64) for c in ("h1", "h2"))
            levels = build_levels(a, b, pdf["listed"].to_numpy(bool))
            rows = [(int(pdf["shard"].iloc[0]), v.level, v.bits, v.probes, v.words.tobytes()) for v in levels]
            return pd.DataFrame(rows, columns=["shard", "level", "bits", "probes", "words"])

        sharded = keys.withColumn("shard", F.pmod("h1", F.lit(self.n_shards)).cast("int"))
        self.levels = stage(sharded.groupBy("shard").applyInPandas(build, "shard int, level int, bits long, probes int, words binary"))

    def mark(self, df: DataFrame, key: Column, name: str = "listed") -> DataFrame:
        """Adds boolean ``name``: whether the row's key, one of the universe, is listed.

        Shards go to the tasks in blocks of at most BROADCAST_BYTES, one map over the rows each, without a shuffle.
        """
        a, b = fresh(df, "cascade_a", "cascade_b")
        h1, h2 = _hashes(key)
        df = df.withColumns({a: h1, b: h2, name: F.lit(False)})
        per_shard = self.levels.groupBy("shard").agg(F.sum(F.length("words")).alias("size"))
        most = per_shard.agg(F.max("size")).first()[0] or 1
        step = max(1, BROADCAST_BYTES // most)
        for low in range(0, self.n_shards, step):
            rows = self.levels.filter((F.col("shard") >= low) & (F.col("shard") < low + step)).collect()
            if not rows:
                continue
            held: dict[int, list] = {}
            for r in sorted(rows, key=lambda r: r["level"]):
                held.setdefault(r["shard"], []).append((r["level"], r["bits"], r["probes"], bytes(r["words"])))
            df = df.mapInArrow(_marker(held, self.n_shards, a, b, name), df.schema)
        return df.drop(a, b)


def _marker(held, n_shards, a, b, name):
    def run(batches):
        shards = {k: [Bloom(lv, bits, probes, np.frombuffer(w, np.uint64)) for lv, bits, probes, w in v] for k, v in held.items()}
        for batch in batches:
            h1 = batch.column(a).to_numpy()
            x, y = h1.view(np.uint64), batch.column(b).to_numpy().view(np.uint64)
            out = batch.column(name).to_numpy(zero_copy_only=False).copy()
            shard = np.mod(h1, n_shards)
            for k, levels in shards.items():
                mine = np.flatnonzero(shard == k)
                out[mine] = is_listed(levels, x[mine], y[mine])
            yield batch.set_column(batch.schema.get_field_index(name), name, pa.array(out))

    return run


def filter_urls(pages: DataFrame, rules, listed_keys) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule``, ``listed`` and ``verdict`` (allow or block).

    The longest fitting rule decides; else a host is blocked if listed. ``listed_keys`` says which hosts of
    the corpus are: a function from a host Column to a boolean Column, or a frame with a column ``key``. The
    universe is every host of ``pages``, the empty one of null or odd urls included.
    Columns of these names are replaced; all others, also repeated rows, stay.
    """
    host, path = host_and_path(F.col("url").cast("string"))
    pages = without(pages, "host", "path", "rule", "listed", "verdict").withColumns({"host": host, "path": path})
    hosts = pages.select(F.col("host").alias("key")).distinct()
    if isinstance(listed_keys, DataFrame):
        marked = hosts.join(listed_keys.select("key").distinct().withColumn("listed", F.lit(True)), "key", "left")
    else:
        marked = hosts.withColumn("listed", listed_keys(F.col("key")))
    rule, decided = rule_match(F.col("host"), F.col("path"), rules)
    out = Cascade(marked).mark(pages, F.col("host"))
    return out.withColumn("rule", rule).withColumn("verdict", F.coalesce(decided, F.when(F.col("listed"), "block").otherwise("allow")))
