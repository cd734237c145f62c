import numbers
import random
import re

import duckdb
import numpy as np
import pandas as pd
import pytest

from outvote.llm.common import ship

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside or add themselves.
CLASHING = ["node", "key", "n_lines", "n_dropped", "n_removed", "size", "taken", "row", "shard", "h1", "score", "kept", "draw", "own_1", "lost", "s"]


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    ship(spark)


def words(text):
    return WORD.findall((text or "").translate(LOW))


def texts(n=60, seed=3):
    """Prose with copies, near copies, repeated lines and junk."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(r.randint(1, 8))) for _ in range(300)]
    make = lambda k: " ".join(r.choice(vocabulary) for _ in range(k))
    header = make(8)
    out = []
    for i in range(n):
        if i % 5 == 4:
            out.append(out[r.randrange(len(out))])
        elif i % 5 == 3:
            w = out[r.randrange(len(out))].split(" ")
            if len(w) > 4:
                w[r.randrange(len(w))] = "changed"
            out.append(" ".join(w))
        else:
            parts = [make(r.randint(1, 40)).capitalize() + r.choice([".", "!", "?"]) for _ in range(r.randint(1, 8))]
            if i % 3 == 0:
                parts.insert(0, header)
            out.append("\n".join(parts) if i % 2 else " ".join(parts))
    return out


def messy_rows():
    """Nulls in any column, empty, blank, short and very long texts, repeated rows and repeated ids."""
    plain = texts()
    rows = [(10 + 3 * i, t, "en", f"src{i % 4}", len(t)) for i, t in enumerate(plain)]
    long = " ".join(f"w{i % 7919}x{i % 13}" for i in range(120_000))
    rows += [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \t\n\x0b\x0c\r ", "en", "a", 7), (4, "Word", "en", "é", 4), (5, "wORD", "en", "é", 4),
        (6, "one two three\nFOUR", None, None, 18), (7, long, "en", "big", len(long)), (8, long + " end", "en", "big", None), (9, "é É ß x y", "de", "Z", 8),
        (None, plain[0], "en", "src0", 3), (None, "nobody has this text but a row without id, nobody at all", "en", None, 3), (10, plain[0], "en", "src0", len(plain[0])),
        (10, plain[0], "en", "src0", len(plain[0])), (13, "the same id with another text than before, as it is", "en", "src1", 51), (900, "#*$%&|<> " * 30, "en", "src2", 270),
        (901, "x" * 200_000, "en", "src2", 200_000), (902, "same line that is long enough\n" * 9, "en", "src2", 270),
    ]
    return rows


@pytest.fixture(scope="session")
def messy(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(messy_rows(), SCHEMA).repartition(4)
    return df.withColumns({c: F.lit(f"clash {c}") for c in CLASHING})


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def by_sql(text, **tables):
    """Rows of a query's SQL twin over frames of the test."""
    con = duckdb.connect()
    for name, (rows, columns) in tables.items():
        con.execute(f"create table {name} ({columns})")
        if rows:
            con.executemany(f"insert into {name} values ({', '.join('?' * len(rows[0]))})", rows)
    return con.execute(text).df()


def same_rows(df, expected):
    got = df.toPandas() if not isinstance(df, pd.DataFrame) else df
    assert sorted(got.columns) == sorted(expected.columns)
    order = sorted(got.columns)

    def one(v):
        if isinstance(v, (bool, np.bool_)):
            return str(bool(v))
        return "-" if pd.isna(v) else str(float(v)) if isinstance(v, numbers.Number) else str(v)

    def plain(f):
        return sorted(tuple(one(v) for v in r) for r in f[order].itertuples(index=False))

    assert plain(got) == plain(expected)
