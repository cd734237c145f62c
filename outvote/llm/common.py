"""Small helpers shared by the operators of this folder."""

import atexit
import os
import shutil
import tempfile
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_BYTES = 64 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = r"[^\x20\x09-\x0D]+"


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Helper column names that clash with no column of ``df``, whatever its case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name in taken:
            name = f"_{name}"
        taken.add(name)
        out.append(name)
    return out


def without(df: DataFrame, *names: str) -> DataFrame:
    """Drops columns that a result is about to add under the same names."""
    low = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in low])


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z; all other characters stay."""
    return F.translate(text, UPPER, LOWER)


def word_count(text: Column) -> Column:
    """Runs of anything but ASCII white space; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def ship(spark: SparkSession) -> None:
    """Sends this package's code to the executors, once a session, so that tasks can import it anywhere."""
    context = spark.sparkContext
    if getattr(context, "_outvote_shipped", False):
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = tempfile.mkdtemp(prefix="outvote-code-")
    atexit.register(shutil.rmtree, folder, True)
    archive = os.path.join(folder, "outvote-code.zip")
    with zipfile.ZipFile(archive, "w") as made:
        for path, _, names in os.walk(top):
            for name in sorted(names):
                if name.endswith(".py"):
                    file = os.path.join(path, name)
                    made.write(file, os.path.relpath(file, os.path.dirname(top)))
    context.addPyFile(archive)
    context._outvote_shipped = True


def spread_join(rows: DataFrame, facts: DataFrame, key: str, n: str, hot_keys: int = 100_000) -> DataFrame:
    """Inner join of rows with the facts of their key; hot keys go by broadcast, so that no task gets all of one.

    ``facts`` must be staged, with one row a key and in ``n`` its number of rows. Keys with more than a
    ``hot_keys``-th of all rows (10 000 at least) are hot, so there are at most ``hot_keys`` of them.
    """
    total = facts.agg(F.sum(n)).first()[0] or 0
    hot = F.col(n) > max(10_000, total // hot_keys)
    if not facts.filter(hot).limit(1).count():
        return rows.join(facts, key)
    found, rest = F.broadcast(facts.filter(hot)), facts.filter(~hot)
    cold = rows.join(F.broadcast(facts.filter(hot).select(key)), key, "left_anti")
    return rows.join(found, key).unionByName(cold.join(rest, key))
