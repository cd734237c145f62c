"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Words are split at ASCII white space and punctuation, A-Z lower-cased. An item's seeds are those of its
n-grams that chance would hardly put into the corpus: the product of the corpus frequencies of their
words is at most ``RARE``; an item with fewer than ``SEEDS`` such n-grams takes its rarest ones.
Frequencies of single words say so whatever the number of copies, so an item that was copied
into a third of all documents keeps its seeds. Texts are looked through for seeds in one map; where one
is found, the words around it are aligned with the whole item. Long items have seeds in each of their stretches, as
a part of them may stand alone; very short items are looked for word by word. The benchmark is the
stated query set: it goes to the tasks in blocks of bounded size, each a broadcast variable that the driver keeps on disk,
and one map over the texts takes one block after the other. Nothing is shuffled but word counts, which one
scan gives for all blocks, and matches. A Python worker holds the whole benchmark, some 8 bytes a word and 24 a seed.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import CONTINUED, SPACE, Words, slices, utf8, windows

WIDTH, SEEDS, RARE = 3, 12, 1e-8
LEAST_WORDS = 5
#: An alignment worth so many equal words is a match however long the item, and seeds of each stretch of so many n-grams that any such part holds a whole one.
LONG_WORDS = 30
STRETCH, STRETCH_SEEDS = (LONG_WORDS - WIDTH + 2) // 2, 3
BLOCK_BYTES = 4 << 20
#: Most different words of the benchmark that one scan of the corpus counts (64 MB of hashes).
VOCABULARY = 8 << 20
_BREAKS = SPACE.copy()
_BREAKS[[c for c in range(33, 127) if not chr(c).isalnum()]] = True


@dataclass
class Block:
    """Part of the benchmark: item words, seeds sorted by hash with their item and place, and for each length of short items their sorted hashes and items."""

    ids: list
    words: np.ndarray
    at: np.ndarray
    seeds: np.ndarray
    item: np.ndarray
    place: np.ndarray
    short: dict

    def of(self, i):
        return self.words[self.at[i] : self.at[i + 1]]


def _word_counts(docs: DataFrame, vocabulary: np.ndarray):
    """How often the corpus has each word of the sorted vocabulary, and how many words it has."""
    n = len(vocabulary)

    def run(batches):
        total = np.zeros(n + 1, np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(part.column("text"), True, _BREAKS).hashes
                spot = np.minimum(np.searchsorted(vocabulary, words), n - 1)
                total[:n] += np.bincount(spot[vocabulary[spot] == words], minlength=n)
                total[n] += len(words)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["word", "n"])

    found = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "word long, n long")
    rows = found.groupBy("word").agg(F.sum("n").alias("n")).toPandas()  # one row a word of the vocabulary
    out = np.zeros(n + 1, np.int64)
    out[rows["word"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return out[:n], int(out[n])


def _vocabulary(items: DataFrame) -> np.ndarray:
    """Sorted hashes of the different words of all items."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                found = np.unique(Words(part.column("text"), True, _BREAKS).hashes)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64))], names=["word"])

    rows = items.select("text").mapInArrow(run, "word long").distinct().toPandas()
    return np.sort(rows["word"].to_numpy(np.int64).view(np.uint64))


def blocks(docs: DataFrame, benchmark: DataFrame) -> list[Broadcast]:
    """The benchmark (``item_id, text``) in broadcast blocks of about BLOCK_BYTES, with seeds by the word counts of ``docs``."""
    context = docs.sparkSession.sparkContext
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(1, -(-size // BLOCK_BYTES))
    vocabulary, total = _vocabulary(items), 0
    counts = np.zeros(len(vocabulary), np.int64)
    for k in range(0, len(vocabulary), VOCABULARY):
        counts[k : k + VOCABULARY], total = _word_counts(docs, vocabulary[k : k + VOCABULARY])
    out = []
    for k in range(n_blocks):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == k).orderBy("item_id", "text").collect()
        made = Words(pa.array([r["text"] for r in rows], pa.string()), True, _BREAKS)
        if not len(made.hashes):
            continue
        code = np.searchsorted(vocabulary, made.hashes)
        rarity = np.log((counts + 0.5) / (total + 1))[code]
        hashes, item, place, short = [], [], [], {}
        for i in range(len(rows)):
            own = made.hashes[made.at[i] : made.at[i + 1]]
            if len(own) < LEAST_WORDS:
                if len(own):
                    short.setdefault(len(own), []).append((int(windows(own, len(own))[0]), i))
                continue
            grams = windows(own, WIDTH)
            score = np.convolve(rarity[made.at[i] : made.at[i + 1]], np.ones(WIDTH), "valid")
            chosen = np.argsort(score, kind="stable")
            chosen = chosen[: max(SEEDS, int((score <= np.log(RARE)).sum()))]
            if len(own) > 2 * LONG_WORDS:
                parts = [k + np.argsort(score[k : k + STRETCH], kind="stable")[:STRETCH_SEEDS] for k in range(0, len(score), STRETCH)]
                chosen = np.union1d(chosen, np.concatenate(parts))
            hashes.append(grams[chosen])
            item.append(np.full(len(chosen), i))
            place.append(chosen)
        if hashes or short:
            hashes, item, place = (np.concatenate([np.zeros(0, t), *x]) for t, x in ((np.uint64, hashes), (np.int64, item), (np.int64, place)))
            order = np.argsort(hashes, kind="stable")
            made = Block([r["item_id"] for r in rows], made.hashes, made.at, hashes[order], item[order], place[order], _sorted(short))
            out.append(context.broadcast(made))
    return out


def _sorted(short: dict) -> dict:
    out = {}
    for n, found in short.items():
        found.sort()
        out[n] = np.array([h for h, _ in found], np.uint64), [i for _, i in found]
    return out


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Best local alignment (2 for equal words, -1 for others, -1 for a gap): score, and where it ends in ``text``."""
    j = np.arange(len(text) + 1)
    row, best, end = np.zeros(len(text) + 1, np.int64), 0, 0
    for word in item:
        step = np.where(text == word, 2, -1)
        new = np.maximum(row - 1, 0)
        new[1:] = np.maximum(new[1:], row[:-1] + step)
        row = np.maximum.accumulate(new + j) - j  # gaps in the item
        k = int(row.argmax())
        if row[k] > best:
            best, end = int(row[k]), k
    return best, end


def _found(item: np.ndarray, text: np.ndarray, low: int, high: int, least: float):
    """Yields ``score, begin, end`` of disjoint alignments in ``text[low:high]`` that reach ``least`` of a full match or LONG_WORDS equal words, net of edits."""
    need = min(least * len(item), LONG_WORDS)
    todo = [(low, high)]
    while todo:
        a, b = todo.pop()
        part = text[a:b]
        if np.isin(part, item).sum() < need:  # the score takes that many equal words
            continue
        score, end = align(item, part)
        if score < 2 * need:
            continue
        _, back = align(item[::-1], part[:end][::-1])
        yield score / (2 * len(item)), a + end - back, a + end
        todo += [(a, a + end - back), (a + end, b)]


def _short_matches(words: Words, block: Block):
    """As _matches, of the items of fewer than LEAST_WORDS words: where the text has just their words, one after the other."""
    hashes, at = words.hashes, words.at
    for n, (wanted, items) in block.short.items():
        grams = windows(hashes, n)
        if not len(grams):
            continue
        first = np.searchsorted(wanted, grams, "left")
        hits = np.flatnonzero(wanted[np.minimum(first, len(wanted) - 1)] == grams)
        owner = np.searchsorted(at, hits, "right") - 1
        last = np.searchsorted(wanted, grams[hits], "right")
        free: dict[tuple, int] = {}  # passages of an item are disjoint
        for pos, own, x, y in zip(hits.tolist(), owner.tolist(), first[hits].tolist(), last.tolist()):
            if pos + n > at[own + 1]:
                continue
            for i in items[x:y]:
                if pos >= free.get((own, i), 0) and np.array_equal(block.of(i), hashes[pos : pos + n]):
                    free[(own, i)] = pos + n
                    yield own, i, 1.0, pos, pos + n


def _matches(words: Words, block: Block, least: float):
    """``text number, item number, score, begin, end`` (words of the text) of all matches in a batch."""
    hashes, at = words.hashes, words.at
    yield from _short_matches(words, block)
    grams = windows(hashes, WIDTH)
    if not len(grams) or not len(block.seeds):
        return
    spot = np.minimum(np.searchsorted(block.seeds, grams), len(block.seeds) - 1)
    hits = np.flatnonzero(block.seeds[spot] == grams)
    if not len(hits):
        return
    first, last = np.searchsorted(block.seeds, grams[hits], "left"), np.searchsorted(block.seeds, grams[hits], "right")
    owner = np.searchsorted(at, hits, "right") - 1
    ranges: dict[tuple, list] = {}
    for pos, own, x, y in zip(hits.tolist(), owner.tolist(), first.tolist(), last.tolist()):
        if pos + WIDTH > at[own + 1]:
            continue
        for s in range(x, y):
            i = int(block.item[s])
            n = int(block.at[i + 1] - block.at[i])
            begin, slack = pos - int(block.place[s]), n // 2 + 2
            span = [max(int(at[own]), begin - slack), min(int(at[own + 1]), begin + n + slack)]
            ranges.setdefault((own, i), []).append(span)
    for (own, i), spans in ranges.items():
        spans.sort()
        merged = [spans[0]]
        for a, b in spans[1:]:
            if a <= merged[-1][1]:
                merged[-1][1] = max(b, merged[-1][1])
            else:
                merged.append([a, b])
        for a, b in merged:
            for score, begin, end in _found(block.of(i), hashes, a, b, least):
                yield own, i, score, begin, end


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = 0.5) -> DataFrame:
    """``doc_id, item_id, score, begin, end``: each passage of ``docs`` that aligns with an item.

    ``score`` is the alignment's share of a full match, ``least`` at least (0.5: three words in four equal, others
    replaced one by one: 0.625), or less for 30 equal words, net of edits, of a longer item; ``begin`` and ``end`` are code points of the text. All columns are numbers. Null and
    empty texts have none; items of fewer than 5 words match where the text has exactly their words in
    a row, so an item of one common word matches wherever it stands; equal items and repeated
    rows count once each, with their ids, null included.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = blocks(docs, benchmark)
    return rows.mapInArrow(_match_map(parts, least), "doc_id long, item_id long, score double, begin long, `end` long")


def _match_map(parts, least):
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(part.column("text"), True, _BREAKS)
                found = [(own, block.ids[i], *rest) for block in (p.value for p in parts) for own, i, *rest in _matches(words, block, least)]
                ids = part.column("doc_id").to_pylist()
                data, offsets = utf8(part.column("text"))
                place = []
                for own, _, _, a, b in found:
                    text = ~CONTINUED[data[offsets[own] : words.ends[b - 1]]]
                    place.append((int(text[: words.starts[a] - offsets[own]].sum()), int(text.sum())))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([ids[f[0]] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64()),
                        pa.array([f[2] for f in found], pa.float64()), pa.array([p[0] for p in place], pa.int64()), pa.array([p[1] for p in place], pa.int64()),
                    ],
                    names=["doc_id", "item_id", "score", "begin", "end"],
                )

    return run


def clean(docs: DataFrame, benchmark: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, whose text holds no passage of the benchmark."""
    return docs.mapInArrow(_clean_map(blocks(docs, benchmark), least), docs.schema)


def _clean_map(parts, least):
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(part.column("text"), True, _BREAKS)
                hit = {m[0] for p in parts for m in _matches(words, p.value, least)}
                yield part.filter(pa.array([i not in hit for i in range(part.num_rows)], pa.bool_()))

    return run
