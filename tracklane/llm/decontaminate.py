"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Words are runs of ASCII letters, digits and all beyond ASCII, in lower case, so edits of
punctuation or case do not hide a copy. The n-grams of the test items are counted over all
training documents; each item keeps the rarest ``KEEP`` share of its own n-grams as
seeds. The share is per item: an item that is copied everywhere keeps its seeds.

Documents stream past a block of at most ``BLOCK`` items (sorted seeds and the items'
words, broadcast). Where seeds of an item stand, the surrounding words are aligned with the item;
an alignment that reaches ``SCORE`` of the best possible score is a match.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklane.llm.common import MARKS, Scratch, Words, grams, pieces, row_key, ship, table

N = 3  # words of a seed
KEEP = 0.75
BLOCK = 4096  # items of a block
SCORE = 0.6
MATCH, MISMATCH, GAP = 2, -1, -1


class Items:
    """A block of test items: words, n-grams and where they stand."""

    def __init__(self, rows: list[tuple]):
        self.ids = [r[0] for r in rows]
        words = Words(pa.array([r[1] for r in rows], pa.string()), lower=False, apart=MARKS)
        self.words = [words.hashes[a:b] for a, b in zip(words.first, words.first[1:])]
        # an item shorter than a seed is looked for by its first word
        hashes = [grams(w, N) if len(w) >= N else w[:1] for w in self.words]
        self.gram = np.concatenate([*hashes, np.zeros(0, np.uint64)])
        self.item = np.repeat(np.arange(len(rows)), [len(h) for h in hashes])
        self.place = np.concatenate([*(np.arange(len(h)) for h in hashes), np.zeros(0, int)]).astype(np.int64)
        self.short = any(0 < len(w) < N for w in self.words)
        self._sort()

    def _sort(self) -> None:
        order = np.argsort(self.gram, kind="stable")
        self.gram, self.item, self.place = self.gram[order], self.item[order], self.place[order]

    def keep_rare(self, counts: dict[int, int], share: float) -> None:
        """Keep the rarest share of each item's n-grams, at least one; ties by position."""
        count = np.array([counts.get(int(g), 0) for g in self.gram], dtype=np.int64)
        order = np.lexsort((self.place, count, self.item))
        size = np.bincount(self.item, minlength=len(self.ids))
        first = np.concatenate([[0], np.cumsum(size)])
        rank = np.arange(len(order)) - first[self.item[order]]
        kept = order[rank < np.maximum(1, np.ceil(share * size))[self.item[order]]]
        self.gram, self.item, self.place = self.gram[kept], self.item[kept], self.place[kept]
        self._sort()

    def hits(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(word position, n-gram) of all n-grams of the texts that are an item's."""
        found = []
        for n in (N, 1) if self.short else (N,):
            hashes = grams(words.hashes, n) if n > 1 else words.hashes
            at = np.searchsorted(self.gram, hashes)
            at[at == len(self.gram)] = 0
            place = np.flatnonzero(self.gram[at] == hashes) if len(self.gram) else np.zeros(0, int)
            text = np.searchsorted(words.first, place, side="right") - 1
            place = place[place + n <= words.first[text + 1]]
            found.append((place, hashes[place]))
        return tuple(np.concatenate(x) for x in zip(*found))


def align(item: np.ndarray, span: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment of two word sequences: (score, first word, end) in ``span``.

    Row by row over ``span``; the horizontal gaps of a row are one running maximum. Of equal
    scores the first end counts.
    """
    columns = np.arange(len(item) + 1) * -GAP
    row, begun = np.zeros(len(item) + 1, np.int64), np.zeros(len(item) + 1, np.int64)
    best = (0, 0, 0)
    for i, word in enumerate(span):
        diagonal = row[:-1] + np.where(item == word, MATCH, MISMATCH)
        up = row + GAP
        cell, start = up.copy(), begun.copy()
        better = diagonal >= cell[1:]
        cell[1:][better], start[1:][better] = diagonal[better], np.where(row[:-1] > 0, begun[:-1], i)[better]
        fresh = cell <= 0
        cell[fresh], start[fresh] = 0, i + 1
        lifted = cell + columns
        top = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted == top, np.arange(len(top)), 0))
        row, begun = top - columns, start[source]
        j = int(row.argmax())
        if row[j] > best[0]:
            best = (int(row[j]), int(begun[j]), i + 1)
    return best


def _regions(places: np.ndarray, item_places: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Word ranges that a match with these seeds may cover; ranges that touch are one."""
    slack = size // 2 + 1
    begin = places - item_places - slack
    end = places - item_places + size + slack
    order = np.argsort(begin, kind="stable")
    a, b = begin[order[0]], end[order[0]]
    for k in order[1:]:
        if begin[k] > b:
            yield int(a), int(b)
            a = begin[k]
        b = max(b, end[k])
    yield int(a), int(b)


STEP = 4096


def matches(words: Words, items: Items, threshold: float) -> Iterator[tuple]:
    """(text, item, score, first word, end): the best match of each item in each text."""
    place, gram = items.hits(words)
    if not len(place):
        return
    low, high = np.searchsorted(items.gram, gram), np.searchsorted(items.gram, gram, side="right")
    spread = np.repeat(np.arange(len(place)), high - low)
    entry = np.arange(len(spread)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + low[spread]
    text = np.searchsorted(words.first, place[spread], side="right") - 1
    order = np.lexsort((place[spread], items.item[entry], text))
    text, item, at, inside = text[order], items.item[entry][order], place[spread][order], items.place[entry][order]
    cuts = np.flatnonzero(np.diff(text) | np.diff(item)) + 1
    for group in np.split(np.arange(len(text)), cuts):
        t, k = int(text[group[0]]), int(item[group[0]])
        target, best = items.words[k], (0, 0, 0)
        first, end = int(words.first[t]), int(words.first[t + 1])
        for a, b in _regions(at[group], inside[group], len(target)):
            a, b = max(a, first), min(b, end)
            # a long region (an item repeated over and over) goes in overlapping pieces
            for c in range(a, b, STEP):
                score, s, e = align(target, words.hashes[c : min(c + STEP + 2 * len(target), b)])
                if score > best[0]:
                    best = (score, c + s - first, c + e - first)
        score = best[0] / (MATCH * len(target))
        if score >= threshold:
            yield t, k, round(score, 6), best[1], best[2]


RESULT = "item long, score double, first_word long, end_word long"


def _blocks(benchmark: DataFrame, item: str, text: str) -> Iterator[list[tuple]]:
    rows: list[tuple] = []
    for r in benchmark.select(item, F.lower(text).alias(text)).distinct().orderBy(item, text).toLocalIterator():
        rows.append((r[0], r[1]))
        if len(rows) == BLOCK:
            yield rows
            rows = []
    if rows:
        yield rows


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    threshold: float = SCORE,
) -> DataFrame:
    """One row per document and test item that match: key, item, score, first_word, end_word.

    The score is the alignment's, divided by that of a verbatim copy. Positions count the
    document's words from 0, the end is exclusive. Null texts and empty texts match nothing.
    Rows that repeat a key are searched one by one and their best match is given.
    The test items pass through the driver in blocks of bounded size.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "decontaminate")
    ship(spark)
    source = docs.select(F.col(key).alias("key"), F.lower(text).alias("text"))
    schema = f"key {dict(source.dtypes)['key']}, {RESULT}"
    out = None
    for rows in _blocks(benchmark, item, "text"):
        items = Items(rows)
        sent = spark.sparkContext.broadcast(items)

        def count(batches, sent=sent):
            for batch in pieces(batches):
                words = Words(batch["text"], lower=False, apart=MARKS)
                place, gram = sent.value.hits(words)
                if len(place):
                    pairs = np.unique(np.stack([np.searchsorted(words.first, place, side="right").astype(np.uint64), gram]), axis=1)
                    seed, n = np.unique(pairs[1], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(seed.view(np.int64)), pa.array(n.astype(np.int64))], ["gram", "n"])

        counted = source.select("text").mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
        counts = {r["gram"] & (2**64 - 1): r["n"] for r in counted.collect()}  # at most the n-grams of a block
        items.keep_rare(counts, KEEP)
        rare = spark.sparkContext.broadcast(items)

        def search(batches, rare=rare):
            for batch in pieces(batches):
                words = Words(batch["text"], lower=False, apart=MARKS)
                found = list(matches(words, rare.value, threshold))
                if found:
                    t, k, *rest = (list(x) for x in zip(*found))
                    ids = pa.array([rare.value.ids[x] for x in k], pa.int64())
                    columns = [batch["key"].take(pa.array(t)), ids, *(pa.array(x) for x in rest)]
                    yield pa.RecordBatch.from_arrays(columns, ["key", "item", "score", "first_word", "end_word"])

        found = scratch.store(source.mapInArrow(search, schema))
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], schema)
    best = F.max(F.struct("score", -F.col("first_word"), -F.col("end_word"))).alias("best")
    best_of = out.groupBy("key", "item").agg(best).withColumnsRenamed({"key": key, "item": item})
    return best_of.select(
        key, item, F.col("best.score").alias("score"), (-F.col("best.col2")).alias("first_word"), (-F.col("best.col3")).alias("end_word")
    )


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that match no test item, with their own columns; rows that share an id, or have none, are judged one by one."""
    rows = docs.select(F.struct(*docs.columns).alias("_row"), row_key().alias("_key"), F.col("text").alias("_text"))
    found = contaminated(rows, table(spark, sf_dir, "benchmark"), "_key", "_text")
    return rows.drop("_text").join(found.select("_key").distinct(), "_key", "left_anti").select("_row.*")


QUERIES = {"op2_decontaminate": op2_decontaminate}

SQL: dict[str, str] = {}
