"""Periodic run detection: maximal repetitions of the words of a text.

A run is a stretch of words that repeats with some period, cannot be extended, and is at
least ``LEAST`` words and two periods long. By the runs theorem each run holds a Lyndon word of
its period's length that is the longest Lyndon word from some place, under the order
of the words or under its reverse. So:

1. Stretches that can hold a run are found first. In a run of ``LEAST`` words and two periods
   each word is covered by six words in a row that stand elsewhere in the text too (its six next or
   earlier neighbours recur one period away), hence a run never leaves such a stretch.
   Only a superset is needed here, so six words are compared by a hash.
2. The first phase of Baier's suffix sorting is run on a stretch under both orders. It refines
   groups of suffixes, highest group first: the nearest earlier suffixes of a lower group gain the
   context of the group being finished, as often as they are pointed at. The context of a suffix is its
   longest Lyndon prefix, so the lengths the groups end with are the Lyndon array; no suffix array
   is built, and the second phase is not needed.
3. Each (place, length) of the two arrays is a candidate root. It is extended to both sides while
   words one period apart are equal. Roots of one period inside a stretch that has been extended
   belong to the same run and are skipped.

Work follows the words in stretches that recur inside one text; other texts cost one pass.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklane.llm.common import mix, pieces, ship, table, text_of

LEAST = 12  # words of a run
GRAM = LEAST // 2
CHUNK = 64  # words compared at first when extending


def lyndon_array(ranks: np.ndarray) -> np.ndarray:
    """Length of the longest Lyndon word from each place: the group lengths phase one ends with."""
    n = len(ranks)
    order = np.argsort(ranks, kind="stable")
    sorted_ranks = ranks[order]
    first = np.flatnonzero(np.r_[True, sorted_ranks[1:] != sorted_ranks[:-1]])
    start_of = np.repeat(first, np.diff(np.r_[first, n]))
    group = np.empty(n, dtype=np.int64)  # of a place: where its group starts in ``at``
    group[order] = start_of
    slot = np.empty(n, dtype=np.int64)
    slot[order] = np.arange(n)
    at, slot, group = order.tolist(), slot.tolist(), group.tolist()
    size = dict(zip(first.tolist(), np.diff(np.r_[first, n]).tolist()))
    length = dict.fromkeys(size, 1)
    before = [-1] * n  # nearest earlier place of a lower group, for finished places
    done = n
    while done:
        g = group[at[done - 1]]
        members = at[g:done]
        if len(members) > 1:
            members.sort()
        pointed: dict[int, int] = {}
        for s in members:
            j = s - 1
            while j >= 0 and group[j] >= g:
                j = before[j]
            before[s] = j
            if j >= 0:
                pointed[j] = pointed.get(j, 0) + 1
        done = g
        if not pointed:
            continue
        gain = length[g]
        for times in sorted(set(pointed.values()), reverse=True):
            moved: dict[int, int] = {}
            grown = [p for p, c in pointed.items() if c == times]
            for p in grown:  # to the end of its group
                own = group[p]
                k = moved.get(own, 0) + 1
                moved[own] = k
                last = own + size[own] - k
                other, here = at[last], slot[p]
                at[last], at[here] = p, other
                slot[p], slot[other] = last, here
            for own, k in moved.items():  # the moved ones are a group of their own, just above
                new = own + size[own] - k
                extended = length[own] + times * gain
                size[own] -= k
                size[new], length[new] = k, extended
                for p in at[new : new + k]:
                    group[p] = new
    return np.fromiter((length[g] for g in group), dtype=np.int64, count=n)


def _agreeing(a: np.ndarray, i: int, p: int) -> int:
    """How many words from ``i`` on equal the word ``p`` later."""
    n, total, step = len(a), 0, CHUNK
    while i + p < n:
        width = min(step, n - i - p)
        differ = a[i : i + width] != a[i + p : i + p + width]
        k = int(differ.argmax())
        if differ[k]:
            return total + k
        total, i, step = total + width, i + width, step * 2
    return total


def runs_of(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of one stretch, by start and period."""
    n = len(ids)
    found = set()
    backwards = ids[::-1]
    roots = [(np.arange(n), lyndon_array(ids)), (np.arange(n), lyndon_array(ids.max() - ids))]
    i, p = (np.concatenate(x) for x in zip(*roots))
    possible = i + p <= n
    i, p = i[possible], p[possible]
    # a root of a run is followed or preceded by a word that recurs one period away
    ends = i + p == n
    follows = ~ends & (ids[i] == ids[np.where(ends, 0, i + p)])
    precedes = (i > 0) & (ids[i - 1] == ids[i + p - 1])
    i, p = i[follows | precedes], p[follows | precedes]
    order = np.lexsort((i, p))
    i, p = i[order].tolist(), p[order].tolist()
    k = 0
    while k < len(i):
        place, period = i[k], p[k]
        right = _agreeing(ids, place, period)
        left = _agreeing(backwards, n - place - period, period)  # from the word before, backwards
        start, stop = place - left, place + right  # words from start to stop equal those a period later
        if stop - start + period >= max(LEAST, 2 * period):
            found.add((start, stop - start + period, period))
        k += 1
        if k < len(i) and p[k] == period and i[k] <= stop:
            k = bisect_right(i, stop, k, bisect_right(p, period, k))
    return sorted(found, key=lambda r: (r[0], r[2]))


def stretches(ids: np.ndarray) -> list[tuple[int, int]]:
    """Maximal stretches of words covered by ``GRAM`` words in a row that stand elsewhere in the text too."""
    m = len(ids) - GRAM + 1
    if len(ids) < LEAST:
        return []
    spread = mix(ids.astype(np.uint64) + np.uint64(1))
    grams = np.zeros(m, dtype=np.uint64)
    for k in range(GRAM):
        grams = mix(grams + spread[k : k + m])
    order = np.argsort(grams)
    same = grams[order][1:] == grams[order][:-1]
    again = np.zeros(m, dtype=bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    edges = np.zeros(len(ids) + 1, dtype=np.int64)
    places = np.flatnonzero(again)
    np.add.at(edges, places, 1)
    np.add.at(edges, places + GRAM, -1)
    covered = np.diff(np.r_[0, np.cumsum(edges[:-1]) > 0, 0].astype(np.int8))
    return [(int(a), int(b)) for a, b in zip(np.flatnonzero(covered == 1), np.flatnonzero(covered == -1)) if b - a >= LEAST]


def text_runs(words: list[bytes]) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a text, by start and period."""
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), dtype=np.int64, count=len(words))
    out = []
    for a, b in stretches(ids):
        part = np.unique(ids[a:b], return_inverse=True)[1]
        out += [(a + start, length, period) for start, length, period in runs_of(part)]
    return out


def kept_words(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run contains after its first period."""
    if not runs:
        return words
    edges = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    return [w for w, drop in zip(words, (np.cumsum(edges[:-1]) > 0).tolist()) if not drop]


RUNS = "array<struct<start:long,length:long,period:long>>"


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: key, ``runs`` by start and period, ``collapsed``, the words each run's first period leaves.

    Words are what blanks, tabs and line ends part. A null or empty text has no runs and an empty
    ``collapsed``. Rows that repeat key or text each get their own row; a null key stays null. Other
    columns of ``docs`` are not looked at. A text is handled whole, in one task.
    """
    ship(docs.sparkSession)

    def detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            found, left = [], []
            for value in batch["text"].cast(pa.binary()):
                words = value.as_py().split()
                runs = text_runs(words)
                found.append([{"start": s, "length": n, "period": p} for s, n, p in runs])
                left.append(b" ".join(kept_words(words, runs)))
            fields = [("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]
            columns = [batch["key"], pa.array(found, pa.list_(pa.struct(fields))), pa.array(left, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["key", "runs", "collapsed"])

    kind = dict(docs.dtypes)[key]
    rows = docs.select(F.col(key).alias("key"), text_of(text).alias("text"))
    return rows.mapInArrow(detect, f"key {kind}, runs {RUNS}, collapsed string").withColumnRenamed("key", key)


def repeated(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text): a tenth of the texts, as the crc32 of the key says, made periodic from some word on.

    Texts without words, and those of a null key, stay as they are.
    """
    h = F.crc32(F.col("key").cast("string").cast("binary"))
    rows = docs.select(F.col(key).alias("key"), text_of(text).alias("text")).withColumn("g", F.when(h % 10 == 0, F.floor(h / 10)))
    words = F.when(F.col("g").isNotNull(), F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    rows = rows.withColumn("words", words).withColumn("n", F.size("words"))
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    rows = rows.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    place = lambda i: F.when(i >= F.col("a"), F.col("a") + (i - F.col("a")) % F.col("p")).otherwise(i)
    made = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.get("words", place(i).cast("int")))
    return rows.select(
        F.col("key").alias(key), F.when(F.col("n") > 0, F.array_join(made, " ")).otherwise(F.col("text")).alias(text)
    )


def _sha256(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = repeated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    runs = F.col("runs")
    best = F.array_max(F.transform(runs, lambda r: F.struct(r["length"], (-r["start"]).alias("a"), (-r["period"]).alias("b"))))
    lines = F.array_join(F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return periodic_runs(docs).select(
        "doc_id", F.size(runs).cast("long").alias("n_runs"), best.alias("best"), lines.alias("lines"), "collapsed"
    ).select(
        "doc_id",
        "n_runs",
        (-F.col("best.a")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.b")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.b")).alias("exponent_milli"),
        _sha256(F.col("lines")).alias("runs_sha256"),
        _sha256(F.col("collapsed")).alias("collapsed_sha256"),
    )


QUERIES = {"op13_runs": op13_runs}

SQL: dict[str, str] = {}
