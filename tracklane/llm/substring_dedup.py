"""Substring deduplication: suffix automata of reference shards and matching statistics.

A window is ``WINDOW`` consecutive words. Sending every automaton past every document would
cost documents times shards, so shards are routed: the anchor of a window is the smallest
hash among its ``GRAM``-word runs, equal windows have equal anchors, and only passages under an
anchor that occurs twice or more are compared. A *unit* is a stretch of consecutive windows under one anchor.

* An anchor whose units are all the same text: every window of it is repeated.
* Otherwise the distinct units go to reference shards by anchor. Each shard builds suffix
  automata with the number of places of every state and streams its units through
  them; where the matching statistic reaches ``WINDOW`` in a state with two places or more, the
  window is repeated.
* An anchor with more than ``CROWDED`` distinct units (the edges of a passage in very many documents)
  would make a shard large; its windows are counted one by one instead, combined before
  the shuffle.

Texts travel once, those with a repeated anchor twice. A row is named by a 64-bit
hash of its id and text.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklane.llm.common import Scratch, Words, collapsed, grams, pieces, ship, spans, table, text_of

WINDOW = 35
GRAM = 8
LONGEST = 56  # windows of a unit; a bit each
CROWDED = 2048
SHARD_WORDS = 50_000  # of an automaton, unless one anchor has more


class Units:
    """The units of a batch of texts: anchor, first window, windows, anchor places; word positions are global."""

    def __init__(self, words: Words, window: int = WINDOW):
        gram = min(GRAM, window)
        across = window - gram + 1
        hashes = grams(words.hashes, gram)
        text = words.text_index()
        n = max(0, len(words.hashes) - window + 1)
        starts = np.flatnonzero(np.arange(n) + window <= words.first[1:][text[:n]]) if n else np.zeros(0, np.int64)
        # the smallest of `across` grams: leading bits of the hash, then the leftmost place
        key = (hashes & ~np.uint64(2**30 - 1)) | np.arange(len(hashes), dtype=np.uint64)
        width = 1
        while 2 * width <= across:
            key = np.minimum(key[: len(key) - width], key[width:])
            width *= 2
        if across > width and len(key):
            key = np.minimum(key[: len(key) - (across - width)], key[across - width :])
        place = (key[starts] & np.uint64(2**30 - 1)).astype(np.int64)
        anchor = hashes[place]
        new = np.ones(len(starts), dtype=bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1) | (text[starts[1:]] != text[starts[:-1]])
        run = np.flatnonzero(new)
        inside = np.arange(len(starts)) - np.repeat(run, np.diff(np.append(run, len(starts))))
        begin = np.flatnonzero(inside % LONGEST == 0)
        size = np.diff(np.append(begin, len(starts)))
        moved = np.zeros(len(starts), dtype=np.int64)
        moved[1:] = place[1:] != place[:-1]
        changes = np.cumsum(moved)
        self.anchor, self.first, self.windows = anchor[begin], starts[begin], size
        self.places = changes[begin + size - 1] - changes[begin] + 1 if len(begin) else size
        self.text = text[self.first] if len(begin) else np.zeros(0, np.int64)
        self.content = spans(words.hashes, self.first, self.first + size + window - 1)


class Automaton:
    """Suffix automaton of several word sequences, with the number of places of every state."""

    def __init__(self):
        self.next, self.link, self.length, self.places = [{}], [-1], [0], [0]

    def add(self, words: list[int], times: int) -> None:
        last = 0
        for w in words:
            last = self._extend(last, w)
            self.places[last] += times

    def _extend(self, last: int, w: int) -> int:
        step, link, length = self.next, self.link, self.length
        at = step[last].get(w)
        if at is not None:  # the sequence so far is known already
            if length[at] == length[last] + 1:
                return at
            return self._split(last, at, w)
        state = len(step)
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        self.places.append(0)
        p = last
        while p >= 0 and w not in step[p]:
            step[p][w] = state
            p = link[p]
        if p >= 0:
            q = step[p][w]
            link[state] = q if length[q] == length[p] + 1 else self._split(p, q, w)
        return state

    def _split(self, p: int, q: int, w: int) -> int:
        copy = len(self.next)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        self.places.append(0)
        self.link[q] = copy
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def count(self) -> None:
        """Give every state the places of the states whose suffix it is."""
        for state in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            self.places[self.link[state]] += self.places[state]

    def repeated(self, words: list[int], window: int) -> int:
        """Bit i: the ``window`` words from i on stand in two places or more."""
        step, link, length = self.next, self.link, self.length
        state, matched, bits = 0, 0, 0
        for i, w in enumerate(words):
            while state and w not in step[state]:
                state = link[state]
                matched = length[state]
            if w in step[state]:
                state, matched = step[state][w], matched + 1
            while length[link[state]] >= window:  # only the last ``window`` words count
                state = link[state]
            matched = min(matched, length[state])
            if matched >= window and self.places[state] > 1:
                bits |= 1 << (i - window + 1)
        return bits


def _verdicts(window: int):
    """Rows (anchor, content, times, words), sorted by anchor, to (anchor, content, bits)."""

    def judge(rows):
        automaton = Automaton()
        for _, _, times, words in rows:
            automaton.add(words, times)
        automaton.count()
        bits = [automaton.repeated(words, window) for *_, words in rows]
        longs = [pa.array([r[k] for r in rows], pa.int64()) for k in (0, 1)]
        return pa.RecordBatch.from_arrays([*longs, pa.array(bits, pa.int64())], ["anchor", "content", "bits"])

    def run(batches):
        rows, size = [], 0  # whole anchors of one shard, and the anchor that is not over yet
        for batch in batches:
            for row in zip(*(batch[c].to_pylist() for c in ("anchor", "content", "times", "words"))):
                if size >= SHARD_WORDS and row[0] != rows[-1][0]:
                    yield judge(rows)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[3])
        if rows:
            yield judge(rows)

    return run


def _crowded(units: DataFrame, window: int) -> DataFrame:
    """The same verdicts by counting windows: (anchor, content, bits)."""

    def run(batches):
        for batch in batches:
            words = batch["words"]
            flat = words.flatten().to_numpy().view(np.uint64)
            first = np.concatenate([[0], np.cumsum(pc.list_value_length(words).to_numpy())]).astype(np.int64)
            n = np.diff(first) - window + 1
            unit = np.repeat(np.arange(len(n)), n)
            at = np.arange(len(unit)) - np.repeat(np.cumsum(n) - n, n)
            begin = first[unit] + at
            one = spans(flat, begin, begin + window).view(np.int64)
            other = spans(flat[::-1], len(flat) - begin - window, len(flat) - begin).view(np.int64)
            columns = [*(batch[c].take(pa.array(unit)) for c in ("anchor", "content", "times"))]
            columns += [pa.array(at), pa.array(one), pa.array(other)]
            yield pa.RecordBatch.from_arrays(columns, ["anchor", "content", "times", "at", "one", "other"])

    rows = units.mapInArrow(run, "anchor long, content long, times long, at long, one long, other long")
    often = rows.groupBy("one", "other").agg(F.sum("times").alias("all")).filter("all > 1").select("one", "other")
    bit = F.expr("shiftleft(1L, cast(at AS int))")
    return rows.join(often, ["one", "other"], "left_semi").groupBy("anchor", "content").agg(F.bit_or(bit).alias("bits"))


def _units_of(rows: DataFrame, window: int) -> DataFrame:
    def run(batches):
        for batch in pieces(batches):
            words = Words(batch["text"], lower=False)
            units = Units(words, window)
            columns = [
                batch["row"].take(pa.array(units.text)),
                pa.array((units.first - words.first[units.text]).astype(np.int64)),
                pa.array(units.windows.astype(np.int32)),
                pa.array(units.places.astype(np.int32)),
                pa.array(units.anchor.view(np.int64)),
                pa.array(units.content.view(np.int64)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["row", "first", "windows", "places", "anchor", "content"])

    return rows.mapInArrow(run, "row long, first long, windows int, places int, anchor long, content long")


def _joined(text: Column) -> Column:
    """The words with one blank between them."""
    return F.trim(collapsed(text))


def _n_words(joined: Column) -> Column:
    blanks = F.length(joined) - F.length(F.replace(joined, F.lit(" "), F.lit("")))
    return F.when(joined == "", 0).otherwise(blanks + 1).cast("long")


def repeated_windows(rows: DataFrame, scratch: Scratch, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(texts with a repeated anchor, marks of each row) for rows (row, text), one for rows that share ``row``.

    The marks are structs (first window, windows, bits); a bit tells a repeated window.
    """
    units = _units_of(rows, window)
    totals = units.groupBy("anchor").agg(
        F.sum("places").alias("places"), F.max("places").alias("most"), F.min("content").alias("lo"), F.max("content").alias("hi")
    )
    again = totals.filter("places > 1").select("anchor", ((F.col("lo") != F.col("hi")) | (F.col("most") > 1)).alias("mixed"))
    found = scratch.store(units.join(again, "anchor").select("row", "first", "windows", "anchor", "content", "mixed"))
    # equal rows have equal units: one of them speaks for all, and tells how many there are
    unit = F.struct("first", "windows", "anchor", "content", "mixed")
    per_row = found.groupBy("row").agg(F.collect_set(unit).alias("all"), F.count(F.lit(1)).alias("n"))
    per_row = per_row.select(
        "row", F.filter("all", lambda u: u["mixed"]).alias("units"), (F.col("n") / F.size("all")).cast("long").alias("copies")
    )
    touched = rows.join(per_row, "row").dropDuplicates(["row"])
    touched = scratch.store(touched.select("row", "text", "units", "copies"))

    def contents(batches):
        for batch in pieces(batches):
            words = Words(batch["text"], lower=False)
            size = pc.list_value_length(batch["units"]).to_numpy()
            unit = batch["units"].flatten()
            first, windows, anchor, content, _ = (f.to_numpy(zero_copy_only=False) for f in unit.flatten())
            copies = np.repeat(batch["copies"].to_numpy(), size)
            begin = first + np.repeat(words.first[:-1], size)
            # equal units of a batch go as one row
            _, one, of = np.unique(np.stack([anchor, content]), axis=1, return_index=True, return_inverse=True)
            times = np.zeros(len(one), dtype=np.int64)
            np.add.at(times, of.ravel(), copies)
            long = (windows[one] + window - 1).astype(np.int64)
            at = np.arange(long.sum()) - np.repeat(np.cumsum(long) - long, long) + np.repeat(begin[one], long)
            ends = np.concatenate([[0], np.cumsum(long)]).astype(np.int32)
            full = pa.ListArray.from_arrays(pa.array(ends), pa.array(words.hashes[at].view(np.int64)))
            columns = [pa.array(anchor[one]), pa.array(content[one]), pa.array(times), full]
            yield pa.RecordBatch.from_arrays(columns, ["anchor", "content", "times", "words"])

    copies = touched.filter(F.size("units") > 0).mapInArrow(contents, "anchor long, content long, times long, words array<long>")
    distinct = copies.groupBy("anchor", "content").agg(F.sum("times").alias("times"), F.first("words").alias("words"))
    distinct = scratch.store(distinct)
    crowded = distinct.groupBy("anchor").count().filter(F.col("count") > CROWDED).select("anchor")
    shards = distinct.join(crowded, "anchor", "left_anti").repartition("anchor").sortWithinPartitions("anchor", "content")
    verdicts = shards.mapInArrow(_verdicts(window), "anchor long, content long, bits long")
    verdicts = scratch.store(verdicts.unionByName(_crowded(distinct.join(crowded, "anchor", "left_semi"), window)))
    whole = found.filter("NOT mixed").select("row", "first", "windows", F.expr("-1L").alias("bits"))
    part = found.filter("mixed").join(verdicts.filter("bits <> 0"), ["anchor", "content"]).select("row", "first", "windows", "bits")
    marks = whole.unionByName(part).groupBy("row").agg(F.collect_set(F.struct("first", "windows", "bits")).alias("marks"))
    scratch.drop(distinct)
    return touched, marks


def substring_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, with_text: bool = False) -> DataFrame:
    """One row per row of ``docs``: key, n_words, n_removed, kept_sha256, and ``kept_text`` on demand.

    Windows are judged on the input. A null, empty or blank text has no word; a text of fewer
    words than a window loses none. Rows that repeat key and text repeat each other's windows.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "substring-dedup")
    ship(spark)
    docs = docs.select(F.col(key).alias("key"), text_of(text).alias("text"))
    docs = docs.withColumn("row", F.xxhash64("key", "text"))
    touched, marks = repeated_windows(docs.select("row", "text"), scratch, window)

    def cut(batches):
        for batch in pieces(batches):
            words = Words(batch["text"], lower=False)
            raw = words.data.tobytes()
            out = []
            for i, found in enumerate(batch["marks"].to_pylist()):
                low, n = int(words.first[i]), int(words.first[i + 1] - words.first[i])
                edge = np.zeros(n + 1, dtype=np.int64)
                for m in found:
                    bits = m["bits"]
                    hit = [m["first"] + k for k in range(m["windows"]) if bits >> k & 1]
                    np.add.at(edge, hit, 1)
                    np.add.at(edge, np.array(hit, dtype=np.int64) + window, -1)
                kept = np.flatnonzero(np.cumsum(edge[:n]) == 0) + low
                joined = b" ".join([raw[a:b] for a, b in zip(words.begin[kept].tolist(), words.end[kept].tolist())])
                out.append((n - len(kept), hashlib.sha256(joined).hexdigest(), joined.decode() if with_text else None))
            removed, digest, kept_text = zip(*out)
            columns = [batch["row"], pa.array(removed, pa.int64()), pa.array(digest), pa.array(kept_text, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["row", "n_removed", "digest", "kept_text"])

    changed = touched.select("row", "text").join(marks, "row").mapInArrow(cut, "row long, n_removed long, digest string, kept_text string")
    joined = docs.select("row", "key", _joined(F.col("text")).alias("words"))
    shown = ["words"] if with_text else []
    plain = joined.select("row", "key", _n_words(F.col("words")).alias("n_words"), F.sha2("words", 256).alias("plain"), *shown)
    kept = [F.coalesce("kept_text", "words").alias("kept_text")] if with_text else []
    return plain.join(changed, "row", "left").select(
        F.col("key").alias(key),
        "n_words",
        F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"),
        F.coalesce("digest", "plain").alias("kept_sha256"),
        *kept,
    )


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"))


QUERIES = {"op9_substring_dedup": op9_substring_dedup}

SQL = {
    "op9_substring_dedup": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + {WINDOW - 1}], ' ')) AS x
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d WHERE len(w) >= {WINDOW})
), again AS (SELECT x FROM s GROUP BY x HAVING count(*) > 1
), gone AS (
  SELECT DISTINCT doc_id, i + k AS i FROM (SELECT doc_id, i, unnest(range(0, {WINDOW})) AS k FROM s WHERE x IN (SELECT x FROM again))
), lists AS (SELECT doc_id, list(i) AS g FROM gone GROUP BY doc_id
), k AS (
  SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS t, count(*) AS n FROM (
    SELECT d.doc_id, unnest(d.w) AS w, unnest(range(1, len(d.w) + 1)) AS i FROM d) u
  WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.doc_id = u.doc_id AND gone.i = u.i) GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
}
