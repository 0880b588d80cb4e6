"""N-gram Jaccard join by PartEnum signatures, and the groups its links make.

A document's set holds its distinct ``SHINGLE``-word shingles. Two sets link when their
Jaccard similarity is at least ``NUMERATOR / DENOMINATOR`` (3/4).

Sets of sizes ``RATIO**b`` to ``RATIO**(b + 1)`` are a band; a set also joins the band above if a
set there can be similar. A band cuts the feature domain (hashes) into partitions. Sets
with similarity 3/4 differ in at most a third of the smaller set's size, and every partition
they do not agree on holds a differing feature. So of the first ``size // 3 + 1``
non-empty partitions of either, they agree on one: its content is the shared signature.

Very frequent shingles (a passage in a third of all documents) are left out of the
partitions, for all sets alike, which changes no similarity bound. A set that then has too few
non-empty partitions also gives its ``size // 4 + 1`` smallest features as signatures; two
sets that both need this share one. Which shingles are frequent only decides the work.

Links are verified on the sets themselves. A signature shared by at most ``SMALL`` sets gives
all their pairs. In a larger group, features that no other member of any such group
has are counted first: a set with over a quarter of those links with nothing there and
leaves. The others are compared with the centre, the set with the fewest of them. Members
that end up outside the centre's component are then compared with the rest, as far as
these counts, the distances to the centre (triangle inequality) and the parity of their
features by cell (a cell of unlike parity holds a differing feature) allow a link. No pair
of texts that may link is lost, and a group of near copies costs pairs in proportion to its size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklane.llm.common import Scratch, Words, grams, mix, pieces, row_key, ship, table
from tracklane.llm.components import components

SHINGLE = 5
NUMERATOR, DENOMINATOR = 75, 100
RATIO = 3
SMALL = 8
SIZE_STEP = 1.08
STEPS_APART = 4  # similar sets are at most 4/3 as large, which is under four steps
FREQUENT_LEAST = 32  # documents of a frequent shingle
FREQUENT_MOST = 1 << 18  # of them are broadcast, the most frequent: 2 MB
PARITY_BITS = 512  # cells of features whose parity a set keeps
LOWEST = 8  # signatures of a set by which most repeats of a pair are known


class Sets:
    """Shingle sets of a batch of texts: ``hashes[first[i]:first[i + 1]]``, ascending and distinct."""

    def __init__(self, texts: pa.Array):
        words = Words(texts, lower=True)
        n = words.counts()
        start = words.first[:-1]
        text = words.text_index()
        hashes = grams(words.hashes, SHINGLE)
        whole = np.arange(len(hashes)) + SHINGLE <= words.first[1:][text[: len(hashes)]]
        hashes, text = hashes[whole], text[: len(whole)][whole]
        for short in range(1, SHINGLE):  # fewer words: the whole sequence is one
            few = np.flatnonzero(n == short)
            if len(few):
                h = grams(words.hashes, short)[start[few]]
                hashes, text = np.concatenate([hashes, mix(h + np.uint64(short))]), np.concatenate([text, few])
        order = np.lexsort((hashes, text))
        hashes, text = hashes[order], text[order]
        new = np.ones(len(hashes), dtype=bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
        self.hashes, self.text = hashes[new], text[new]
        self.first = np.searchsorted(self.text, np.arange(len(n) + 1))
        self.size = np.diff(self.first)

    def per_text(self, values: np.ndarray) -> np.ndarray:
        """Sum of ``values`` (one per feature) for each text."""
        sums = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values, dtype=values.dtype)])
        return sums[self.first[1:]] - sums[self.first[:-1]]

    def names(self) -> np.ndarray:
        """A 64-bit name of each set, the same for equal sets; its last byte is the size on a log scale."""
        content = mix(self.per_text(mix(self.hashes ^ np.uint64(0x5851F42D4C957F2D))) + self.size.astype(np.uint64))
        step = np.floor(np.log(np.maximum(self.size, 1)) / np.log(SIZE_STEP)).astype(np.uint64)
        return ((content & ~np.uint64(255)) | np.minimum(step, np.uint64(255))).view(np.int64)

    def sketches(self) -> list[bytes]:
        """Counts of features by their leading bits, about one byte for four features."""
        bits = sketch_bits(self.size)
        width = np.int64(1) << bits
        base = np.concatenate([[0], np.cumsum(width)])
        cell = base[self.text] + (self.hashes >> (64 - bits[self.text]).astype(np.uint64)).astype(np.int64)
        counts = np.minimum(np.bincount(cell, minlength=base[-1]), 255).astype(np.uint8)
        return [counts[a:b].tobytes() for a, b in zip(base, base[1:])]


    def parities(self) -> pa.Array:
        """Whether each cell of features holds an odd number of them, ``PARITY_BITS`` bits as longs."""
        texts = len(self.size)
        cell = self.text.astype(np.int64) * PARITY_BITS + (self.hashes & np.uint64(PARITY_BITS - 1)).astype(np.int64)
        odd = np.bincount(cell, minlength=texts * PARITY_BITS) & 1
        longs = np.packbits(odd.astype(np.uint8)).view(np.int64)
        return pa.ListArray.from_arrays(pa.array(np.arange(texts + 1, dtype=np.int32) * (PARITY_BITS // 64)), pa.array(longs))


def sketch_bits(size: np.ndarray) -> np.ndarray:
    return np.maximum(3, np.ceil(np.log2(np.maximum(size, 1) / 4))).astype(np.int64)


def sketch_distance(one: bytes, other: bytes) -> int:
    """A lower bound of the number of features two sets differ in."""
    a, b = np.frombuffer(one, np.uint8).astype(np.int32), np.frombuffer(other, np.uint8).astype(np.int32)
    while len(a) > len(b):
        a = a[::2] + a[1::2]
    while len(b) > len(a):
        b = b[::2] + b[1::2]
    return int(np.abs(a - b).sum())


def bands(size: np.ndarray) -> np.ndarray:
    """The largest b with ``RATIO**b <= size``."""
    edges = np.array([RATIO**b for b in range(1, 39)], dtype=np.float64)
    return np.searchsorted(edges, size, side="right")


def signatures(sets: Sets, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(partitioned, signature, text): PartEnum signatures, and features of sets with too few of them."""
    rare = np.ones(len(sets.hashes), dtype=bool)
    if len(frequent):
        at = np.searchsorted(frequent, sets.hashes)
        at[at == len(frequent)] = 0
        rare = frequent[at] != sets.hashes
    hashes, text = sets.hashes[rare], sets.text[rare]
    band, need = bands(sets.size), sets.size // 3 + 1
    short = np.zeros(len(sets.size), dtype=bool)
    out = []
    for above in (0, 1):
        joins = sets.size > 0
        if above:  # a set in the next band is at most 4/3 as large
            joins &= DENOMINATOR * sets.size >= NUMERATOR * np.power(float(RATIO), band + 1)
        own = joins[text]
        h, t = hashes[own], text[own]
        instance = (band + above)[t]
        parts = np.ceil(0.45 * (np.power(float(RATIO), instance + 1) - 1)).astype(np.uint64)
        part = ((h >> np.uint64(32)) * parts) >> np.uint64(32)
        new = np.ones(len(h), dtype=bool)
        new[1:] = (part[1:] != part[:-1]) | (t[1:] != t[:-1])
        starts = np.flatnonzero(new)
        if len(starts):
            content = np.add.reduceat(mix(h), starts)
            owner = t[starts]
            rank = np.arange(len(starts)) - np.searchsorted(owner, owner)
            used = rank < need[owner]
            signature = mix(content + mix(instance[starts].astype(np.uint64) + np.uint64(1)))
            out.append((np.ones(used.sum(), bool), signature[used], owner[used]))
            found = np.bincount(owner[used], minlength=len(sets.size))
        else:
            found = np.zeros(len(sets.size), np.int64)
        short |= joins & (found < need)
    rank = np.arange(len(sets.hashes)) - sets.first[sets.text]
    used = short[sets.text] & (rank < sets.size[sets.text] // 4 + 1)
    out.append((np.zeros(used.sum(), bool), sets.hashes[used], sets.text[used]))
    return tuple(np.concatenate(x) for x in zip(*out))


def _described(docs: DataFrame) -> DataFrame:
    """(key, n, name, sketch) of each row; on the first row of a batch its shingles that the task has met three times.

    A task counts shingles in a fixed table by their leading bits, so its memory does not follow the input.
    """
    kind = dict(docs.dtypes)["key"]

    def run(batches):
        met = np.zeros(1 << 24, dtype=np.uint8)
        for batch in pieces(batches):
            sets = Sets(batch["text"])
            shared, count = np.unique(sets.hashes, return_counts=True)
            cell = (shared >> np.uint64(40)).astype(np.int64)
            met[cell] = np.minimum(met[cell] + count, 255)
            often = met[cell] > 2
            shared, count = shared[often], count[often]
            rest = len(sets.size) - 1
            columns = [
                batch["key"],
                pa.array(sets.size.astype(np.int64)),
                pa.array(sets.names()),
                pa.array(sets.sketches(), pa.binary()),
                pa.array([shared.view(np.int64), *[None] * rest], pa.list_(pa.int64())),
                pa.array([count.astype(np.int64), *[None] * rest], pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["key", "n", "name", "sketch", "shared", "times"])

    schema = f"key {kind}, n long, name long, sketch binary, shared array<long>, times array<long>"
    return docs.mapInArrow(run, schema)


def _frequent(described: DataFrame) -> np.ndarray:
    pairs = described.filter("shared IS NOT NULL").select(F.explode(F.arrays_zip("shared", "times")).alias("s"))
    counts = pairs.groupBy("s.shared").agg(F.sum("s.times").alias("times"))
    rows = counts.filter(F.col("times") >= FREQUENT_LEAST).orderBy(F.desc("times"), "shared").limit(FREQUENT_MOST)
    return np.sort(np.array([r[0] for r in rows.select("shared").collect()], dtype=np.int64).view(np.uint64))


PAIR, MEMBER, FEATURE = 0, 1, 2


def _grouped(batches):
    """Sorted (partitioned, signature, name) rows to pairs, members of larger groups, and features.

    A group may go on over many batches; what is kept of it is at most ``SMALL`` names.
    """
    kept = np.zeros(0, np.int64), np.zeros(0, np.int64)  # the group that is not over yet
    large = None  # signature of a group known to be larger than SMALL

    def rows(kind, x, y):
        if len(x):
            columns = [pa.array(np.full(len(x), kind, np.int32)), pa.array(x), pa.array(y)]
            yield pa.RecordBatch.from_arrays(columns, ["kind", "x", "y"])

    def close(signature, name, last):
        nonlocal kept, large
        new = np.ones(len(signature), dtype=bool)
        new[1:] = (signature[1:] != signature[:-1]) | (name[1:] != name[:-1])  # equal sets give equal rows
        signature, name = signature[new], name[new]
        if large is not None:
            go_on = signature == large
            yield from rows(MEMBER, signature[go_on], name[go_on])
            if not go_on.all():
                large = None
            signature, name = signature[~go_on], name[~go_on]
        start = np.flatnonzero(np.concatenate([[True], signature[1:] != signature[:-1]])) if len(signature) else np.zeros(0, int)
        length = np.diff(np.append(start, len(signature)))
        kept = signature[:0], name[:0]
        if len(start) and not last:
            if length[-1] <= SMALL:  # more of it may follow
                kept = signature[start[-1] :], name[start[-1] :]
                signature, name = signature[: start[-1]], name[: start[-1]]
                start, length = start[:-1], length[:-1]
            else:
                large = signature[-1]
        size, head = np.repeat(length, length), np.repeat(start, length)
        a, b = [], []
        for step in range(1, SMALL):
            at = np.flatnonzero((size[:-step] <= SMALL) & (head[:-step] == head[step:])) if len(size) > step else np.zeros(0, int)
            at = at[np.abs((name[at] & 255) - (name[at + step] & 255)) <= STEPS_APART]
            a.append(name[at])
            b.append(name[at + step])
        big = np.flatnonzero(size > SMALL)
        a, b = np.concatenate(a), np.concatenate(b)
        if len(a):
            a, b = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
            yield from rows(PAIR, a, b)
        yield from rows(MEMBER, signature[big], name[big])

    for batch in batches:
        partitioned = batch["partitioned"].to_numpy(zero_copy_only=False)
        signature, name = batch["signature"].to_numpy(), batch["name"].to_numpy()
        yield from rows(FEATURE, signature[~partitioned], name[~partitioned])
        signature, name = signature[partitioned], name[partitioned]
        yield from close(np.concatenate([kept[0], signature]), np.concatenate([kept[1], name]), last=False)
    yield from close(*kept, last=True)


def _signed(docs: DataFrame, frequent) -> DataFrame:
    """Pairs, members and features of all documents' signatures: (kind, x, y)."""

    def run(batches):
        for batch in pieces(batches):
            sets = Sets(batch["text"])
            partitioned, signature, text = signatures(sets, frequent.value)
            columns = [pa.array(partitioned), pa.array(signature.view(np.int64)), pa.array(sets.names()[text])]
            yield pa.RecordBatch.from_arrays(columns, ["partitioned", "signature", "name"])

    rows = docs.select("text").mapInArrow(run, "partitioned boolean, signature long, name long")
    # features of copies are hot; they are only passed on, so any task may take them
    salt = F.when(F.col("partitioned"), 0).otherwise(F.pmod("name", F.lit(1024)))
    dealt = rows.repartition("signature", salt).sortWithinPartitions("signature", "name")
    return dealt.mapInArrow(_grouped, "kind int, x long, y long")


def _contents(names: DataFrame, described: DataFrame, docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(name, features, parity) of the named sets, from one document each.

    Rows that repeat a key meet in one task, which passes a set on once.
    """
    keys = described.join(names, "name").groupBy("name").agg(F.min("key").alias("key")).select("key").distinct()

    def run(batches):
        seen: set[int] = set()
        for batch in pieces(batches):
            sets = Sets(batch["text"])
            full = pa.ListArray.from_arrays(pa.array(sets.first.astype(np.int32)), pa.array(sets.hashes.view(np.int64)))
            names = sets.names().tolist()
            new = []
            for name in names:
                new.append(name not in seen)
                seen.add(name)
            columns = [pa.array(names, pa.int64()), full, sets.parities()]
            yield pa.RecordBatch.from_arrays(columns, ["name", "features", "parity"]).filter(pa.array(new))

    texts = docs.join(keys, "key", "left_semi").select("text")
    return scratch.store(texts.mapInArrow(run, "name long, features array<long>, parity array<long>"))


def _linkable(members: DataFrame, contents: DataFrame, scratch: Scratch) -> DataFrame:
    """The members (signature, name) of larger groups that can link there, with their sizes ``n`` and ``c``.

    ``c`` counts the features that another set of these groups has, too: no intersection exceeds it.
    """
    own = contents.join(members.select("name").distinct(), "name", "left_semi")
    rows = own.select("name", F.explode("features").alias("feature"))
    alone = rows.groupBy("feature").agg(F.count("*").alias("sets"), F.first("name").alias("name")).filter("sets = 1")
    alone = alone.groupBy("name").agg(F.count("*").alias("alone"))
    n = F.size("features").cast("long")
    able = own.select("name", n.alias("n")).join(alone, "name", "left")
    able = able.select("name", "n", (F.col("n") - F.coalesce("alone", F.lit(0))).alias("c"))
    able = able.filter(DENOMINATOR * F.col("c") >= NUMERATOR * F.col("n"))
    return scratch.store(members.join(able, "name").select("signature", "name", "n", "c"))


def _may_link(n: str, c: str, other_n: str, other_c: str) -> Column:
    """Whether two sets can reach the similarity with an intersection of the smaller ``c``."""
    most = F.least(c, other_c)
    return DENOMINATOR * most >= NUMERATOR * (F.col(n) + F.col(other_n) - most)


def _bounded(pairs: DataFrame, described: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b, na, nb, most, possible) for pairs: the largest intersection that the sketches leave possible."""
    sets = described.filter("n > 0").groupBy("name").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    one = sets.select(F.col("name").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    other = sets.select(F.col("name").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))

    def bound(batches):
        for batch in batches:
            differ = [sketch_distance(x, y) for x, y in zip(batch["sa"].to_pylist(), batch["sb"].to_pylist())]
            columns = [batch["a"], batch["b"], batch["na"], batch["nb"], pa.array(differ, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["a", "b", "na", "nb", "differ"])

    bounded = pairs.join(one, "a").join(other, "b").mapInArrow(bound, "a long, b long, na long, nb long, differ long")
    # differing features d: intersection <= (na + nb - d) / 2, union = na + nb - intersection
    most = F.least(F.floor((F.col("na") + F.col("nb") - F.col("differ")) / 2), F.col("na"), F.col("nb"))
    union = F.col("na") + F.col("nb") - most
    return scratch.store(bounded.withColumns({"most": most, "possible": DENOMINATOR * most >= NUMERATOR * union}))


def _verified(bounded: DataFrame, contents: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b, low, high, linked): bounds of the distance (1 - similarity) of each pair, and whether it links."""
    far = bounded.filter("NOT possible").select(
        *("a", "b"),
        (1 - F.col("most") / (F.col("na") + F.col("nb") - F.col("most"))).alias("low"),
        F.lit(1.0).alias("high"),
        F.lit(False).alias("linked"),
    )
    near = bounded.filter("possible").select("a", "b", "na", "nb")
    left = contents.select(F.col("name").alias("a"), F.col("features").alias("fa"))
    right = contents.select(F.col("name").alias("b"), F.col("features").alias("fb"))
    common = F.size(F.array_intersect("fa", "fb")).cast("long")
    exact = near.join(left, "a").join(right, "b").select("a", "b", "na", "nb", common.alias("common"))
    union = F.col("na") + F.col("nb") - F.col("common")
    distance = 1 - F.col("common") / union
    exact = exact.select("a", "b", distance.alias("low"), distance.alias("high"), (DENOMINATOR * F.col("common") >= NUMERATOR * union).alias("linked"))
    return scratch.store(exact.unionByName(far))


def _parity_allows(n: str, parity: str, other_n: str, other_parity: str) -> Column:
    """Whether the cells of unlike parity, each a differing feature, are few enough for a link."""
    differ = sum(
        (F.bit_count(F.col(parity)[i].bitwiseXOR(F.col(other_parity)[i])) for i in range(PARITY_BITS // 64)), F.lit(0)
    )
    # differing features d: intersection = (n + m - d) / 2, union = (n + m + d) / 2
    return (DENOMINATOR + NUMERATOR) * differ <= (DENOMINATOR - NUMERATOR) * (F.col(n) + F.col(other_n))


def _left_over(
    members: DataFrame, centres: DataFrame, checked: DataFrame, labels: DataFrame, contents: DataFrame, scratch: Scratch
) -> DataFrame:
    """Pairs of larger groups that may still link: their members lie in different components.

    A pair is left out if its distances to the centre differ by more than a link allows, if
    its parities do, or if both sets hold a lower signature among their lowest ones: the pair
    comes up there, too. Its lowest common signature always keeps it.
    """
    slack = 1 - NUMERATOR / DENOMINATOR + 1e-9
    placed = (
        members.join(centres, "signature")
        .join(labels, F.col("name") == F.col("node"), "left")
        .select("signature", "name", "n", "c", "centre", F.coalesce("label", "name").alias("label"))
    )
    placed = scratch.store(placed)
    # only groups whose members are not all of one component go on
    split = placed.groupBy("signature").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("signature")
    known = checked.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "low", "high")
    at_centre = F.col("name") == F.col("centre")
    near = (F.least("name", "centre") == F.col("a")) & (F.greatest("name", "centre") == F.col("b"))
    open_groups = scratch.store(
        placed.join(split, "signature", "left_semi")
        .join(known, near, "left")
        .select(
            *("signature", "name", "n", "c", "centre", "label"),
            F.when(at_centre, 0.0).otherwise(F.coalesce("low", F.lit(0.0))).alias("low"),
            F.when(at_centre, 0.0).otherwise(F.coalesce("high", F.lit(1.0))).alias("high"),
        )
    )
    lowest = F.slice(F.array_sort(F.collect_list("signature")), 1, LOWEST).alias("lowest")
    tests = open_groups.groupBy("name").agg(lowest).join(contents.select("name", "parity"), "name")
    tested = scratch.store(open_groups.join(tests, "name"))
    centre_label = open_groups.filter(at_centre).select("signature", F.col("label").alias("centre_label"))
    outside = tested.join(centre_label, "signature").filter(F.col("label") != F.col("centre_label"))
    sides = ("name", "n", "c", "label", "low", "high", "parity", "lowest")
    outside = outside.select("signature", "centre_label", *(F.col(x).alias(f"{x}_x") for x in sides))
    lower = F.filter(F.array_intersect("lowest_x", "lowest"), lambda s: s < F.col("signature"))
    pairs = outside.join(tested.filter(~at_centre), "signature").filter(
        (F.col("label_x") != F.col("label"))
        & ((F.col("label") == F.col("centre_label")) | (F.col("name_x") < F.col("name")))  # of two outside, once
        & _may_link("n", "c", "n_x", "c_x")
        & (F.col("low") - F.col("high_x") <= slack)
        & (F.col("low_x") - F.col("high") <= slack)
        & _parity_allows("n", "parity", "n_x", "parity_x")
        & (F.size(lower) == 0)
    )
    pairs = pairs.select(F.least("name_x", "name").alias("a"), F.greatest("name_x", "name").alias("b")).distinct()
    return scratch.store(pairs.join(known.select("a", "b"), ["a", "b"], "left_anti"))


def near_groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: key, n_shingles, component_id.

    ``component_id`` is the smallest key reachable by links. A text without words (null,
    empty, blank) has an empty set and is alone. Rows without key take no part: their
    component is null. Rows that repeat a key are documents of their own with the same name.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "near-dedup")
    ship(spark)
    docs = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    described = scratch.store(_described(docs))
    sets = described.select("key", "n", "name")
    whole = docs.filter(F.col("key").isNotNull())
    usable = described.filter(F.col("key").isNotNull())
    frequent = spark.sparkContext.broadcast(_frequent(described))
    found = scratch.store(_signed(whole, frequent))
    scratch.release()
    of = lambda kind, x, y: found.filter(F.col("kind") == kind).select(F.col("x").alias(x), F.col("y").alias(y))
    members = scratch.store(of(MEMBER, "signature", "name").unionByName(of(FEATURE, "signature", "name")).distinct())
    small = _bounded(of(PAIR, "a", "b").distinct(), usable, scratch)
    paired = small.filter("possible").select(F.explode(F.array("a", "b")).alias("name"))
    contents = _contents(paired.unionByName(members.select("name")).distinct(), usable, whole, scratch)
    scratch.release()
    members = _linkable(members, contents, scratch)
    purest = F.max(F.struct(F.col("c") / F.col("n"), F.col("n").alias("n"), F.col("name").alias("name"), F.col("c").alias("c")))
    centres = members.groupBy("signature").agg(purest.alias("top"))
    centres = scratch.store(
        centres.select("signature", F.col("top.name").alias("centre"), F.col("top.n").alias("cn"), F.col("top.c").alias("cc"))
    )
    starred = members.join(centres, "signature").filter((F.col("name") != F.col("centre")) & _may_link("n", "c", "cn", "cc"))
    starred = starred.select(F.least("centre", "name").alias("a"), F.greatest("centre", "name").alias("b")).distinct()
    starred = starred.join(small.select("a", "b"), ["a", "b"], "left_anti")
    checked = _verified(small.unionByName(_bounded(starred, usable, scratch)), contents, scratch)
    scratch.release()
    links = checked.filter("linked").select("a", "b")
    labels = components(links, scratch)
    rest = _left_over(members, centres.select("signature", "centre"), checked, labels, contents, scratch)
    if not rest.isEmpty():
        more = _verified(_bounded(rest, usable, scratch), contents, scratch)
        labels = components(links.unionByName(more.filter("linked").select("a", "b")), scratch)
    scratch.drop(contents)
    scratch.release()
    named = usable.filter("n > 0").select("key", "name").join(labels, F.col("name") == F.col("node"), "left")
    smallest = named.groupBy(F.coalesce("label", "name").alias("label")).agg(F.min("key").alias("component"))
    smallest = smallest.withColumnRenamed("label", "_label")
    placed = sets.join(labels, F.col("name") == F.col("node"), "left").withColumn("label", F.coalesce("label", "name"))
    alone = (F.col("n") == 0) | F.col("key").isNull()
    return placed.join(smallest, F.col("label") == F.col("_label"), "left").select(
        F.col("key").alias(key),
        F.col("n").alias("n_shingles"),
        F.when(alone, F.col("key")).otherwise(F.col("component")).alias("component_id"),
    )


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, the one with the smallest id; documents without id stay.

    Rows that share an id are documents of their own unless their texts are equal; of those one stays.
    """
    scratch = Scratch(spark, "near-dedup-stage")
    own = F.when(F.col("doc_id").isNotNull(), row_key())
    rows = docs.select(F.struct(*docs.columns).alias("_row"), own.alias("_key"), F.col("text").alias("_text"))
    groups = scratch.store(near_groups(rows, "_key", "_text").select("_key", "component_id"))
    gone = groups.filter("component_id <> _key").select("_key").distinct()
    kept = rows.drop("_text").join(gone, "_key", "left_anti")
    again = scratch.store(groups.filter("_key IS NOT NULL").groupBy("_key").count().filter("count > 1").select("_key"))
    if not again.isEmpty():
        one = kept.join(again, "_key", "left_semi").dropDuplicates(["_key"])
        kept = kept.join(again, "_key", "left_anti").unionByName(one)
    return kept.select("_row.*")


QUERIES = {"op7_near_dedup": op7_near_dedup}

SQL = {
    "op7_near_dedup": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w
), e AS (SELECT doc_id, unnest(s) AS x, len(s) AS n FROM s
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c
  FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n) GROUP BY 1, 2
), links AS (SELECT a, b FROM shared WHERE 100 * c >= 75 * (na + nb - c)
), reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, least(s.doc_id, coalesce(min(reach.b), s.doc_id)) AS component_id
FROM s LEFT JOIN reach ON reach.a = s.doc_id GROUP BY s.doc_id, len(s.s)
"""
}
