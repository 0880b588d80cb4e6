"""Exact deduplication by distributed MSD radix partitioning.

Documents are split by successive bytes of their normalised text: the first digit is
the byte length with the first ``FIRST`` bytes, each next digit the following bytes.
A group that is a single row leaves at once, a group whose texts have ended is a group
of equal texts. Equality is decided by the bytes alone.

Every split is an aggregate (copies combine before the shuffle) and an inner join back,
which adaptive execution splits where one group holds many rows. Only rows of groups
with two or more rows are carried on, so that most texts travel once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracklane.llm.common import Scratch, collapsed, table, text_of

FIRST = 64  # bytes of the first digit
GROWTH = 16  # each digit is so many times as long as the one before
LONGEST = 1 << 20  # bytes of a digit at most


def equal_groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of ``docs`` that share their normalised text with another row.

    Returns (key, text_sha256, keep, group_size): ``keep`` is the smallest key of the
    group, null only where all are null. Rows that repeat a key are told apart by
    their text; rows that repeat key and text come out once. A null text is empty.
    """
    return _groups(docs, key, text).select(
        F.col("id").alias(key), F.col("sha").alias("text_sha256"), F.col("group.id").alias("keep"), F.col("size").alias("group_size")
    )


def _groups(docs: DataFrame, key: str, text: str) -> DataFrame:
    """The same as (id, sha, group, size); ``group.id`` is the smallest key."""
    scratch = Scratch(docs.sparkSession, "exact-dedup")
    full = F.encode(collapsed(text_of(text)), "UTF-8")
    rows = docs.select(F.col(key).alias("id"), full.alias("bytes")).select(
        "id",
        F.sha2("bytes", 256).alias("sha"),
        F.octet_length("bytes").alias("n"),
        F.substring("bytes", 1, FIRST).alias("digit"),
        F.expr(f"substring(bytes, {FIRST + 1})").alias("rest"),
    )
    # a group is named by its smallest key; the digest only parts rows that repeat a key
    name = F.struct(F.isnull("id").alias("none"), F.col("id"), F.col("sha"))
    groups = rows.groupBy("n", "digit").agg(F.min(name).alias("group"), F.count("*").alias("size")).filter("size > 1")
    rows = rows.join(groups, ["n", "digit"]).select("id", "sha", "group", "size", "rest")
    done, digit = None, FIRST
    while True:
        rows = scratch.store(rows)
        ended = rows.filter("octet_length(rest) = 0").select("id", "sha", "group", "size")
        done = ended if done is None else done.unionByName(ended)
        open_rows = rows.filter("octet_length(rest) > 0")
        if open_rows.isEmpty():
            break
        digit = min(digit * GROWTH, LONGEST)
        split = open_rows.select(
            "id",
            "sha",
            F.col("group").alias("parent"),
            F.expr(f"substring(rest, 1, {digit})").alias("digit"),
            F.expr(f"substring(rest, {digit + 1})").alias("rest"),
        )
        groups = split.groupBy("parent", "digit").agg(F.min(name).alias("group"), F.count("*").alias("size"))
        rows = split.join(groups.filter("size > 1"), ["parent", "digit"]).select("id", "sha", "group", "size", "rest")
    return done.distinct()


RESULTS = ["keep_id", "group_size", "kept", "text_sha256"]

def marked(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``text_sha256``, ``keep_id``, ``group_size`` and ``kept``.

    One row of a group is kept: the one with the smallest key, and any one of those
    that repeat that key and text. A null key is kept only where no row of the group has a key.
    Columns of ``docs`` with the names of the four come out replaced, unless they are its key or text.
    """
    own = F.struct(*[c for c in docs.columns if c not in RESULTS or c in (key, text)])
    sha = F.sha2(F.encode(collapsed(text_of(text)), "UTF-8"), 256)
    rows = docs.select(own.alias("row"), F.col(key).alias("key"), sha.alias("text_sha256"))
    same = F.col("key").eqNullSafe(F.col("id")) & (F.col("text_sha256") == F.col("sha"))
    number = F.row_number().over(Window.partitionBy("key", "text_sha256").orderBy("key"))
    found = rows.join(_groups(docs, key, text), same, "left").withColumn(
        "keep_id", F.when(F.col("sha").isNull(), F.col("key")).otherwise(F.col("group.id"))
    )
    return found.select(
        "row.*",
        "keep_id",
        F.coalesce("size", F.lit(1).cast("long")).alias("group_size"),
        (F.col("keep_id").eqNullSafe(F.col("key")) & (number == 1)).alias("kept"),
        "text_sha256",
    )


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return marked(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without copies, with their own columns."""
    own = docs.columns
    taken = docs.select(F.struct(*own).alias("_row"), F.col("doc_id"), F.col("text"))
    return marked(taken).filter("kept").select("_row.*")


QUERIES = {"op6_exact_dedup": op6_exact_dedup}

SQL = {
    "op6_exact_dedup": r"""
WITH d AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d
"""
}
