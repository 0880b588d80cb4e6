"""CSV in: the results file and the reference tables."""

from __future__ import annotations

from collections.abc import Sequence
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracklane.runtime import store
from tracklane.sources.schemas import LANDING_TYPES


def snake_case(name: str) -> str:
    """``Best3SquatKg`` -> ``best3_squat_kg``: an underscore before each inner capital."""
    return "".join(f"_{ch}" if ch.isupper() and i else ch for i, ch in enumerate(name)).lower()


def snake_case_headers(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({c: snake_case(c) for c in df.columns})


def land_csv(spark: SparkSession, path: str) -> DataFrame:
    """Results CSV -> landing columns, typed by name.

    Only the header line is looked at before the job runs. Columns beyond the
    required ones stay as text; a missing required column is an error.
    """
    text = snake_case_headers(spark.read.option("header", True).option("mode", "PERMISSIVE").csv(path))
    absent = [c for c in LANDING_TYPES if c not in text.columns]
    if absent:
        raise ValueError(f"{path}: missing columns {absent}")
    typed = [
        F.col(c).try_cast(LANDING_TYPES[c]).alias(c) if isinstance(LANDING_TYPES.get(c), T.DoubleType) else F.col(c)
        for c in text.columns
    ]
    return text.select(*typed)


# The columns by which the header line of a result file is known.
RESULT_COLUMNS = ("Place", "Name", "Sex", "Event")
SECTIONED = ".opl.csv"  # ending of such files


def _cells(line: Column) -> Column:
    """The cells of a CSV line, quotes taken off; null where quotes do not match."""
    parts = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(r',("(?:[^"]|"")*"|[^,"]*)'), F.lit(0))
    whole = F.array_join(parts, "") == F.concat(F.lit(","), line)
    bare = F.transform(parts, lambda p: F.replace(F.regexp_replace(p, r'^,"?|"$', ""), F.lit('""'), F.lit('"')))
    return F.when(whole, bare)


def read_sectioned(
    spark: SparkSession, path: str, header: Sequence[str] = RESULT_COLUMNS, columns: Sequence[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Files of a folder that carry sections above their table: (rows, rejects).

    The header is the first line of a file that holds all names of ``header``. The last two lines with
    content above it are names and values that hold for the file; they become columns too, unless the table has a column of that name.
    ``columns`` (snake case) fixes what is returned besides ``file`` and ``line``; else it is every name found, as text, absent ones
    null. A rejected line has its file, line number, text and reason: no header in its file, quotes that do not match, or another number
    of cells than the header. Lines without content are skipped. A line number counts from 1; files may be split.
    """
    lines = spark.read.option("recursiveFileLookup", True).text(path)
    lines = lines.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_order"),
        F.col("value").alias("text"),
    )
    # numbers are kept in the stored lines; those of a file run on from block to block
    lines = store(lines, "lines")
    blocks = lines.groupBy("file", "_block").agg(F.min("_order").alias("_first"), F.count(F.lit(1)).alias("_lines"))
    before = Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # a row per block of a file
    blocks = blocks.withColumn("_before", F.coalesce(F.sum("_lines").over(before), F.lit(0))).drop("_lines")
    lines = lines.join(blocks, ["file", "_block"])
    lines = lines.select("file", (F.col("_before") + F.col("_order") - F.col("_first") + 1).alias("line"), "text", _cells(F.col("text")).alias("cells"))
    full = F.col("cells").isNull() | F.exists("cells", lambda c: F.trim(c) != "")
    lines = lines.filter(full)

    holds = F.lit(True)
    for name in header:
        holds = holds & F.array_contains("cells", name)
    heads = lines.filter(holds).groupBy("file").agg(F.min("line").alias("_at"), F.min_by("cells", "line").alias("_names"))
    heads = store(heads, "headers")  # a row per file
    above = lines.join(heads.select("file", "_at"), "file").filter((F.col("line") < F.col("_at")) & F.col("cells").isNotNull())
    near = above.withColumn("_back", F.row_number().over(Window.partitionBy("file").orderBy(F.desc("line")))).filter("_back <= 2")
    section = near.groupBy("file").agg(
        F.max(F.when(F.col("_back") == 2, F.col("cells"))).alias("_keys"), F.max(F.when(F.col("_back") == 1, F.col("cells"))).alias("_values")
    )
    heads = store(heads.join(section, "file", "left"), "sections")

    def names(column: str) -> dict[str, list[str]]:
        """Snake-case name -> the names in the files; as many as there are different columns."""
        found = heads.select(F.explode(column).alias("name")).filter(F.trim("name") != "").distinct().orderBy("name").collect()
        out: dict[str, list[str]] = {}
        for r in found:
            out.setdefault(snake_case(r["name"].strip()), []).append(r["name"])
        return out

    def pick(name: str) -> Column:
        got = [F.get(v, F.array_position(k, raw).cast("int") - 1) for k, v, known in places for raw in known.get(name, [])]
        value = F.coalesce(*got) if got else F.lit(None).cast("string")
        return F.nullif(value, F.lit("")).alias(name)

    places = [("_names", "cells", names("_names")), ("_keys", "_values", names("_keys"))]
    wanted = list(columns or dict.fromkeys([*places[0][2], *places[1][2]]))
    body = lines.join(heads, "file", "left").filter(F.col("_at").isNull() | (F.col("line") > F.col("_at")))
    reason = (
        F.when(F.col("_at").isNull(), "no header")
        .when(F.col("cells").isNull(), "quotes")
        .when(F.size("cells") != F.size("_names"), "cells")
    )
    body = body.withColumn("reason", reason)
    rejects = body.filter(F.col("reason").isNotNull()).select("file", "line", "text", "reason")
    return body.filter(F.col("reason").isNull()).select("file", "line", *[pick(c) for c in wanted]), rejects


def convert_reference_tables(
    spark: SparkSession, source_dir: str, target_dir: str, schemas: dict[str, T.StructType] | None = None
) -> dict[str, str]:
    """Every ``*.csv`` of a folder becomes a Parquet dataset of the same stem.

    Reference tables are small dimension files; only their names reach the
    driver. A table without a given schema has its types inferred. A result file with sections (``*.opl.csv``) becomes its
    rows, and ``<stem>-rejects`` the lines that do not fit.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(source_dir).select("path")
    written = {}
    for row in files.collect():
        stem = PurePosixPath(row.path).stem
        if row.path.endswith(SECTIONED):
            for name, table in zip((stem, f"{stem}-rejects"), read_sectioned(spark, row.path)):
                written[name] = f"{target_dir.rstrip('/')}/{name}.parquet"
                table.write.mode("overwrite").parquet(written[name])
            continue
        reader = spark.read.option("header", True)
        schema = (schemas or {}).get(stem)
        reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
        written[stem] = f"{target_dir.rstrip('/')}/{stem}.parquet"
        reader.csv(row.path).write.mode("overwrite").parquet(written[stem])
    return written
