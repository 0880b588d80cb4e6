"""Reading and writing: CSV landing, reference tables, Parquet layers, observed writes."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklane.queries import sql
from tracklane.queries.layers import landing_layer, rounded
from tracklane.runtime import new_path, store
from tracklane.sources.csv_files import convert_reference_tables, land_csv, read_sectioned, snake_case_headers
from tracklane.sources.layers import Lake, write_observed
from tracklane.sources.schemas import LANDING_TYPES
from tracklane.sources.star_schema import table


def _camel(name: str) -> str:
    return "".join(word.capitalize() for word in name.split("_"))


def csv_landing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results written as a CSV with CamelCase headers, landed again."""
    path = new_path(spark, "results-csv")
    out = landing_layer(spark, sf_dir).withColumnsRenamed({c: _camel(c) for c in LANDING_TYPES})
    out.write.option("header", True).csv(path)
    return rounded(land_csv(spark, path))


def headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    camel = orders.select(
        F.col("o_orderkey").alias("OrderKey"), F.col("o_totalprice").alias("Best3TotalKg"), F.col("o_orderstatus").alias("Status")
    )
    return snake_case_headers(camel)


def reference_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, target = new_path(spark, "reference-csv"), new_path(spark, "reference-tables")
    names = {}
    for name in ("nation", "region"):
        dim = table(spark, sf_dir, name)
        # A reference table is one small CSV file in the folder.
        staged = f"{source}-{name}"
        dim.coalesce(1).write.option("header", True).csv(staged)
        # The staged file carries Spark's part name, so its schema goes under that name.
        stems = {PurePosixPath(f).stem: dim.schema for f in spark.read.format("binaryFile").load(staged).inputFiles()}
        written = convert_reference_tables(spark, staged, f"{target}/{name}", stems)
        names[name] = next(iter(written.values()))
    nation, region = spark.read.parquet(names["nation"]), spark.read.parquet(names["region"])
    return nation.join(region, nation.n_regionkey == region.r_regionkey).select("n_nationkey", "n_name", "r_regionkey", "r_name")


def roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    lake = Lake(new_path(spark, "lake"))
    for _ in range(2):  # the second write replaces the first
        lake.write(table(spark, sf_dir, "orders"), "base", "orders", cluster_by=["o_custkey", "o_orderdate"])
    return lake.read(spark, "base", "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


def failed_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A write that dies midway leaves the table as it was; readers see whole versions only."""
    lake, orders = Lake(new_path(spark, "lake")), table(spark, sf_dir, "orders")
    lake.write(orders, "base", "orders")
    dies = F.when(F.col("o_orderkey") % 4 == 1, F.raise_error(F.lit("stopped midway"))).otherwise(F.lit("new"))
    try:
        lake.write(orders.withColumn("o_orderstatus", dies), "base", "orders")
    except PySparkException:
        return lake.read(spark, "base", "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    raise AssertionError("the write was to fail")


def published_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions, rows appended, and a step back: what each version reads."""
    lake, orders = Lake(new_path(spark, "lake")), table(spark, sf_dir, "orders")
    filled, open_orders = orders.filter("o_orderstatus = 'F'"), orders.filter("o_orderstatus = 'O'")
    steps = {
        "written": lambda: lake.write(orders, "base", "orders"),
        "replaced": lambda: lake.write(filled, "base", "orders"),
        "appended": lambda: lake.append(open_orders, "base", "orders"),
        "rolled back": lambda: lake.rollback(spark, "base", "orders"),
    }
    out = None
    for step, act in steps.items():
        act()
        seen = lake.read(spark, "base", "orders").groupBy("o_orderstatus").agg(
            F.count(F.lit(1)).alias("orders"), F.sum("o_custkey").alias("customers")
        )
        seen = store(seen.withColumn("step", F.lit(step)), "seen")
        out = seen if out is None else out.unionByName(seen)
    return out


def _sectioned(spark: SparkSession, sf_dir: str, path: str) -> None:
    """Result files, one a nation: title, names and values of the file, header, a row per supplier, some broken lines."""
    rows = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    quoted = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    line = F.concat_ws(",", F.col("s_suppkey").cast("string"), quoted(F.col("s_name")), F.lit(""), F.lit('"SBD, raw"'))
    line = F.when(F.col("s_suppkey") % 10 == 3, F.concat(line, F.lit(",more"))).when(F.col("s_suppkey") % 10 == 7, F.concat(F.lit('"'), line)).otherwise(line)
    body = rows.select("n_name", (F.col("s_suppkey") + 10).alias("_at"), line.alias("value"))
    above = F.array(
        F.lit('"Format v1","",'),
        F.lit(",,"),
        F.lit('"MeetName","MeetTown",'),
        F.concat(F.lit('"'), F.col("n_name"), F.lit('","",')),
        F.lit(",,"),
        F.lit('"Place","Name","Sex","Event"'),
    )
    top = rows.select("n_name").distinct().select("n_name", F.posexplode(above).alias("_at", "value")).withColumn("_at", F.col("_at").cast("long"))
    whole = body.unionByName(top).repartition("n_name").sortWithinPartitions("n_name", "_at")
    whole.select("n_name", "value").write.partitionBy("n_name").text(path)


def sectioned_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the files with what the section above says, as they are read back."""
    path = new_path(spark, "sectioned")
    _sectioned(spark, sf_dir, path)
    return read_sectioned(spark, path)[0].drop("file")


def sectioned_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines that do not fit, by reason, with where they stand."""
    path = new_path(spark, "sectioned")
    _sectioned(spark, sf_dir, path)
    rejects = read_sectioned(spark, path)[1]
    return rejects.groupBy("reason").agg(F.count(F.lit(1)).alias("lines"), F.sum("line").alias("places"), F.count_distinct("file").alias("files"))


def observed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = write_observed(landing_layer(spark, sf_dir), new_path(spark, "observed"))
    return spark.createDataFrame([(k, int(v)) for k, v in seen.items()], "metric string, value bigint")


QUERIES = {
    "land_csv": csv_landing,
    "snake_case_headers": headers,
    "reference_tables": reference_tables,
    "roundtrip": roundtrip,
    "observed_counts": observed_counts,
    "failed_write": failed_write,
    "published_versions": published_versions,
    "sectioned_results": sectioned_results,
    "sectioned_rejects": sectioned_rejects,
}

_DOUBLES = ("age", "bodyweight_kg", "best3_squat_kg", "best3_bench_kg", "best3_deadlift_kg", "total_kg", "wilks")
_LANDED = ", ".join(sql.r(c) if c in _DOUBLES else c for c in LANDING_TYPES)
_NULLS = " UNION ALL ".join(f"SELECT 'nulls_{c}', count(*) FILTER (WHERE {c} IS NULL) FROM results" for c in LANDING_TYPES)

_STEPS = {"written": "true", "replaced": "o_orderstatus = 'F'", "appended": "o_orderstatus IN ('F', 'O')", "rolled back": "o_orderstatus = 'F'"}
# where a supplier's line stands: six lines above, then the suppliers of its nation by key
_LINES = """SELECT s_suppkey, s_name, n_name, s_suppkey % 10 IN (3, 7) AS broken,
  6 + row_number() OVER (PARTITION BY n_name ORDER BY s_suppkey) AS line FROM supplier JOIN nation ON s_nationkey = n_nationkey"""

SQL = {
    "failed_write": "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders",
    "published_versions": " UNION ALL ".join(
        f"SELECT '{step}' AS step, o_orderstatus, count(*) AS orders, CAST(sum(o_custkey) AS BIGINT) AS customers FROM orders "
        f"WHERE {kept} GROUP BY o_orderstatus"
        for step, kept in _STEPS.items()
    ),
    "sectioned_results": f"""SELECT line, CAST(s_suppkey AS VARCHAR) AS place, s_name AS name, CAST(NULL AS VARCHAR) AS sex, 'SBD, raw' AS event,
  n_name AS meet_name, CAST(NULL AS VARCHAR) AS meet_town FROM ({_LINES}) WHERE NOT broken""",
    "sectioned_rejects": f"""SELECT CASE s_suppkey % 10 WHEN 3 THEN 'cells' ELSE 'quotes' END AS reason, count(*) AS lines,
  CAST(sum(line) AS BIGINT) AS places, count(DISTINCT n_name) AS files FROM ({_LINES}) WHERE broken GROUP BY 1""",
    "land_csv": sql.query(f"SELECT {_LANDED} FROM results", "results"),
    "snake_case_headers": 'SELECT o_orderkey AS order_key, o_totalprice AS best3_total_kg, o_orderstatus AS status FROM orders',
    "reference_tables": "SELECT n_nationkey, n_name, r_regionkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey",
    "roundtrip": "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders",
    "observed_counts": sql.query(f"SELECT 'rows' AS metric, count(*) AS value FROM results UNION ALL {_NULLS}", "results"),
}
