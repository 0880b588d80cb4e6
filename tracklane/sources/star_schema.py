"""Star-schema tables seen as a results file: one order is one result of one customer."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklane.config import SETTINGS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Narrow panel straight from one scan: entity, date, tie-break and a measure."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("entity"),
        F.col("o_orderdate").cast("date").alias("date"),
        F.col("o_orderkey").alias("tie"),
        F.col("o_totalprice").alias("total"),
        "o_orderstatus",
        "o_orderpriority",
    )


def segmented_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders panel with the segment of its customer: region and market."""
    customer, nation = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    return (
        orders_panel(spark, sf_dir)
        .join(customer, F.col("entity") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select("entity", "date", "tie", "total", F.col("n_regionkey").alias("region"), F.col("c_mktsegment").alias("market"))
    )


def events_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("entity"), F.col("ts").alias("date"), F.col("event_id").alias("tie"), F.col("value").alias("total")
    )


def order_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per order: quantities, discounts and revenue, split by return flag.

    Sums run on whole cents, so they do not depend on the order of addition.
    """

    def exact_sum(value: Column) -> Column:
        return F.sum(F.round(value * 100).cast("bigint")) / 100.0

    price = F.col("l_extendedprice")
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey")
        .agg(
            F.count(F.lit(1)).alias("n_lines"),
            exact_sum(F.col("l_quantity")).alias("qty"),
            exact_sum(F.col("l_discount")).alias("disc"),
            exact_sum(price).alias("ext"),
            exact_sum(F.when(F.col("l_returnflag") == "R", price)).alias("ext_r"),
            exact_sum(F.when(F.col("l_returnflag") == "A", price)).alias("ext_a"),
            exact_sum(F.when(F.col("l_returnflag") == "N", price)).alias("ext_n"),
        )
    )


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landing-shaped results derived from orders, lineitem, customer and nation."""
    customer, nation = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    wide = (
        table(spark, sf_dir, "orders")
        .join(order_parts(spark, sf_dir), F.col("o_orderkey") == F.col("l_orderkey"), "left")
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    )
    age = (
        F.year("o_orderdate")
        - (1940 + F.col("c_custkey") % 40)
        + 0.5 * (F.col("c_custkey") % 2).cast("double")
        - F.when(F.col("o_orderkey") % 23 == 0, 1.0).otherwise(0.0)
    )
    wide = wide.select(
        *["o_orderstatus", "o_orderpriority", "n_regionkey", "n_name", "c_mktsegment", "c_name"],
        *["n_lines", "qty", "disc", "ext", "ext_r", "ext_a", "ext_n"],
        F.when(F.col("o_orderkey") % 97 != 0, age).alias("age"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"),
        (F.floor(F.col("o_totalprice") / 250.0) / 2.0).alias("total"),  # half kilograms
    )
    status, priority, region = F.col("o_orderstatus"), F.col("o_orderpriority"), F.col("n_regionkey")
    age, day, total = F.col("age"), F.col("day"), F.col("total")
    meet = (
        F.when(priority == "1-URGENT", "World Cup")
        .when(priority == "2-HIGH", "National Open")
        .when(priority == "3-MEDIUM", "State Titles")
        .when(priority == "4-NOT SPECIFIED", "International Classic")
    )
    return wide.select(
        day.alias("date"),
        F.concat_ws(" ", "c_mktsegment", "c_name", "n_name").alias("name"),
        F.when(region.isin(0, 1), "M").when(region.isin(2, 3), "F").otherwise("Mx").alias("sex"),
        F.when(priority == "4-NOT SPECIFIED", "DQ").otherwise(F.substring(priority, 1, 1)).alias("place"),
        age,
        _age_class(age).alias("age_class"),
        (35.0 + 2.0 * F.try_divide("qty", "n_lines")).alias("bodyweight_kg"),
        F.when((status == "P") & (priority == "3-MEDIUM"), "B").otherwise("SBD").alias("event"),
        status.alias("meet_country"),
        F.when((status == "O") & (priority == "1-URGENT"), "Wraps").otherwise("Raw").alias("equipment"),
        F.try_divide(total * F.col("ext_r"), "ext").alias("best3_squat_kg"),
        F.try_divide(total * F.col("ext_a"), "ext").alias("best3_bench_kg"),
        (F.try_divide(total * F.col("ext_n"), "ext") + 50.0 * F.try_divide("disc", "n_lines")).alias("best3_deadlift_kg"),
        total.alias("total_kg"),
        (3.0 * F.col("qty")).alias("wilks"),
        F.when((status == "F") & (priority == "5-LOW"), F.lit(None)).otherwise("Yes").alias("tested"),
        F.col("c_mktsegment").alias("federation"),
        F.concat(meet, F.lit(" "), F.substring(day, 1, 7)).alias("meet_name"),
        F.col("n_name").alias("country"),
        F.concat(F.lit("S"), region.cast("string")).alias("state"),
        F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).alias("parent_federation"),
        F.col("n_lines").cast("string").alias("weight_class_kg"),
    )


def _age_class(age: Column) -> Column:
    """Class whose years hold ``floor(age)``."""
    years = F.floor(age)
    spans = {label: tuple(map(int, label.split("-"))) for label in SETTINGS.age_class_midpoint}
    return reduce(
        lambda chain, item: chain.when(years.between(*item[1]), item[0]),
        spans.items(),
        F.when(age.isNull(), F.lit(None)),
    )
