"""URL filters: rules on host and path, and a logistic regression for the rest.

Features are character n-grams of ``^host$`` and ``^path$``, hashed to ``DIM`` slots.
The regression is fitted by full-batch gradient steps, each one aggregate over
a small labelled table; the driver holds the ``DIM`` weights and nothing else.
Errors are summed as whole billionths, so the fit does not depend on the order of rows.

Everything is DataFrame functions. Judging a URL is a projection: no shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklane.llm.common import Scratch, table
from tracklane.llm.license_scan import LOWER, UPPER

DIM = 4096
GRAMS = (3, 4)
STEPS = 20
RATE = 0.3
LABELLED = 4000  # rows of the labelled table that the query draws from what the rules decide
UNIT = 1e9

# host, path, verdict
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#``, and from there up to ``?`` or ``#``."""
    at = F.instr(url, "://")
    rest = F.when(F.coalesce(at, F.lit(0)) > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def ruling(host: Column, path: Column, rules=RULES) -> Column:
    """(rule, verdict) of the longest rule that fits, else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule_host, rule_path, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit(rule_path))
        out = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _slot_of(text: Column, mark: str, n: int, dim: int):
    return lambda i: F.pmod(F.xxhash64(F.lit(f"{mark}{n}"), F.substring(text, i, F.lit(n))), F.lit(dim)).cast("int")


def slots(host: Column, path: Column, dim: int = DIM) -> Column:
    """The distinct hashed n-grams of a URL."""
    parts = []
    for mark, part in (("h", host), ("p", path)):
        bounded = F.concat(F.lit("^"), part, F.lit("$"))
        for n in GRAMS:
            last = F.length(bounded) - n + 1
            cut = F.transform(F.sequence(F.lit(1), last), _slot_of(bounded, mark, n, dim))
            parts.append(F.when(last >= 1, cut).otherwise(F.array().cast("array<int>")))
    return F.array_distinct(F.concat(*parts))


def probability(grams: Column, weights: list[float], bias: float) -> Column:
    """Logistic score; the weights travel in the plan as one constant of ``DIM`` numbers."""
    table_of = F.split(F.lit(",".join(map(repr, weights))), ",").cast("array<double>")
    size = F.sqrt(F.greatest(F.size(grams), F.lit(1)).cast("double"))
    total = F.aggregate(grams, F.lit(0.0), lambda acc, g: acc + F.get(table_of, g))
    return 1 / (1 + F.exp(-(F.lit(bias) + total / size)))


def fit(labelled: DataFrame, steps: int = STEPS, rate: float = RATE, dim: int = DIM) -> tuple[list[float], float]:
    """Weights and bias from a small table (url, label): label 1 is block. Classes weigh the same.

    Rows without url or label are left out; without rows of both classes all weights are 0.
    """
    scratch = Scratch(labelled.sparkSession, "url-filter")
    host, path = host_and_path(F.col("url"))
    rows = labelled.filter("url IS NOT NULL AND label IN (0, 1)").select(slots(host, path, dim).alias("grams"), "label")
    rows = scratch.store(rows.coalesce(1))
    n = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    weights, bias = [0.0] * dim, 0.0
    if set(n) == {0, 1}:
        weight = F.when(F.col("label") == 1, 0.5 / n[1]).otherwise(0.5 / n[0])
        speed, pull = [0.0] * (dim + 1), [0.0] * (dim + 1)
        size = F.sqrt(F.size("grams").cast("double"))
        for step in range(1, steps + 1):
            error = (probability(F.col("grams"), weights, bias) - F.col("label")) * weight
            scaled = lambda x: F.round(x * UNIT).cast("long")
            parts = rows.select("grams", error.alias("error"), size.alias("size"))
            per_slot = parts.select(F.explode(F.array_append("grams", F.lit(dim))).alias("slot"), "error", "size")
            share = F.when(F.col("slot") == dim, F.col("error")).otherwise(F.col("error") / F.col("size"))
            sums = per_slot.groupBy("slot").agg(F.sum(scaled(share)).alias("g")).collect()
            gradient = [0.0] * (dim + 1)
            for r in sums:
                gradient[r["slot"]] = r["g"] / UNIT
            for k, g in enumerate(gradient):
                g += 1e-4 * (weights[k] if k < dim else 0.0)
                speed[k] = 0.9 * speed[k] + 0.1 * g
                pull[k] = 0.99 * pull[k] + 0.01 * g * g
                move = rate * (speed[k] / (1 - 0.9**step)) / (math.sqrt(pull[k] / (1 - 0.99**step)) + 1e-6)
                if k < dim:
                    weights[k] -= move
                else:
                    bias -= move
    scratch.drop(rows)
    return weights, bias


def url_filter(pages: DataFrame, labelled: DataFrame, key: str = "page_id", url: str = "url", rules=RULES) -> DataFrame:
    """One row per row of ``pages``: host, path, rule, verdict, score (probability of block).

    Where no rule fits, the URL is blocked if its score is over 0.5. A null URL or one
    without ``://`` has empty host and path and is judged like any other URL without a rule.
    """
    weights, bias = fit(labelled)
    host, path = host_and_path(F.col("url"))
    parts = pages.select(F.col(key).alias("key"), F.col(url).alias("url")).select("key", host.alias("host"), path.alias("path"))
    judged = parts.select(
        "key",
        "host",
        "path",
        ruling(F.col("host"), F.col("path"), rules).alias("ruling"),
        F.round(probability(slots(F.col("host"), F.col("path")), weights, bias), 6).alias("score"),
    )
    by_score = F.when(F.col("score") > 0.5, "block").otherwise("allow")
    return judged.select(
        F.col("key").alias(key),
        "host",
        "path",
        F.col("ruling.rule").alias("rule"),
        F.coalesce("ruling.verdict", by_score).alias("verdict"),
        "score",
    )


def labelled_by_rules(pages: DataFrame, rows: int = LABELLED, rules=RULES) -> DataFrame:
    """A labelled table of at most ``rows`` distinct URLs that the rules decide, drawn by hash."""
    host, path = host_and_path(F.col("url"))
    verdict = ruling(host, path, rules)["verdict"]
    decided = pages.select("url", (verdict == "block").cast("int").alias("label")).filter("label IS NOT NULL").distinct()
    return decided.orderBy(F.xxhash64("url"), "url").limit(rows)


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter(pages, labelled_by_rules(pages))


QUERIES = {"op4_url_filter": op4_url_filter}

SQL: dict[str, str] = {}
