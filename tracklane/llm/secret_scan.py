"""Secret scans: patterns that stand alone, and weak parts that are linked with each other.

Strong spans (``assign``, ``access``, ``hex``) are always reported. Weak parts are
reported only where they complement each other within a scope of ``SCOPE`` code
points between starts:

* ``weak_id``      an identifier assignment with a secret of any kind near it,
* ``weak_secret``  a long mixed run with an identifier of any kind near it,
* ``endpoint``     an address with both an identifier and a secret near it.

Identifiers are ``access`` and ``weak_id``, secrets ``assign``, ``hex`` and
``weak_secret``. A weak part that overlaps a strong span is that span and is not
reported again. The scopes are an interval join on bins of ``SCOPE`` code points: a
bin holds at most as many parts as code points, whatever the length of the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklane.llm.common import table, text_of

SCOPE = 200
KINDS = ["assign", "access", "hex", "weak_id", "weak_secret", "endpoint"]

KEYWORDS = "password|passwd|secret|token|api_?key"
ASSIGN = rf"""(?i:({KEYWORDS}))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
WEAK_ID = r"""(?i:(client|account|user|access)_?(id|key_?id))["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.-]+"""
WEAK_SECRET = r"[A-Za-z0-9+/_=-]+"
ENDPOINT = r"https?://[A-Za-z0-9.-]+|[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"

SPAN = "array<struct<start:int,kind:int,end:int>>"
RUN = 512  # matches whose positions are added up at once: appending copies what is there


def spans(text: Column, pattern: str, kind: str, keep, group: int = 0) -> Column:
    """Leftmost non-overlapping matches whose ``group`` passes ``keep``, as (start, kind, end).

    The lengths of what lies between matches and of the matches give the positions: added up
    within runs of matches, then over the runs, so that many matches cost no square of their number.
    """
    between = F.transform(F.split(text, pattern, -1), F.length)
    whole = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.length)
    inner = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    parts = F.arrays_zip(between.alias("gap"), whole.alias("size"), inner.alias("part"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def step(state, x):
        begin = state["at"] + x["gap"]
        end = begin + F.coalesce(x["size"], F.lit(0))
        span = F.struct(begin.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), end.alias("end"))
        good = x["size"].isNotNull() & F.coalesce(keep(x["part"]), F.lit(False))
        return F.struct(end.alias("at"), F.when(good, F.array_append(state["out"], span)).otherwise(state["out"]).alias("out"))

    def moved(state, run):
        by = state["at"]
        shift = lambda s: F.struct((s["start"] + by).alias("start"), s["kind"].alias("kind"), (s["end"] + by).alias("end"))
        return F.struct(
            (by + run["at"]).alias("at"), F.array_append(state["out"], F.transform(run["out"], shift)).alias("out")
        )

    def of_runs(parts):
        first = F.sequence(F.lit(1), F.size(parts), F.lit(RUN))
        runs = F.transform(first, lambda i: F.aggregate(F.slice(parts, i, RUN), start, step))
        none = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))
        return F.aggregate(runs, none, moved, lambda state: F.flatten(state["out"]))

    # one element, so that the matches are found once and not for each run
    return F.get(F.transform(F.array(parts), of_runs), F.lit(0))


def strong_spans(text: Column) -> Column:
    """All strong spans; a text is searched only if it holds what a match begins with."""
    none = F.array().cast(SPAN)
    return F.concat(
        F.when(text.rlike(f"(?i){KEYWORDS}"), spans(text, ASSIGN, "assign", lambda p: F.length(p) >= 6, 2)).otherwise(none),
        F.when(F.contains(text, F.lit("AKIA")), spans(text, ACCESS, "access", lambda p: F.length(p) >= 20)).otherwise(none),
        F.when(text.rlike("[0-9a-f]{24}"), spans(text, HEX, "hex", lambda p: F.length(p) >= 24)).otherwise(none),
    )


def weak_spans(text: Column) -> Column:
    mixed = lambda p: (F.length(p) >= 16) & p.rlike("[0-9]") & p.rlike("[A-Za-z]")
    return F.concat(
        spans(text, WEAK_ID, "weak_id", lambda p: F.lit(True)),
        spans(text, WEAK_SECRET, "weak_secret", mixed),
        spans(text, ENDPOINT, "endpoint", lambda p: F.lit(True)),
    )


def linked(parts: DataFrame, keys: list[str], scope: int = SCOPE) -> DataFrame:
    """The weak parts that have their complement within ``scope``: keys, start, kind, end."""
    of = lambda *kinds: F.col("kind").isin([KINDS.index(k) for k in kinds])
    binned = parts.withColumn("bin", F.floor(F.col("start") / scope))
    near = (
        parts.filter(~of("endpoint"))
        .select(
            *[F.col(k).alias(f"_{k}") for k in keys],
            F.col("start").alias("_start"),
            of("access", "weak_id").alias("is_id"),
            F.explode(F.array(*[F.floor(F.col("start") / scope) + d for d in (-1, 0, 1)])).alias("_bin"),
        )
    )
    same = (F.col("bin") == F.col("_bin")) & (F.abs(F.col("start") - F.col("_start")) <= scope)
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    return (
        binned.filter(of("weak_id", "weak_secret", "endpoint"))
        .join(near, same)
        .groupBy(*keys, "start", "kind", "end")
        .agg(F.max("is_id").alias("with_id"), F.min("is_id").alias("without_secret"))
        .filter(
            F.when(of("weak_id"), ~F.col("without_secret"))
            .when(of("weak_secret"), F.col("with_id"))
            .otherwise(F.col("with_id") & ~F.col("without_secret"))
        )
        .select(*keys, "start", "kind", "end")
    )


def joined(found: Column) -> Column:
    name = lambda s: F.get(F.lit(KINDS), s["kind"])
    return F.array_join(F.transform(F.array_sort(found), lambda s: F.concat_ws(":", name(s), s["start"], s["end"])), ",")


def secret_scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: counts of strong spans, their digest, and all spans.

    A null text is empty, and an empty text has no span. A null key stays null. Rows
    that repeat key and text get equal results. Positions are code points, ends exclusive.
    """
    docs = docs.select(F.col(key).alias("key"), text_of(text).alias("text")).withColumn("digest", F.xxhash64("text"))
    base = docs.select("key", "digest", strong_spans(F.col("text")).alias("strong"))
    # weak parts matter only in texts that hold an identifier
    held = docs.filter(F.contains("text", F.lit("AKIA")) | F.col("text").rlike("(?i)(client|account|user|access)_?(id|key_?id)"))
    every = held.select(
        "key", "digest", strong_spans(F.col("text")).alias("strong"), weak_spans(F.col("text")).alias("weak")
    )
    apart = F.filter("weak", lambda w: ~F.exists("strong", lambda s: (w["start"] < s["end"]) & (s["start"] < w["end"])))
    parts = every.select("key", "digest", F.explode(F.concat("strong", apart)).alias("s")).select("key", "digest", "s.*").distinct()
    more = (
        linked(parts, ["key", "digest"])
        .groupBy("key", "digest")
        .agg(F.collect_list(F.struct("start", "kind", "end")).alias("weak"))
        .withColumnsRenamed({"key": "_key", "digest": "_digest"})
    )
    count = lambda kind: F.size(F.filter("strong", lambda s: s["kind"] == KINDS.index(kind))).cast("long")
    return base.join(more, F.col("key").eqNullSafe(F.col("_key")) & (F.col("digest") == F.col("_digest")), "left").select(
        F.col("key").alias(key),
        *[count(kind).alias(f"n_{kind}") for kind in ("assign", "access", "hex")],
        F.sha2(joined(F.col("strong")), 256).alias("base_sha256"),
        joined(F.concat("strong", F.coalesce("weak", F.array().cast(SPAN)))).alias("spans"),
    )


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op8_secret_scan": op8_secret_scan}


def _sql() -> str:
    quoted = lambda p: p.replace("'", "''")

    def part(kind, pattern, group, keep):
        p = quoted(pattern)
        return f"""
  SELECT doc_id, {KINDS.index(kind)} AS kind, a AS start, a + n AS stop, g FROM (
    SELECT doc_id, g[i] AS g, n[i] AS n,
           list_sum(list_transform(b[1:i], lambda x: length(x)))::BIGINT + coalesce(list_sum(n[1:i - 1]), 0)::BIGINT AS a
    FROM (SELECT *, unnest(range(1, len(n) + 1)) AS i FROM (
      SELECT doc_id, regexp_split_to_array(t, '{p}') AS b, regexp_extract_all(t, '{p}', {group}) AS g,
             list_transform(regexp_extract_all(t, '{p}', 0), lambda x: length(x)) AS n FROM d)))
  WHERE {keep}"""

    mixed = "length(g) >= 16 AND regexp_matches(g, '[0-9]') AND regexp_matches(g, '[A-Za-z]')"
    strong = [("assign", ASSIGN, 2, "length(g) >= 6"), ("access", ACCESS, 0, "length(g) >= 20"), ("hex", HEX, 0, "length(g) >= 24")]
    weak = [("weak_id", WEAK_ID, 0, "true"), ("weak_secret", WEAK_SECRET, 0, mixed), ("endpoint", ENDPOINT, 0, "true")]
    names = str(KINDS)
    text = f"string_agg({names}[kind + 1] || ':' || start || ':' || stop, ',' ORDER BY start, kind)"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
strong AS ({" UNION ALL ".join(part(*x) for x in strong)}),
weak AS (
  SELECT * FROM ({" UNION ALL ".join(part(*x) for x in weak)}) w
  WHERE NOT EXISTS (SELECT 1 FROM strong s WHERE s.doc_id = w.doc_id AND w.start < s.stop AND s.start < w.stop)
), parts AS (SELECT * FROM strong UNION ALL SELECT * FROM weak),
ids AS (SELECT * FROM parts WHERE kind IN (1, 3)), secrets AS (SELECT * FROM parts WHERE kind IN (0, 2, 4)),
linked AS (
  SELECT doc_id, kind, start, stop FROM (
    SELECT *, EXISTS (SELECT 1 FROM ids i WHERE i.doc_id = w.doc_id AND abs(i.start - w.start) <= {SCOPE}) AS i,
           EXISTS (SELECT 1 FROM secrets s WHERE s.doc_id = w.doc_id AND abs(s.start - w.start) <= {SCOPE}) AS s FROM weak w)
  WHERE (kind = 3 AND s) OR (kind = 4 AND i) OR (kind = 5 AND i AND s)
), every AS (SELECT doc_id, kind, start, stop FROM strong UNION ALL SELECT * FROM linked),
a AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n0, count(*) FILTER (kind = 1) AS n1, count(*) FILTER (kind = 2) AS n2, {text} AS base
      FROM strong GROUP BY doc_id),
b AS (SELECT doc_id, {text} AS spans FROM every GROUP BY doc_id)
SELECT d.doc_id, coalesce(n0, 0)::BIGINT AS n_assign, coalesce(n1, 0)::BIGINT AS n_access, coalesce(n2, 0)::BIGINT AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (doc_id) LEFT JOIN b USING (doc_id)
"""


SQL = {"op8_secret_scan": _sql()}
