"""Pipeline stages judge rows, not ids: what happens to rows that share an id, have none, or repeat."""

from __future__ import annotations

from tracklane.llm import decontaminate, near_dedup

A, B = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))


def test_near_dedup_stage_keeps_clean_rows_that_share_an_id(spark):
    rows = [(0, B, "x"), (1, A, "y"), (1, B + " more", "z"), (2, "own words of a text here", "x"), (2, "own words of a text here", "y")]
    rows += [(None, A, "n"), (3, None, "e"), (4, "", "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    out = near_dedup.stage(spark, docs, "")
    assert out.columns == docs.columns
    kept = sorted((r.doc_id if r.doc_id is not None else -1, r.text or "") for r in out.collect())
    assert kept == [(-1, A), (0, B), (1, A), (2, "own words of a text here"), (3, ""), (4, "")]
    assert near_dedup.stage(spark, docs.limit(0), "").count() == 0


def test_decontaminate_stage_judges_each_row(spark, tmp_path):
    item = "what is the seventh planet counted from the sun and how many moons does it have today"
    spark.createDataFrame([(7, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [("a", f"before {item} after", 1), ("a", B, 2), (None, item, 3), (None, A, 4), ("c", None, 5)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, score int")
    out = decontaminate.stage(spark, docs, str(tmp_path))
    assert out.columns == docs.columns and sorted(r.score for r in out.collect()) == [2, 4, 5]
    benchmark = spark.read.parquet(str(tmp_path / "benchmark.parquet"))
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, benchmark).collect()} == {("a", 7), (None, 7)}
