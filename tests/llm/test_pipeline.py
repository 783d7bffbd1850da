"""The pipeline: each stage against its definition on a small table."""

from pyspark.sql import functions as F

import corpus_pipeline
from barloom.llm import queries, stages

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark):
    line = "this line stands in several documents of the table"
    body = " ".join(f"word{i}" for i in range(60))
    rows = [
        (1, f"{line}\n{body}", "en", "a"), (2, f"{line}\n{body} extra", "en", "b"),
        (3, f"{line}\nown text of document three goes here", None, "b"), (4, None, "en", "a"),
        (5, "12345 !!", "en", "a"), (6, "", "fr", "c"), (7, "une ligne du document sept", "fr", "c"),
        (7, "une ligne du document sept", "fr", "c"), (8, line, "en", "a"),
    ]
    return spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], SCHEMA)


def test_stages_on_a_small_table(spark):
    docs = table(spark)
    kept = stages.language(spark, docs, "")
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 3, 7, 7, 8]
    assert kept.where("lang is null").count() == 0 and kept.columns == docs.columns
    lines = stages.line_dedup(spark, kept, "")
    texts = {r["doc_id"]: r["text"] for r in lines.collect()}
    assert set(texts) == {1, 2, 3, 7} and "several" not in texts[3]
    assert all(r["n_chars"] == len(r["text"]) for r in lines.collect())
    near = stages.near_dedup(spark, lines.union(lines.where("doc_id = 3")), "")
    assert sorted(r["doc_id"] for r in near.collect()) == [1, 2, 3, 7] or sorted(
        r["doc_id"] for r in near.collect()) == [1, 3, 7]
    mixed = stages.mixing(spark, near, "")
    assert mixed.columns == docs.columns
    packed = stages.packing(spark, mixed, "")
    want = {r["doc_id"] for r in mixed.collect()}
    assert {r["doc_id"] for r in packed.collect()} == want


def test_near_stage_keeps_one_of_each_group(spark):
    body = " ".join(f"word{i}" for i in range(100))
    rows = [(i, f"{body} tail{i}", "en", "a", 1) for i in (9, 4, 6)] + [
        (20, "a clean document with its own words", "en", "a", 1), (30, None, "en", None, 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(r["doc_id"] for r in stages.near_dedup(spark, df, "").collect()) == [4, 20, 30]


def test_columns_that_clash_with_inner_names_are_kept(spark):
    docs = table(spark).withColumns({c: F.lit(f"own {c}") for c in (
        "mix_copies", "mix_copy", "_again", "again", "exact", "rid", "_c", "_kept", "row")})
    for name, stage in stages.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns, name
        assert {r["mix_copies"] + r["_again"] + r["_c"] for r in out.collect()} == {
            "own mix_copiesown _againown _c"}, name


def test_empty_table_runs_through(spark):
    docs = table(spark).limit(0)
    for _, stage in stages.STAGES:
        docs = stage(spark, docs, "")
        assert docs.count() == 0
        if "start" not in docs.columns:
            docs = spark.createDataFrame([], docs.schema)


def test_run_gives_pieces_of_kept_documents(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert out.count() > 0
    assert out.join(docs, "doc_id", "left_anti").count() == 0
    assert out.selectExpr("max(length)", "max(offset + length)").first()[1] <= 1024


def test_thirteen_queries_are_registered():
    assert sorted(int(q[2:].split("_")[0]) for q in queries.QUERIES) == list(range(1, 14))
    assert set(queries.ORACLES) <= set(queries.QUERIES)
