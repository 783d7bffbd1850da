import pytest
from pyspark.sql import functions as F

from barloom.operators import signals as S
from barloom.operators import telemetry as L
from helpers import d, rows


def targets_df(spark, data):
    return spark.createDataFrame([(i, s, float(w)) for i, s, w in data],
                                 "signal_id int, symbol string, weight double")


def transition(spark, state, current, previous):
    signals = spark.createDataFrame(
        [(2, None if previous is None else 1, state)],
        "signal_id int, previous_signal_id int, state string")
    data = [(2, s, w) for s, w in current] + [(1, s, w) for s, w in previous or []]
    return S.target_transition(signals, targets_df(spark, data)).first().codes


@pytest.mark.parametrize("state,current,previous,codes", [
    ("ACTIVE", [("A", .6)], [("B", .2)], []),
    ("ACTIVE", [("A", .6), ("B", .5)], None, ["CURRENT_WEIGHT_ABOVE_ONE"]),
    ("ACTIVE", [("A", .1), ("A", .1)], None, ["CURRENT_DUPLICATE_SYMBOL"]),
    ("FLAT", [], [("A", .5)], []),
    ("FLAT", [("A", .1)], [("A", .5)], ["FLAT_NOT_EMPTY"]),
    ("HOLD", [("A", .5)], [("A", .5)], []),
    ("HOLD", [("A", .5)], None, ["HOLD_WITHOUT_PREVIOUS"]),
    ("HOLD", [("A", .4)], [("A", .5)], ["HOLD_CHANGED"]),
    ("HOLD", [], [("A", .5)], ["HOLD_CHANGED"]),
    ("REDUCE_ONLY", [("A", .4)], [("A", .5), ("B", .1)], []),
    ("REDUCE_ONLY", [], [("A", .5)], []),
    ("REDUCE_ONLY", [("C", .1)], [("A", .5)], ["REDUCE_ADDS_SYMBOL"]),
    ("REDUCE_ONLY", [("A", .6)], [("A", .5)], ["REDUCE_RAISES_WEIGHT"]),
    ("REDUCE_ONLY", [("A", .1)], None, ["REDUCE_WITHOUT_PREVIOUS"]),
])
def test_transitions(spark, state, current, previous, codes):
    assert transition(spark, state, current, previous) == codes


def test_constraints(spark):
    universe = spark.createDataFrame([("A", True), ("B", True), ("C", False)],
                                     "symbol string, eligible boolean")
    data = [(1, "A", .2), (1, "B", .2), (2, "A", .1), (2, "A", .1), (3, "C", .3), (3, "X", .1),
            (4, "A", .2), (4, "B", .2), (4, "C", .2)]
    out = S.portfolio_constraints(targets_df(spark, data), universe, 2, .25, .5)
    assert rows(out, "signal_id", "codes") == [
        (1, []), (2, ["DUPLICATE_SYMBOL"]),
        (3, ["INELIGIBLE_SYMBOL", "SINGLE_WEIGHT_EXCEEDED"]),
        (4, ["TOO_MANY_POSITIONS", "INELIGIBLE_SYMBOL", "GROSS_EXPOSURE_EXCEEDED"])]
    with pytest.raises(ValueError):
        S.portfolio_constraints(targets_df(spark, data), universe, 0, .25, .5)


@pytest.mark.parametrize("slice_rows", [100_000, 2])
def test_chain_audit(spark, monkeypatch, slice_rows):
    monkeypatch.setattr(S, "SLICE_ROWS", slice_rows)
    data = [  # chain, id, sequence, as_of, generated_at, run, hash, previous hash
        ("ok", 1, 1, "2026-01-05", 10, "r1", "h1", None),
        ("ok", 2, 2, "2026-01-06", 20, "r2", "h2", "h1"),
        ("ok", 3, 3, "2026-01-06", 30, "r3", "h3", "h2"),
        ("bad", 4, 2, "2026-01-06", 20, "r4", "h4", "h0"),
        ("bad", 5, 4, "2026-01-05", 20, "r4", "h5", "h9")]
    signals = spark.createDataFrame(
        [(c, i, s, d(t), g, r, h, p) for c, i, s, t, g, r, h, p in data],
        "chain string, signal_id int, sequence int, as_of date, generated_at int, run_id string, "
        "document_hash string, previous_signal_hash string")
    heads = signals.select("chain", "signal_id", F.col("as_of").alias("head_as_of"),
                           F.col("sequence").alias("head_sequence"),
                           F.when(F.col("signal_id") == 3, "other")
                           .otherwise(F.col("document_hash")).alias("head_signal_hash"))
    out = S.signal_chain_audit(signals, heads)
    assert rows(out, "signal_id", "codes") == [
        (1, []), (2, []), (3, ["HEAD_MISMATCH"]),
        (4, ["FIRST_SEQUENCE_NOT_ONE", "FIRST_HAS_PREVIOUS_HASH"]),
        (5, ["SEQUENCE_GAP", "PREVIOUS_HASH_MISMATCH", "AS_OF_DECREASES",
             "GENERATED_AT_NOT_LATER", "RUN_ID_REUSED"])]


def test_bindings(spark):
    schema = "run int, cost_model string, lockfile string"
    expected = spark.createDataFrame([(1, "a", "x"), (2, "a", "x"), (3, "a", None)], schema)
    actual = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (3, None, None)], schema)
    assert rows(S.binding_issues(expected, actual)) == [
        (2, "contract", "CHAMPION_COST_MODEL_MISMATCH"), (2, "hash", "CHAMPION_LOCKFILE_MISMATCH"),
        (3, "contract", "CHAMPION_COST_MODEL_MISMATCH")]


LOG = ("sequence int, api_name string, request_id int, offset int, page_limit int, "
       "outcome string, error_reason string, transient boolean, row_count int, page_hash string")


@pytest.mark.parametrize("slice_rows", [100_000, 2])
def test_telemetry(spark, monkeypatch, slice_rows):
    monkeypatch.setattr(L, "SLICE_ROWS", slice_rows)
    ok = ("SUCCESS", None, False)
    log = spark.createDataFrame([
        (1, "daily", 1, 0, 10, "FAILURE", "http_429", True, 0, None),
        (2, "daily", 1, 0, 10, *ok, 10, "a"),           # a retry
        (3, "daily", 1, 10, 10, *ok, 10, "a"),          # the same page again
        (4, "daily", 1, 20, 10, *ok, 3, "c"),
        (5, "daily", 1, 30, 10, *ok, 2, "d"),           # after a short page
        (6, "cal", 2, 0, 10, "FAILURE", "bad_request", False, 0, None),
        (7, "cal", 2, 0, 10, "FAILURE", "timeout", True, 0, None),  # not a retry
        (8, "cal", 2, 0, 10, *ok, 1, "e")], LOG)
    out = L.api_telemetry(log)
    assert rows(out.drop("reconciles")) == [
        ("(all)", 3, 6, 8, 5, 3, 2, 2, 1, 1), ("cal", 2, 2, 3, 1, 2, 1, 1, 0, 1),
        ("daily", 1, 4, 5, 4, 1, 1, 1, 1, 0)]
    assert out.where("not reconciles").count() == 0
    assert rows(L.page_audit(log), "sequence", "code") == [
        (3, "IDENTICAL_PAGE"), (5, "SHORT_PAGE_NOT_LAST")]


def test_too_many_pages(spark):
    log = spark.range(1, 204).select(
        F.col("id").cast("int").alias("sequence"), F.lit("daily").alias("api_name"),
        F.lit(1).alias("request_id"), (F.col("id") * 10).cast("int").alias("offset"),
        F.lit(10).alias("page_limit"), F.lit("SUCCESS").alias("outcome"),
        F.lit(None).cast("string").alias("error_reason"), F.lit(False).alias("transient"),
        F.lit(10).alias("row_count"), F.col("id").cast("string").alias("page_hash"))
    assert rows(L.page_audit(log), "page", "code") == [
        (n, "PAGE_LIMIT_EXCEEDED") for n in (201, 202, 203)]
