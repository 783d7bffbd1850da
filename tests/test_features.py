import math

import pytest
from pyspark.sql import functions as F

from barloom.operators import bars as B
from barloom.operators import calendars as C
from barloom.operators import features as X
from barloom.operators import model as G
from helpers import bars_df, d, random_walk, rows

SYMBOLS = ["000001.SZ", "600000.SH", "300001.SZ"]


@pytest.fixture(scope="module")
def walk():
    return random_walk(SYMBOLS, 60)


def brute(history):
    """Features of the last bar of a history, in plain Python."""
    close = [b[5] for b in history]
    v, a = [b[6] for b in history], [b[7] for b in history]
    mean = lambda x: sum(x) / len(x)
    std = math.sqrt(mean([(x - mean(a[-20:])) ** 2 for x in a[-20:]]))
    high, low = max(b[3] for b in history[-20:]), min(b[4] for b in history[-20:])
    return [*[close[-1] / close[-1 - n] - 1 for n in (1, 5, 10, 20)], v[-1] / mean(v[-5:]),
            v[-1] / mean(v[-20:]), (a[-1] - mean(a[-20:])) / std, close[-1] / high,
            (close[-1] - low) / (high - low)]


def test_panel_equals_brute_force(spark, walk):
    got = {(r.symbol, r.trade_date): r for r in X.feature_panel(bars_df(spark, walk)).collect()}
    assert len(got) == len(SYMBOLS) * 40
    for s in SYMBOLS:
        history = [b for b in walk if b[0] == s]
        for i in (20, 33, 59):
            row = got[(s, history[i][1])]
            assert [row[n] for n in X.FEATURE_NAMES] == pytest.approx(brute(history[:i + 1]))


def test_flat_series_have_defaults(spark):
    flat = [("000001.SZ", b[1], 10, 10, 10, 10, 0, 0) for b in random_walk(["000001.SZ"], 21)]
    row = X.feature_panel(bars_df(spark, flat)).first()
    assert [row[n] for n in X.FEATURE_NAMES] == [0, 0, 0, 0, 1.0, 1.0, 0.0, 1.0, 0.5]


def test_future_rows_and_row_order_change_nothing(spark, walk):
    cut = "2026-02-20"
    early = bars_df(spark, [b for b in walk if b[1] <= d(cut)])
    whole = bars_df(spark, walk).repartition(5).orderBy(F.rand(3))
    mutated = whole.withColumn("close", F.when(F.col("trade_date") > d(cut), 999.0)
                               .otherwise(F.col("close")))
    want = rows(X.feature_panel(early))
    for panel in (X.feature_panel(whole, as_of=cut), X.feature_panel(mutated, as_of=cut),
                  B.as_of(X.feature_panel(mutated), cut)):
        assert rows(panel) == want
    assert rows(X.feature_replay(early)) == rows(X.feature_replay(mutated, as_of=cut))


def test_panel_difference_sees_a_change(spark, walk):
    panel = X.feature_panel(bars_df(spark, walk))
    assert X.panel_difference(panel, panel).count() == 0
    other = panel.withColumn("ret_1d", F.when(F.col("trade_date") == d("2026-02-20"), 9.0)
                             .otherwise(F.col("ret_1d")))
    assert X.panel_difference(panel, other).count() == 2 * len(SYMBOLS)


def test_reading_past_the_dataset_is_an_error(spark, walk):
    with pytest.raises(ValueError, match="past the as-of date"):
        X.feature_panel(bars_df(spark, walk), as_of="2026-03-01", dataset_as_of="2026-02-20")


def test_replay_slice(spark):
    bars = bars_df(spark, [("000001.SZ", f"2026-07-{n}", c, c, c, c, v, v * c) for n, c, v in
                           ((27, 10, 100), (28, 11, 120), (29, 12, 150))]
                   + [("600000.SH", "2026-07-28", 8, 8, 8, 8, 80, 640)])
    got = rows(X.feature_replay(bars))
    assert got[0][2:] == (None, 1.0)
    assert got[1][2:] == (0.1, round(120 / 110, 12))
    assert got[2][2:] == (round(12 / 11 - 1, 12), round(150 / (370 / 3), 12))
    assert got[3] == ("600000.SH", d("2026-07-28"), None, 1.0)


def test_labels_follow_the_symbols_own_rows(spark, walk):
    # 600000.SH skips ten sessions, so its label ends far later than the calendar implies.
    gap = [b for b in walk if not (b[0] == "600000.SH" and d("2026-02-01") <= b[1] <
                                   d("2026-02-11"))]
    bars = bars_df(spark, gap)
    index = C.calendar_index(C.sessions(bars))
    at = {(r.symbol, r.trade_date): r for r in X.forward_labels(bars, (1, 3)).collect()}
    row = at[("600000.SH", d("2026-01-31"))]
    assert row.label_end_1 == d("2026-02-11")
    cut = "2026-02-05"
    safe = {(r.symbol, r.trade_date): r for r in X.safe_labels(bars, index, cut, (1, 3)).collect()}
    assert max(t for _, t in safe) == d(cut)
    assert safe[("600000.SH", d("2026-01-31"))].label_1 is None
    assert safe[("000001.SZ", d("2026-01-31"))].label_1 is not None
    assert safe[("000001.SZ", d("2026-02-04"))].label_1 is not None
    assert safe[("000001.SZ", d("2026-02-04"))].label_3 is None
    assert safe[("000001.SZ", d(cut))].label_1 is None
    ends = [r.label_end_3 for r in safe.values() if r.label_end_3]
    assert max(ends) <= d(cut)


def test_split_and_leak_checks(spark, walk):
    bars = bars_df(spark, walk)
    index = C.calendar_index(C.sessions(bars))
    split = G.walk_forward_split(index).first()
    days = sorted({b[1] for b in walk})
    n = len(days)
    assert tuple(split) == (days[int(n * .6) - 1], days[int(n * .6)], days[int(n * .78) - 1],
                            days[int(n * .78)])
    assert {(r.check_id, r.status) for r in G.audit_leaks(bars).collect()} == {
        (c, "pass") for c in (
            "temporal_split_monotonic", "label_window_inside_train",
            "training_rows_time_ordered", "validation_labels_outside_test",
            "feature_pit_truncation_invariant", "universe_fixed_audit_set_disclosed")}
    with pytest.raises(Exception, match="at least 40 sessions"):
        G.walk_forward_split(index.where("idx < 39")).collect()


def test_each_leak_is_found(spark, walk):
    bars = bars_df(spark, walk)
    index = C.calendar_index(C.sessions(bars))
    split = G.walk_forward_split(index)
    found = split.first()
    scored = X.panel_with_labels(bars, (5,)).withColumn("score", F.col("ret_20d"))
    good = dict(
        matrix=G.training_matrix(bars, index, found.train_end),
        pairs=G.validation_pairs(scored, index), split=split,
        panel=X.feature_panel(bars).where(F.col("trade_date") <= F.lit(found.validation_end)),
        replayed=X.feature_panel(bars, as_of=found.validation_end))
    late = F.date_add(F.lit(found.train_end), 1)
    planted = {
        "temporal_split_monotonic": dict(split=split.withColumn("validation_end", late).withColumn(
            "validation_start", F.date_add(late, 1))),
        "label_window_inside_train": dict(matrix=good["matrix"].withColumn("label_end_3", late)),
        "training_rows_time_ordered": dict(matrix=good["matrix"].withColumn("trade_date", late)),
        "validation_labels_outside_test": dict(pairs=good["pairs"].withColumn(
            "label_end", F.lit(found.test_start))),
        "feature_pit_truncation_invariant": dict(replayed=good["replayed"].withColumn(
            "ret_5d", F.col("ret_5d") + 1)),
        "universe_fixed_audit_set_disclosed": dict(universe_disclosed=False),
    }
    for check, leak in planted.items():
        failed = {r.check_id for r in G.leak_checks(**(good | leak)).collect()
                  if r.status == "fail"}
        assert failed == {check}, (check, failed)


def test_models_are_repeatable(spark):
    bars = bars_df(spark, random_walk([f"{n:06d}.SZ" for n in range(6)], 90))
    index = C.calendar_index(C.sessions(bars))
    cutoff = G.walk_forward_split(index).first().train_end
    matrix = G.training_matrix(bars, index, cutoff)
    panel = X.feature_panel(bars)
    scores = [rows(G.score_panel(panel, G.fit_multi_horizon(matrix, (1, 3), maxIter=2)),
                   "symbol", "trade_date", "score") for _ in range(2)]
    assert scores[0] == scores[1] and len(scores[0]) == panel.count()
    with pytest.raises(ValueError, match="fewer than"):
        G.fit_multi_horizon(matrix.limit(3), (1,), maxIter=1)
