from datetime import datetime, timedelta

import pytest

from barloom import streaming as Z
from barloom.operators import features as X
from barloom.streaming.freshness import current_freshness, freshness_sink
from barloom.streaming.quality import two_sinks
from helpers import bars_df, d, random_walk, rows


def in_files(spark, parts, folder):
    """One Parquet file per part, read one per batch in file order."""
    for i, part in enumerate(parts):
        part.coalesce(1).write.mode("append").parquet(str(folder))
    return Z.stream_table(Z.streaming_session(spark, 4), str(folder), "*.parquet", 1)


def test_features_equal_the_batch_panel_and_late_bars_are_marked(spark, tmp_path):
    data = random_walk(["000001.SZ", "600000.SH"], 50)
    cuts = [d("2026-01-05"), d("2026-01-20"), d("2026-02-10"), d("2026-03-01")]
    parts = [bars_df(spark, [b for b in data if a <= b[1] < z]) for a, z in zip(cuts, cuts[1:])]
    late = bars_df(spark, [b for b in data if b[1] == d("2026-01-10")][:1])
    stream = in_files(spark, [*parts, late], tmp_path / "in")
    out = spark.read.parquet(Z.run_available(Z.stream_features(stream), "t-features"))
    assert rows(out.where("late"), "symbol", "trade_date") == [("000001.SZ", d("2026-01-10"))]
    got = {(r.symbol, r.trade_date): r for r in out.where("not late").collect()}
    want = X.feature_panel(bars_df(spark, data)).collect()
    assert len(got) == len(want) == 60
    for r in want:
        assert [got[(r.symbol, r.trade_date)][n] for n in X.FEATURE_NAMES] == pytest.approx(
            [r[n] for n in X.FEATURE_NAMES])


TICKS = "symbol string, ts timestamp, price double, seq long, volume long, amount decimal(18,2)"


def tick(s, day, hour, price, seq):
    at = datetime(2026, 1, 5) + timedelta(days=day, hours=hour)
    return (s, at, float(price), seq, 100, None)


def test_bars_drop_late_ticks(spark, tmp_path):
    first = [tick("A", 0, 9, 10, 1), tick("A", 0, 15, 12, 3), tick("A", 0, 12, 9, 2),
             tick("A", 5, 9, 20, 4)]
    # The watermark of a batch drops late rows from the batch after the next one on.
    second = [tick("A", 5, 12, 21, 5)]
    third = [tick("A", 0, 10, 99, 6), tick("A", 9, 9, 30, 7)]
    parts = [spark.createDataFrame(p, TICKS) for p in (first, second, third)]
    stream = in_files(spark, parts, tmp_path / "in")
    out = spark.read.parquet(Z.run_available(Z.stream_bars(stream), "t-bars"))
    assert rows(out, "trade_date", "open", "high", "low", "close", "volume") == [
        (d("2026-01-05"), 10, 12, 9, 12, 300), (d("2026-01-10"), 20, 21, 20, 21, 200)]


def test_dedup_across_batches(spark, tmp_path):
    rows_in = [("k", 1), ("k", 2), ("m", 2), ("k", 3)]
    parts = [spark.createDataFrame([(k, datetime(2026, 1, 5, h), h)],
                                   "k string, ts timestamp, n int") for k, h in rows_in]
    stream = in_files(spark, parts, tmp_path / "in")
    out = spark.read.parquet(Z.run_available(Z.stream_dedup(stream, ["k"]), "t-dedup"))
    assert [r[0] for r in rows(out, "k")] == ["k", "m"]


def test_quality_sinks(spark, tmp_path):
    raw = [("000001.SZ", d("2026-01-05"), 10., 11., 9., 10., 100., 100.),
           ("000001.SZ", d("2026-01-06"), 0., 11., 9., 10., 100., 100.)]
    schema = ("ts_code string, trade_date date, open double, high double, low double, "
              "close double, vol double, amount double")
    stream = in_files(spark, [spark.createDataFrame([r], schema) for r in raw], tmp_path / "in")
    asked = stream.sparkSession.createDataFrame([("000001.SZ",)], "symbol string")
    judged = Z.stream_quality(stream, asked, "2026-01-01", "2026-12-31")
    out = str(tmp_path / "out")
    Z.run_available(judged, "t-quality", each_batch=two_sinks(out))
    assert rows(spark.read.parquet(f"{out}/valid"), "trade_date") == [(d("2026-01-05"),)]
    assert rows(spark.read.parquet(f"{out}/quarantine"), "reason_code") == [
        ("NON_POSITIVE_VALUE",)]


def test_freshness_keeps_the_newest_rating(spark, tmp_path):
    days = [d(f"2026-01-{n:02d}") for n in range(5, 10)]
    parts = [spark.createDataFrame([("A", days[0]), ("B", days[0])], "symbol string, "
                                                                   "trade_date date"),
             spark.createDataFrame([("A", days[4])], "symbol string, trade_date date")]
    stream = in_files(spark, parts, tmp_path / "in")
    cal = stream.sparkSession.createDataFrame([(t,) for t in days], "trade_date date")
    out = str(tmp_path / "out")
    Z.run_available(Z.stream_freshness(stream), "t-fresh", "update",
                    each_batch=freshness_sink(out, cal, "2026-01-09"))
    assert rows(current_freshness(spark, out), "name", "lag_sessions", "reason_codes") == [
        ("A", 0, []), ("B", 4, ["DATA_STALE"])]
