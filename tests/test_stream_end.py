"""A stream of ticks that ends with a closing tick gives every bar."""

from barloom.workload import fixtures as T
from barloom.workload.stream_queries import stream_bars
from helpers import rows


def test_all_bars_are_emitted(spark, sf):
    names = ("symbol", "trade_date", "open", "high", "low", "close", "volume", "amount")
    got, want = rows(stream_bars(spark, sf), *names), rows(T.bars(spark, sf), *names)
    assert len(got) == len(want)
    assert [r[:2] for r in got] == [r[:2] for r in want]
    assert got == want
