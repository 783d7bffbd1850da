"""Queries that read the bars of a model many times build them from ticks once."""

from barloom.workload import model_queries


def test_the_document_reads_stored_bars_and_no_ticks(spark, sf, capsys):
    model_queries.model_document(spark, sf).explain()
    plan = capsys.readouterr().out
    assert "model-bars" in plan and "lineitem" not in plan
