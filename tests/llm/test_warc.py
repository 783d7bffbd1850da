"""WARC: an exact round trip of payloads, and transactions of whole captures."""

import base64
import hashlib

import pytest

from barloom.llm.tables import fresh_path
from barloom.llm.warc import (
    assemble_transactions, parse_records, read_records, warc_field, write_captures,
)

HTML = [
    (1, "http://a/", "<p>one</p>"), (2, "http://b/", "<p>one</p>"), (3, None, None),
    (4, "http://d/\r\nX: y", ""), (5, "http://e/", "é😀\r\n\r\nWARC/1.1\r\nContent-Length: 9\r\n\r\n"),
    (6, "http://f/", "x" * 300_000), (2, "http://b/", "<p>one</p>"), (None, "http://n/", "no id"),
]


def captures(spark, rows, **options):
    df = spark.createDataFrame([(*r, 0) for r in rows],
                               "page_id long, url string, html string, payload int")
    path = fresh_path(spark, "warc-test")
    write_captures(df, path, **options)
    return path, assemble_transactions(read_records(spark, path))


@pytest.mark.parametrize("per_file", [2, 3000])
def test_round_trip(spark, per_file):
    _, nested = captures(spark, HTML, records_per_file=per_file)
    rows = nested.withColumn("page", warc_field(nested["metadata"][0]["block"], "page-id")).collect()
    assert len(rows) == len(HTML)
    ids = {r["main"]["record_id"]: r["page"] for r in rows}
    assert all(r["main"]["refers_to"] in ids for r in rows if r["main"]["type"] == "revisit")
    kinds = sorted((r["page"] or "", r["main"]["type"], ids.get(r["main"]["refers_to"]) or "")
                   for r in rows)
    assert kinds == sorted((a, b, c or "") for a, b, c in [
        ("1", "response", None), ("2", "revisit", "1"),
        ("2", "revisit", "1"), ("3", "response", None),
        ("4", "revisit", "3"), ("5", "response", None), ("6", "response", None),
        ("", "response", None)])
    texts = {str(i or ""): t or "" for i, _, t in HTML}
    for r in rows:
        assert len(r["requests"]) == len(r["metadata"]) == 1
        payload = texts[r["page"] or ""].encode()
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        assert r["main"]["declared_digest"] == "sha1:" + digest
        if r["main"]["type"] == "response":
            assert r["main"]["payload"] == payload
            assert r["main"]["payload_digest"] == digest
            assert r["main"]["payload_bytes"] == len(payload)


def test_small_payloads_are_all_responses(spark):
    _, nested = captures(spark, [(1, "u", "ab"), (2, "u", "ab")], least=3)
    assert [r["main"]["type"] for r in nested.collect()] == ["response"] * 2


def test_empty_table_and_loose_records(spark):
    path, nested = captures(spark, [])
    assert nested.count() == 0
    records = spark.createDataFrame(
        [("r1", "request", None, "gone", None, None, None, None, None, None, None),
         ("m1", "response", None, None, None, None, None, None, b"x", 1, "d")],
        read_records(spark, path).schema)
    got = {r["capture_id"]: (r["main"], r["requests"]) for r in
           assemble_transactions(records).collect()}
    assert got["gone"][0] is None and len(got["gone"][1]) == 1
    assert got["m1"][0]["payload"] == b"x" and got["m1"][1] is None


def test_cut_archives_raise():
    whole = b"WARC/1.1\r\nContent-Length: 4\r\n\r\nabcd\r\n\r\n"
    assert [b for _, b in parse_records(whole * 2)] == [b"abcd"] * 2
    for cut in (whole[:-8], whole[:12], b"junk"):
        with pytest.raises(ValueError):
            list(parse_records(cut))
