from datetime import datetime

import pytest
from pyspark.sql import functions as F

from barloom import functions as X
from helpers import d, rows


def one(spark, column, **values):
    names = list(values)
    df = spark.createDataFrame([tuple(values.values())], ", ".join(
        f"{n} {t}" for n, t in zip(names, [
            "double" if isinstance(v, float) else "string" for v in values.values()])))
    return df.select(column).first()[0]


@pytest.mark.parametrize("text,ok", [
    ("000001.SZ", True), ("600000.SH", True), ("430001.BJ", True), ("00001.SZ", False),
    ("000001.HK", False), ("x000001.SZ", False), ("000001.SZ\n", False), ("T600018.SH", False)])
def test_valid_symbol(spark, text, ok):
    assert one(spark, X.valid_symbol("s"), s=text) is ok


@pytest.mark.parametrize("text,want", [
    ("20230930", d("2023-09-30")), ("20230931", None), ("2023093", None), ("2023-09-3", None),
    ("20240229", d("2024-02-29")), ("20230229", None)])
def test_vendor_date(spark, text, want):
    assert one(spark, X.vendor_date("s"), s=text) == want


@pytest.mark.parametrize("value,ok", [
    (1.0, True), (0.0, True), (float("nan"), False), (float("inf"), False),
    (float("-inf"), False)])
def test_finite(spark, value, ok):
    assert one(spark, X.finite("v"), v=value) is ok


def test_nonfinite_markers(spark):
    values = [(float("nan"),), (float("inf"),), (float("-inf"),), (1.0,)]
    got = [r[0] for r in spark.createDataFrame(values, "v double").select(
        X.nonfinite_marker("v")).collect()]
    assert got == ["NaN", "Infinity", "-Infinity", None]


@pytest.mark.parametrize("symbol,board", [
    ("688001.SH", "star"), ("300001.SZ", "gem"), ("301001.SZ", "gem"), ("302001.SZ", "gem"),
    ("303001.SZ", "main"), ("600000.SH", "main"), ("430001.BJ", "unsupported")])
def test_board(spark, symbol, board):
    assert one(spark, X.board("s"), s=symbol) == board


@pytest.mark.parametrize("clock,label", [
    ("09:14", "CLOSED"), ("09:15", "PRE_OPEN"), ("09:29", "PRE_OPEN"), ("09:30", "OPEN"),
    ("11:29", "OPEN"), ("11:30", "MIDDAY_BREAK"), ("12:59", "MIDDAY_BREAK"), ("13:00", "OPEN"),
    ("14:59", "OPEN"), ("15:00", "CLOSED")])
def test_session_label(spark, clock, label):
    at = datetime.fromisoformat(f"2026-07-27T{clock}:00")
    df = spark.createDataFrame([(at,)], "t timestamp_ntz")
    assert df.select(X.session_label("t", F.lit(True))).first()[0] == label
    assert df.select(X.session_label("t", F.lit(None).cast("boolean"))).first()[0] == "HOLIDAY"


GOOD = dict(execution_data_valid=True, previous_target_known=True, decision_data_valid=True,
            contracts_valid=True, hashes_valid=True, champion="HEALTHY", risk_action="NONE")


@pytest.mark.parametrize("change,state", [
    ({}, "ACTIVE"), ({"execution_data_valid": False, "risk_action": "FLAT"}, "HOLD"),
    ({"previous_target_known": False}, "HOLD"), ({"risk_action": "FLAT"}, "FLAT"),
    ({"risk_action": "FLAT", "champion": "WITHDRAWN"}, "FLAT"),
    ({"champion": "WITHDRAWN", "hashes_valid": False}, "REDUCE_ONLY"),
    ({"risk_action": "REDUCE"}, "REDUCE_ONLY"), ({"contracts_valid": False}, "HOLD"),
    ({"champion": "NEVER_ACTIVATED"}, "FLAT"),
    ({"champion": "NEVER_ACTIVATED", "decision_data_valid": False}, "HOLD"),
    ({"execution_data_valid": None}, "HOLD")])
def test_resolve_state(spark, change, state):
    values = {**GOOD, **change}
    schema = ", ".join(f"{k} {'string' if k in ('champion', 'risk_action') else 'boolean'}"
                       for k in values)
    df = spark.createDataFrame([tuple(values.values())], schema)
    assert df.select(X.resolve_state()).first()[0] == state


def test_redaction(spark):
    df = spark.createDataFrame(
        [([("api_Token", "abc"), ("date", "20230601"), ("note", "hush")],
          "code " + "deadbeef01" + " tail " + "x" * 300)],
        "params array<struct<name:string,value:string>>, message string")
    got = df.select(X.redact_params("params", F.lit("hush")).alias("p"),
                    X.mask_message("message").alias("m")).first()
    assert [(p.name, p.value) for p in got.p] == [
        ("api_Token", "***"), ("date", "20230601"), ("note", "***")]
    assert got.m.startswith("code *** tail xx") and "deadbeef" not in got.m


def test_source_identity_keeps_only_the_host(spark):
    df = spark.createDataFrame(
        [("https://API.Example.org:8080/x?token=1",), ("http://other.example.com/y",),
         ("ftp://api.example.org/",), ("nonsense",)], "url string")
    got = rows(df.select(*X.source_columns("url", "api.example.org")).fillna("-"))
    assert got == [("-", False, "INVALID_URL", "-"), ("-", False, "INVALID_URL", "-"),
                   ("api.example.org", True, "official", "-"),
                   ("other.example.com", False, "non-official", "NON_OFFICIAL_VENDOR_ENDPOINT")]


def test_execution_price_is_exact(spark):
    df = spark.createDataFrame([(10.1, "buy"), (10.1, "sell")], "open double, side string")
    got = [r[0] for r in df.select(X.execution_price("open", "side", 10)).collect()]
    assert got == [10.1101, 10.0899]


def test_price_limits_have_a_tolerance(spark):
    df = spark.createDataFrame([(11.0, 10.0), (10.99, 10.0)], "p double, c double")
    got = [r[0] for r in df.select(X.limit_up(F.col("p"), F.col("c"), F.lit(0.1))).collect()]
    assert got == [True, False]
