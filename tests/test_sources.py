import glob
import json
import os
import shutil
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from barloom import sources as O
from barloom.schemas import ENVELOPES
from barloom.sources.datasets import DatasetError, bar_text_columns
from barloom.sources.vendor import split_securities
from helpers import bars_df, d, random_walk, rows

META = dict(as_of="2026-03-31", source="test", source_version="1",
            generated_at="2026-04-01T00:00:00Z")


@pytest.fixture(scope="module")
def bars(spark):
    return bars_df(spark, random_walk(["000001.SZ", "600000.SH"], 40))


def test_publish_load_and_identity(spark, bars, tmp_path):
    root = str(tmp_path)
    first = O.publish_dataset(bars, root, **META)
    again = O.publish_dataset(bars.repartition(7).orderBy(F.rand(1)), root,
                              **{**META, "generated_at": "2026-05-01T00:00:00Z"})
    other = O.publish_dataset(bars, root, **{**META, "source_version": "2"})
    assert first == again != other
    assert rows(O.load_dataset(spark, root, first)) == rows(bars)
    early = O.load_dataset(spark, root, first, as_of="2026-01-10")
    assert early.agg(F.max("trade_date")).first()[0] == d("2026-01-10")
    with pytest.raises(DatasetError, match="past the as-of"):
        O.load_dataset(spark, root, first, as_of="2026-04-01")


def test_publication_is_refused(spark, bars, tmp_path):
    with pytest.raises(DatasetError, match="quality"):
        O.publish_dataset(bars, str(tmp_path), quality_passed=False, **META)
    with pytest.raises(DatasetError, match="empty"):
        O.publish_dataset(bars.limit(0), str(tmp_path), **META)
    with pytest.raises(DatasetError, match="past the as-of"):
        O.publish_dataset(bars, str(tmp_path), **{**META, "as_of": "2026-01-10"})
    assert not (tmp_path / "manifests").exists()


def files_of(root):
    return sorted(glob.glob(f"{root}/datasets/*/year=*/*.parquet"))


def test_tampering_is_found(spark, bars, tmp_path):
    root = str(tmp_path)
    dataset = O.publish_dataset(bars, root, evidence={"keys": bars.select("symbol")}, **META)
    (index,) = glob.glob(f"{root}/evidence/{dataset}/*/index")
    assert spark.read.parquet(index).first().row_count == bars.count()
    assert O.verify_files(spark, root, dataset).where("size(codes) > 0").count() == 0
    path = files_of(root)[0]
    changed = spark.read.parquet(path).withColumn("close", F.col("close") + F.lit(0.001))
    changed.coalesce(1).write.parquet(f"{root}/changed")
    (other,) = glob.glob(f"{root}/changed/*.parquet")
    shutil.copy(other, path)  # the same name, another content
    for crc in glob.glob(f"{os.path.dirname(path)}/.*.crc"):
        os.remove(crc)
    bad = {r.path: r.codes for r in O.verify_files(spark, root, dataset).where(
        "size(codes) > 0").collect()}
    assert set(bad) == {"/".join(path.split("/")[-2:])}
    assert "DIGEST_MISMATCH" in bad["/".join(path.split("/")[-2:])]
    with pytest.raises(DatasetError, match="DIGEST_MISMATCH"):
        O.load_dataset(spark, root, dataset)
    shutil.copy(other, path.replace("part-", "part-9"))
    codes = {c for r in O.verify_files(spark, root, dataset).collect() for c in r.codes}
    assert "UNDECLARED_FILE" in codes
    os.remove(path)
    codes = {c for r in O.verify_files(spark, root, dataset).collect() for c in r.codes}
    assert "MISSING_FILE" in codes


def test_two_publishers_at_once_leave_one_intact_dataset(spark, bars, tmp_path):
    root = str(tmp_path)
    with ThreadPoolExecutor(2) as pool:
        ids = list(pool.map(lambda _: O.publish_dataset(bars, root, **META), range(2)))
    assert ids[0] == ids[1]
    assert rows(O.load_dataset(spark, root, ids[0])) == rows(bars)
    assert O.read_manifest(spark, root, ids[0]).select("run").distinct().count() == 1
    with pytest.raises(DatasetError, match="not published"):
        O.load_dataset(spark, root, "dataset-sha256-0")


def test_key_order_over_files(spark, bars, tmp_path):
    dated, keys = bars.withColumn("year", F.year("trade_date")), ["symbol", "trade_date"]

    def found(df, name, *order):
        df.sortWithinPartitions("year", *order, *keys).write.partitionBy("year").parquet(
            f"{tmp_path}/{name}")
        return sorted((r.inversions, r.overlaps) for r in
                      O.pk_order(spark, f"{tmp_path}/{name}").collect())

    assert found(dated.repartitionByRange(3, *keys), "sorted") == [(0, False)] * 3
    late = F.col("trade_date") == "2026-01-20"  # one row of each symbol goes to the end
    assert found(dated.coalesce(1), "swapped", late) == [(1, False)]
    assert found(dated.repartition(2, "trade_date"), "mixed") == [(0, False), (0, True)]


def test_fingerprint_depends_on_every_cell(spark, bars):
    def digest(df, **identity):
        return O.dataset_fingerprint(df, bar_text_columns(), {"as_of": "x", **identity}).first()[1]

    base = digest(bars)
    assert digest(bars.repartition(5, "close")) == base
    assert digest(bars.union(bars.limit(1))) != base
    assert digest(bars, source="y") != base
    for column in ("open", "volume", "amount"):
        assert digest(bars.withColumn(column, F.col(column) + F.when(
            F.col("trade_date") == d("2026-01-09"), 1.0).otherwise(0.0))) != base


def test_verify_codes(spark):
    stat = "path string, row_count long, min_trade_date date, max_trade_date date"
    a, b = d("2026-01-05"), d("2026-01-09")
    observed = spark.createDataFrame([("a", 5, a, b), ("b", 5, a, b), ("c", 5, a, b)], stat)
    declared = spark.createDataFrame([("a", 5, a, b), ("b", 6, b, b), ("d", 5, a, b)], stat)
    got = {r.path: r.codes for r in O.verify_dataset(observed, declared, "2026-01-09").collect()}
    assert got["a"] == [] and got["b"] == ["ROW_COUNT_MISMATCH", "MIN_DATE_MISMATCH"]
    assert "UNDECLARED_FILE" in got["c"] and "MISSING_FILE" in got["d"]


def test_scan_checks_the_schema_and_pushes_the_date(spark, bars, tmp_path):
    path = str(tmp_path / "bars")
    bars.write.parquet(path)
    scanned = O.scan_bars(spark, path, "2026-01-20")
    assert scanned.agg(F.max("trade_date")).first()[0] == d("2026-01-20")
    plan = scanned._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(trade_date), LessThanOrEqual(trade_date" in plan
    odd = str(tmp_path / "odd")
    bars.withColumn("extra", F.lit(1)).drop("amount").write.parquet(odd)
    with pytest.raises(ValueError, match=r"missing=\['amount'\] extra=\['extra'\]"):
        O.scan_bars(spark, odd, "2026-01-20")


def test_json_bars(spark, tmp_path):
    good = dict(symbol="000001.SZ", trade_date="2026-01-05", open=1.0, high=2.0, low=1.0,
                close=1.5, volume=10.0, amount=15.0)
    cases = {"good": [good, {**good, "trade_date": "2026-01-06"}], "extra": [{**good, "x": 1}],
             "short": [good, {k: v for k, v in good.items() if k != "close"}],
             "text": [{**good, "close": "high"}]}
    for name, data in cases.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(data))
    assert O.scan_json_bars(spark, str(tmp_path / "good.json"), "2026-01-05").count() == 1
    for name in ("extra", "short", "text"):
        with pytest.raises(Exception):
            O.scan_json_bars(spark, str(tmp_path / f"{name}.json"), "2026-01-05").collect()


def test_envelopes_do_not_depend_on_field_order(spark):
    fields = ["ts_code", "trade_date"]
    table = spark.createDataFrame([
        (1, "daily", 0, fields, [["A", "1"], ["B", "2"]]),
        (2, "daily", 0, fields[::-1], [["3", "C"]]),
        (3, "daily", 0, ["ts_code"], [["D"]]),
        (4, "daily", 0, fields + ["x"], [["D", "4", "5"]]),
        (5, "daily", 0, fields, [["E", "5"], ["F"]])], ENVELOPES)
    assert rows(O.scan_raw_envelopes(table, fields), "ts_code", "trade_date") == [
        ("A", "1"), ("B", "2"), ("C", "3")]
    assert rows(O.envelope_findings(table, fields)) == [
        (3, "MISSING_FIELDS"), (4, "EXTRA_FIELDS"), (5, "ROW_WIDTH")]


def test_securities(spark):
    base = ("L", "600018.SH", "600018", "Port", None, None, "", "20000101", None, "L")
    def row(**change):
        names = ("batch", "ts_code", "symbol", "name", "area", "industry", "market", "list_date",
                 "delist_date", "list_status")
        return tuple({**dict(zip(names, base)), **change}.values())
    raw = spark.createDataFrame([
        row(), row(ts_code="T600018.SH", symbol="T600018"), row(ts_code="TS0018.SH", symbol="TS0018"),
        row(ts_code="600019.SH", symbol="600018"), row(ts_code="600020.SH", symbol="600020",
                                                       delist_date="19990101"),
        row(ts_code="600021.SH", symbol="600021", list_date="20230931"),
        row(ts_code="600022.SH", symbol="600022", list_status="D")],
        "batch string, ts_code string, symbol string, name string, area string, industry string, "
        "market string, list_date string, delist_date string, list_status string")
    judged = O.parse_securities(raw)
    assert rows(judged.fillna("-"), "ts_code", "reason_code") == [
        ("600018.SH", "-"), ("600019.SH", "CODE_SYMBOL_MISMATCH"),
        ("600020.SH", "DELIST_BEFORE_LIST"), ("600021.SH", "INVALID_LIST_DATE"),
        ("600022.SH", "STATUS_MISMATCH"), ("T600018.SH", "INVALID_VENDOR_TS_CODE"),
        ("TS0018.SH", "INVALID_VENDOR_TS_CODE")]
    accepted, rejected = split_securities(judged)
    assert rows(accepted, "ts_code", "area", "list_date") == [("600018.SH", "", d("2000-01-01"))]
    assert rejected.count() == 6 and "name" not in rejected.columns
    assert rows(O.parse_securities(raw.union(raw.limit(1))).fillna("-"), "ts_code",
                "reason_code")[:2] == [("600018.SH", "DUPLICATE_KEY")] * 2
