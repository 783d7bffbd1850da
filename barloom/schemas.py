"""Fixed schemas of the tables read from and written to storage."""

from __future__ import annotations

from pyspark.sql import types as T


def _fields(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in columns.items()])


STRING, DATE, DOUBLE, LONG, INT = (
    T.StringType(), T.DateType(), T.DoubleType(), T.LongType(), T.IntegerType())

BARS = _fields(symbol=STRING, trade_date=DATE, open=DOUBLE, high=DOUBLE, low=DOUBLE,
               close=DOUBLE, volume=DOUBLE, amount=DOUBLE)
RAW_BARS = _fields(ts_code=STRING, trade_date=DATE, open=DOUBLE, high=DOUBLE, low=DOUBLE,
                   close=DOUBLE, vol=DOUBLE, amount=DOUBLE)
TRADE_CALENDAR = _fields(exchange=STRING, cal_date=DATE, is_open=INT, pretrade_date=DATE)
SECURITIES = _fields(ts_code=STRING, symbol=STRING, name=STRING, area=STRING, industry=STRING,
                     market=STRING, list_date=DATE, delist_date=DATE, list_status=STRING)
SUSPENSIONS = _fields(ts_code=STRING, trade_date=DATE, suspend_timing=STRING,
                      suspend_type=STRING)
ADJ_FACTORS = _fields(ts_code=STRING, trade_date=DATE, adj_factor=DOUBLE)
ENVELOPES = _fields(sequence=LONG, api_name=STRING, code=INT,
                    fields=T.ArrayType(STRING), items=T.ArrayType(T.ArrayType(STRING)))
#: One row per file of a published dataset; what holds for the whole dataset is on every row.
MANIFEST = _fields(
    dataset_id=STRING, file_count=LONG, dataset_family=STRING, normalization_version=STRING,
    as_of=DATE, source=STRING, source_version=STRING, generated_at=STRING, fingerprint=STRING,
    path=STRING, file_size=LONG, row_count=LONG, min_trade_date=DATE, max_trade_date=DATE,
    s0=LONG, s1=LONG, s2=LONG, s3=LONG, run=STRING)
