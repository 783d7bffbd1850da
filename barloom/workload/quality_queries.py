"""Queries on raw rows, the quality gate, coverage and request evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import sources as O
from ..operators import coverage as V
from ..operators import quality as Q
from ..operators import signals as S
from ..operators import telemetry as L
from ..operators.calendars import small
from ..session import fresh_path, stored, wide_session
from ..sources.datasets import STORED
from . import fixtures as T
from .registry import query

W = (T.WINDOW_START, T.WINDOW_END)
WINDOW_SQL = f"between date '{T.WINDOW_START}' and date '{T.WINDOW_END}'"


def joined_codes(df, column="codes"):
    return df.withColumn(column, F.array_join(column, ","))


# Quality gate ---------------------------------------------------------------------------

JUDGED = f"""
select ts_code as symbol, trade_date, case
  when ts_code not in (select symbol from requested) then 'REQUEST_SYMBOL_MISMATCH'
  when trade_date not {WINDOW_SQL} then 'REQUEST_DATE_MISMATCH'
  when copies > 1 then 'DUPLICATE_DAILY_BAR'
  when isnan(open) or isinf(open) then 'NON_FINITE_VALUE' when open <= 0 then 'NON_POSITIVE_VALUE'
  when isnan(high) or isinf(high) then 'NON_FINITE_VALUE' when high <= 0 then 'NON_POSITIVE_VALUE'
  when isnan(low) or isinf(low) then 'NON_FINITE_VALUE' when low <= 0 then 'NON_POSITIVE_VALUE'
  when isnan(close) or isinf(close) then 'NON_FINITE_VALUE'
  when close <= 0 then 'NON_POSITIVE_VALUE'
  when isnan(vol) or isinf(vol) then 'NON_FINITE_VALUE' when vol < 0 then 'NEGATIVE_VALUE'
  when isnan(amount) or isinf(amount) then 'NON_FINITE_VALUE' when amount < 0 then 'NEGATIVE_VALUE'
  when (vol = 0) <> (amount = 0) then 'INCONSISTENT_ZERO_TURNOVER'
  when low > least(open, close) or high < greatest(open, close) or low > high
    then 'INVALID_OHLC'
  when vol > 0 and (amount * 1000 / (vol * 100) < low * (1.0 - 0.05::double)
    or amount * 1000 / (vol * 100) > high * (1.0 + 0.05::double)) then 'VWAP_OUTSIDE_OHLC_BAND'
  end as reason_code, vol * 100 as volume
from (select *, count(*) over (partition by ts_code, trade_date) as copies from raw_bars)"""


@query("normalize_bars", f"""
select symbol, trade_date, reason_code,
  case when reason_code is null then cast(round(volume) as bigint) end as volume
from ({JUDGED})""")
def normalize_bars(spark, sf):
    judged = Q.judge_bars(T.raw_bars(spark, sf), T.requested(spark, sf), *W)
    shares = F.when(F.col("reason_code").isNull(), F.round("volume")).cast("bigint")
    return judged.select("symbol", "trade_date", "reason_code", shares.alias("volume"))


@query("quarantine_markers", f"""
select symbol, trade_date, reason_code, case when isnan(close) then 'NaN' end as close_marker,
  cast(null as varchar) as vol_marker
from (select j.*, r.close from ({JUDGED}) j join (select distinct ts_code, trade_date, close
    from raw_bars) r on r.ts_code = j.symbol and r.trade_date = j.trade_date)
where reason_code is not null""")
def quarantine_markers(spark, sf):
    """Rejected rows as they are kept, with labels for numbers that JSON cannot hold."""
    _, rejected = Q.normalize_bars(T.raw_bars(spark, sf), T.requested(spark, sf), *W)
    return rejected.select("symbol", "trade_date", "reason_code", "close_marker", "vol_marker")


@query("implied_vwap_check", """
select ts_code as symbol, trade_date, case when (vol = 0) <> (amount = 0)
  then 'INCONSISTENT_ZERO_TURNOVER' when vol < 0 then 'INVALID_IMPLIED_VWAP'
  else 'VWAP_OUTSIDE_OHLC_BAND' end as reason_code
from raw_bars where (vol = 0) <> (amount = 0) or vol < 0
  or (vol > 0 and (amount * 1000 / (vol * 100) < low * (1.0 - 0.05::double)
    or amount * 1000 / (vol * 100) > high * (1.0 + 0.05::double)))""")
def implied_vwap_check(spark, sf):
    return Q.implied_vwap_check(Q.with_units(T.raw_bars(spark, sf)))


@query("ohlc_check", """
select ts_code as symbol, trade_date, open, high, low from raw_bars
where low > high or low > least(open, close) or high < greatest(open, close)""")
def ohlc_check(spark, sf):
    return Q.ohlc_check(Q.with_units(T.raw_bars(spark, sf))).drop("close")


@query("closed_day_bars", """
select b.symbol, b.trade_date, case when dayofweek(b.trade_date) = 0 then 'CLOSED_DAY'
  else 'OUTSIDE_LIFECYCLE' end as reason_code
from bars b left join lifecycles l on l.symbol = b.symbol
where dayofweek(b.trade_date) = 0 or b.trade_date < listed_on or b.trade_date > delisted_on""")
def closed_day_bars(spark, sf):
    return Q.closed_day_bars(T.bars(spark, sf), T.open_days(spark, sf), T.lifecycles(spark, sf))


@query("unknown_keys", """
select distinct ts_code as symbol from raw_bars where ts_code not in (select symbol from requested)
""")
def unknown_keys(spark, sf):
    raw = T.raw_bars(spark, sf).select(F.col("ts_code").alias("symbol"))
    return Q.unknown_keys(raw, T.requested(spark, sf), "symbol")


@query("daily_factor_alignment", """
with sides as (select coalesce(b.symbol, f.ts_code) as symbol,
    coalesce(b.trade_date, f.trade_date) as trade_date,
    case when f.ts_code is null then 'daily_only' when b.symbol is null then 'factor_only'
      else 'matched' end as class
  from bars b full join (select distinct ts_code, trade_date from adj_factors) f
    on f.ts_code = b.symbol and f.trade_date = b.trade_date)
select class, count(*) as keys, case when class <> 'matched' then
  string_agg(symbol || ' ' || cast(trade_date as varchar), ';' order by symbol, trade_date)
    filter (n <= 20) end as samples
from (select *, row_number() over (partition by class order by symbol, trade_date) as n from sides)
group by class""".replace("with sides as (", "select * from (with sides as (", 1) + ")")
def daily_factor_alignment(spark, sf):
    spark = wide_session(spark)
    factors = T.adj_factors(spark, sf).withColumnRenamed("ts_code", "symbol")
    return Q.daily_factor_alignment(T.bars(spark, sf), factors)


@query("dataset_diff", """
select count(*) filter (a.k is null) as new_only, count(*) filter (b.k is null) as old_only,
  count(*) filter (a.k is not null and b.k is not null) as in_both,
  count(*) filter (a.k is not null and b.k is not null and a.close <> b.close) as close_changed,
  count(*) filter (a.k is not null and b.k is not null and a.volume <> b.volume) as volume_changed
from (select * from kbars where dayofyear(trade_date) % 31 <> 0) a
full join (select k, trade_date, case when dayofyear(trade_date) % 7 = 0 then close + 1 else close
    end as close, volume + case when k % 9 = 0 then 100 else 0 end as volume
  from kbars where dayofyear(trade_date) % 29 <> 0) b
on a.k = b.k and a.trade_date = b.trade_date""")
def dataset_diff(spark, sf):
    bars = T.keyed_bars(spark, sf)
    doy = F.dayofyear("trade_date")
    old = bars.where(doy % 31 != 0)
    new = bars.where(doy % 29 != 0).select(
        "k", "trade_date", F.when(doy % 7 == 0, F.col("close") + 1).otherwise(F.col("close"))
        .alias("close"),
        (F.col("volume") + F.when(F.col("k") % 9 == 0, 100).otherwise(0)).alias("volume"))
    return Q.dataset_diff(old, new, ["k", "trade_date"], ["close", "volume"])


# Coverage -------------------------------------------------------------------------------

def _expected(spark, sf):
    return V.expected_member_days(T.memberships(spark, sf), T.lifecycles(spark, sf),
                                  T.open_days(spark, sf), *W)


def _wanted(spark, sf):
    return V.member_days(T.memberships(spark, sf), T.lifecycles(spark, sf),
                         T.open_days(spark, sf), *W)


def _classified(spark, sf):
    return V.coverage_classify(_wanted(spark, sf), T.bars(spark, sf), T.suspensions(spark, sf))


@query("expected_member_days", "select symbol, trade_date from expected")
def expected_member_days(spark, sf):
    return _expected(spark, sf).select("symbol", "trade_date")


@query("coverage_classify", "select symbol, trade_date, class from classified")
def coverage_classify(spark, sf):
    return _classified(spark, sf).drop("delisted_on")


ANOMALIES = f"""
select trade_date, actual_count, 60::bigint as expected_count from (
  select d.trade_date, count(e.symbol) as actual_count
  from (select * from open_days where trade_date {WINDOW_SQL}) d
  left join expected e on e.trade_date = d.trade_date group by 1) where actual_count <> 60"""


@query("member_count_anomalies", ANOMALIES)
def member_count_anomalies(spark, sf):
    return V.member_count_anomalies(_expected(spark, sf), T.open_days(spark, sf), 60, *W)


@query("silent_skips", """
select symbol, count(*) as expected from classified
where symbol in (select ts_code from securities where k % 10 = 9) group by 1
having count(*) filter (trade_date = delisted_on) = 0
union all select symbol, count(*) from classified group by 1
having count(*) filter (class <> 'MISSING') = 0
  and symbol not in (select ts_code from securities where k % 10 = 9)""")
def silent_skips(spark, sf):
    # A planted outage: one symbol in ten delivers no bars and no suspensions, and the
    # delisting day is the only evidence it could leave.
    out = T.instruments(spark, sf).where("k % 10 = 9").select(
        T.symbol_of(F.col("k")).alias("symbol"))
    bars = T.bars(spark, sf).join(out, "symbol", "left_anti")
    stopped = T.suspensions(spark, sf).join(
        out.withColumnRenamed("symbol", "ts_code"), "ts_code", "left_anti")
    return V.silent_skips(V.coverage_classify(_wanted(spark, sf), bars, stopped))


@query("delisted_in_scope", f"""
select symbol, max(delisted_on) as delisted_on from expected group by 1
having max(delisted_on) <= date '{T.WINDOW_END}'""")
def delisted_in_scope(spark, sf):
    return V.delisted_in_scope(_classified(spark, sf), T.WINDOW_END)


@query("coverage_summary", f"""
select *, codes = '' as passed, codes as reason_codes from (
  select *, concat_ws(',', case when missing_days > 0 then 'MISSING_MEMBER_DAYS' end,
    case when silent_symbols > 0 then 'SILENT_MEMBER_SKIP' end,
    case when anomalous_sessions > 0 then 'MEMBER_COUNT_ANOMALY' end) as codes
  from (select count(*) as expected_days, count(*) filter (class = 'BAR') as bar_days,
      count(*) filter (class = 'SUSPENDED') as suspended_days,
      count(*) filter (class = 'EXPECTED_DELISTED') as delisted_days,
      count(*) filter (class = 'MISSING') as missing_days,
      (select count(*) from (select symbol from classified group by 1
        having count(*) filter (class <> 'MISSING') = 0)) as silent_symbols,
      (select count(*) from open_days where trade_date {WINDOW_SQL}) as sessions,
      (select count(*) from ({ANOMALIES})) as anomalous_sessions
    from classified))""".replace("select *, codes = '' as passed",
                                 "select * exclude (codes), codes = '' as passed"))
def coverage_summary(spark, sf):
    summary = V.coverage_summary(_classified(spark, sf), T.open_days(spark, sf), 60, *W)
    return joined_codes(summary, "reason_codes")


@query("class_reconciliation", """
select symbol, count(*) as expected, count(distinct trade_date) as distinct_days,
  0::bigint as clashing_days, count(*) filter (class is not null) as classified, true as reconciles
from classified group by 1""")
def class_reconciliation(spark, sf):
    return V.class_reconciliation(_classified(spark, sf))


@query("membership_overlap", """
select symbol, valid_from, valid_to, reach as overlaps_until from (
  select *, max(coalesce(valid_to, date '9999-12-31')) over (partition by symbol
    order by valid_from rows between unbounded preceding and 1 preceding) as reach
  from memberships) where valid_from <= reach""")
def membership_overlap(spark, sf):
    return V.membership_overlap(T.memberships(spark, sf))


@query("evidence_keys", f"""
select symbol, trade_date, trade_date {WINDOW_SQL} as in_window from (
  select symbol, trade_date from bars union select ts_code, trade_date from suspensions)""")
def evidence_keys(spark, sf):
    return V.evidence_keys(T.bars(spark, sf), T.suspensions(spark, sf), *W)


@query("suspension_evidence", """
select distinct symbol from lifecycles where symbol not in (
  select s.ts_code from suspensions s join lifecycles l on l.symbol = s.ts_code
  join open_days d on d.trade_date = s.trade_date
  where suspend_type = 'S' and s.trade_date >= listed_on
    and s.trade_date <= coalesce(delisted_on, date '9999-12-31')
    and substr(s.ts_code, 6, 1) not in ('3', '8'))""")
def suspension_evidence(spark, sf):
    # Symbols whose code ends in 3 or 8 show no suspended session, only resumed ones.
    kind = F.when(F.substring("ts_code", 6, 1).isin("3", "8"), "R").otherwise(
        F.col("suspend_type"))
    shown = T.suspensions(spark, sf).withColumn("suspend_type", kind)
    return V.suspension_evidence(T.lifecycles(spark, sf), shown, T.open_days(spark, sf),
                                 T.lifecycles(spark, sf))


# Sources --------------------------------------------------------------------------------

@query("scan_bars", f"select * from bars where trade_date <= date '{T.AS_OF}'")
def scan_bars(spark, sf):
    path = fresh_path(spark, "bars")
    T.bars(spark, sf).write.parquet(path)
    return O.scan_bars(spark, path, T.AS_OF)


@query("scan_raw_envelopes", f"""
select k * 10000 + year(trade_date) as sequence,
  case k % 5 when 0 then '600' when 1 then '000' when 2 then '300' when 3 then '688' else '430'
    end || lpad(cast(k // 5 as varchar), 3, '0') || case k % 5 when 0 then '.SH' when 1 then '.SZ'
    when 2 then '.SZ' when 3 then '.SH' else '.BJ' end as ts_code,
  strftime(trade_date, '%Y%m%d') as trade_date, cast(cast(volume as bigint) as varchar) as vol
from kbars where (k * 10000 + year(trade_date)) % 11 <> 0
  and (k * 10000 + year(trade_date)) % 13 <> 0""")
def scan_raw_envelopes(spark, sf):
    rows = O.scan_raw_envelopes(T.envelopes(spark, sf), ["ts_code", "trade_date", "vol"])
    return rows.drop("row_number")


def _duplicates_last(keys):
    """Outer query that marks repeated keys among the rows without a code."""
    return f"""case when code is null and count(*) filter (code is null) over (partition by {keys})
      > 1 then 'DUPLICATE_KEY' else code end as reason_code"""


@query("parse_trade_cal", f"""
select exchange, raw_date, cal_date, is_open, pretrade_date, {_duplicates_last('exchange, cal_date')}
from (select *, case when exchange <> 'SSE' then 'EXCHANGE_MISMATCH'
    when cal_date is null then 'INVALID_DATE'
    when cal_date not {WINDOW_SQL} then 'DATE_OUTSIDE_WINDOW'
    when is_open not in (0, 1) then 'INVALID_IS_OPEN'
    when doy % 47 = 0 then 'INVALID_PRETRADE_DATE' end as code
  from (select case when doy % 43 = 0 then 'SZSE' else exchange end as exchange, doy,
      case when doy % 37 = 0 then year(cal_date) || '0931' else strftime(cal_date, '%Y%m%d') end
        as raw_date, case when doy % 37 <> 0 then cal_date end as cal_date,
      case when doy % 41 = 0 then 2 else is_open end as is_open,
      case when doy % 47 <> 0 and doy % 53 <> 0 then pretrade_date end as pretrade_date
    from (select *, dayofyear(cal_date) as doy from trade_calendar),
      (select 1 as copy union all select 2) where copy = 1 or doy % 59 = 0))""")
def parse_trade_cal(spark, sf):
    return O.parse_trade_cal(T.raw_calendar(spark, sf), "SSE", *W)


PARSED_SECURITIES = f"""
select batch, ts_code, symbol, name, coalesce(area, '') as area, industry,
  coalesce(market, '') as market, list_date, delist_date, list_status,
  sha256(concat_ws('|', '=' || ts_code, '=' || symbol, '=' || name, coalesce('=' || area, '~'),
    '=' || industry, coalesce('=' || market, '~'), '=' || list_text,
    coalesce('=' || delist_text, '~'), '=' || list_status)) as row_fingerprint,
  ts_code as vendor_ts_code,
  coalesce(code, case when copies > 1 then 'DUPLICATE_KEY' end,
    case when ts_code like 'T%' then 'INVALID_VENDOR_TS_CODE' end) as reason_code
from (select *, count(*) filter (code is null) over (partition by batch, ts_code) as copies
  from (select *, case when name = '' then 'EMPTY_NAME'
      when list_date is null then 'INVALID_LIST_DATE'
      when list_status <> batch then 'STATUS_MISMATCH'
      when delist_date < list_date then 'DELIST_BEFORE_LIST'
      when symbol <> split_part(ts_code, '.', 1) then 'CODE_SYMBOL_MISMATCH' end as code
    from (select list_status as batch,
        case when k % 13 = 6 then 'T' || ts_code else ts_code end as ts_code,
        case when k % 13 = 6 then 'T' || symbol when k % 31 = 8 then '999999' else symbol end
          as symbol,
        case when k % 17 = 2 then '' else name end as name, area, industry, market,
        case when k % 19 = 4 then '20230931' else strftime(list_date, '%Y%m%d') end as list_text,
        case when k % 23 = 9 then '19900101' else strftime(delist_date, '%Y%m%d') end
          as delist_text,
        case when k % 19 <> 4 then list_date end as list_date,
        case when k % 23 = 9 then date '1990-01-01' else delist_date end as delist_date,
        case when k % 29 = 1 then 'X' else list_status end as list_status
      from securities, (select 1 as copy union all select 2) where copy = 1 or k % 37 = 30)))"""


@query("parse_securities", PARSED_SECURITIES)
def parse_securities(spark, sf):
    return O.parse_securities(T.raw_securities(spark, sf))


@query("parse_daily", f"""
select ts_code, trade_date, cast(volume as bigint) as vol, {_duplicates_last('ts_code, trade_date')}
from (select *, case when ts_code like 'X%' then 'INVALID_SYMBOL'
    when k % 50 = 49 then 'SYMBOL_NOT_REQUESTED' when trade_date is null then 'INVALID_DATE'
    when trade_date not {WINDOW_SQL} then 'DATE_OUTSIDE_WINDOW' when d = 2 then 'INVALID_OPEN'
    when d = 4 then 'INVALID_CLOSE' end as code
  from (select k, d, volume, case when d = 0 then 'X' else '' end || s as ts_code,
      case when d <> 1 then trade_date end as trade_date
    from (select b.*, i.ts_code as s, (b.k * 31 + dayofyear(trade_date)) % 89 as d
      from kbars b join securities i on i.k = b.k),
      (select 1 as copy union all select 2) where copy = 1 or d = 3))""")
def parse_daily(spark, sf):
    rows = O.parse_daily(T.raw_daily(spark, sf), T.requested(spark, sf), *W)
    return rows.select("ts_code", "trade_date", F.col("vol").cast("bigint").alias("vol"),
                       "reason_code")


@query("parse_suspensions", f"""
select ts_code, trade_date, suspend_type, {_duplicates_last('ts_code, trade_date, suspend_type')}
from (select *, case when ts_code not in (select symbol from requested) then 'SYMBOL_NOT_REQUESTED'
    when trade_date not {WINDOW_SQL} then 'DATE_OUTSIDE_WINDOW'
    when suspend_type = 'Q' then 'INVALID_TYPE' end as code
  from (select ts_code, trade_date, case when dayofyear(trade_date) % 61 = 0 then 'Q'
      else suspend_type end as suspend_type
    from suspensions, (select 1 as copy union all select 2)
    where copy = 1 or dayofyear(trade_date) % 59 = 0))""")
def parse_suspensions(spark, sf):
    rows = O.parse_suspensions(T.raw_suspensions(spark, sf), T.requested(spark, sf), *W)
    return rows.drop("suspend_timing")


@query("parse_adj_factors", f"""
select ts_code, trade_date, {_duplicates_last('ts_code, trade_date')}
from (select *, case when ts_code not in (select symbol from requested) then 'SYMBOL_NOT_REQUESTED'
    when trade_date not {WINDOW_SQL} then 'DATE_OUTSIDE_WINDOW'
    when dayofyear(trade_date) % 61 = 0 or dayofyear(trade_date) % 67 = 0
      then 'INVALID_FACTOR' end as code
  from adj_factors)""")
def parse_adj_factors(spark, sf):
    rows = O.parse_adj_factors(T.raw_adj_factors(spark, sf), T.requested(spark, sf), *W)
    return rows.drop("adj_factor")


FINGERPRINT = """
select row_count, sha256(concat_ws('|', {identity}, cast(row_count as varchar),
  cast(s0 as varchar), cast(s1 as varchar), cast(s2 as varchar), cast(s3 as varchar)))
  as fingerprint
from (select count(*) as row_count,
    {sums}
  from (select sha256(concat_ws('|', {cells})) as h from {source}))"""


def fingerprint_sql(identity, cells, source):
    sums = ", ".join(
        f"sum(cast('0x' || substr(h, {start}, 15) as bigint)::hugeint) % 1152921504606846976 as s{i}"
        for i, start in enumerate((1, 16, 31, 46)))
    named = ", ".join(f"'{k}={identity[k]}'" for k in sorted(identity))
    return FINGERPRINT.format(identity=named, sums=sums, cells=cells, source=source)


IDENTITY = {"family": "daily-bars", "normalization": "v1", "as_of": T.LAST_DAY,
            "source": "lineitem", "source_version": "1"}


@query("dataset_fingerprint", fingerprint_sql(
    IDENTITY, "cast(k as varchar), cast(trade_date as varchar), "
    "cast(cast(volume as bigint) as varchar), cast(cast(round(amount * 100) as bigint) as varchar)",
    "kbars"))
def dataset_fingerprint(spark, sf):
    columns = [F.col("k").cast("string"), F.col("trade_date").cast("string"),
               F.col("volume").cast("bigint").cast("string"),
               F.round(F.col("amount") * 100).cast("bigint").cast("string")]
    return O.dataset_fingerprint(T.keyed_bars(spark, sf), columns, IDENTITY)


def _published(spark, sf):
    root = fresh_path(spark, "published")
    return root, O.publish_dataset(
        T.bars(spark, sf), root, as_of=T.LAST_DAY, source="lineitem", source_version="1",
        generated_at="2001-11-05T00:00:00Z", evidence={"factors": T.adj_factors(spark, sf)})


def _damaged(spark, sf):
    """A published dataset whose stored files are changed: of some years a value of the first row,
    or the last row goes; of others the last row comes once more, in a file of its own."""
    root, dataset_id = _published(spark, sf)
    path = f"{root}/datasets/{O.read_manifest(spark, root, dataset_id).first().run}"
    key = F.struct("symbol", "trade_date")
    rows = spark.read.schema(STORED).parquet(path)
    # One row per year: broadcast, so that no task gets a whole year.
    ends = rows.groupBy("year").agg(F.min(key).alias("lo"), F.max(key).alias("hi"))
    rows = rows.join(small(ends, "year"), "year")
    again = stored(rows.where((F.col("year") % 5 == 0) & (key == F.col("hi"))), "again")
    changed = F.col("amount") + F.when((F.col("year") % 3 == 0) & (key == F.col("lo")), 1.0
                                       ).otherwise(0.0)
    rewritten = rows.where("year % 3 = 0 or year % 4 = 1").where(
        (F.col("year") % 4 != 1) | (key != F.col("hi"))).withColumn("amount", changed)
    (stored(rewritten, "rewritten").select(*STORED.names).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("year").parquet(path))
    again.select(*STORED.names).write.mode("append").partitionBy("year").parquet(path)
    return root, dataset_id


ROW = "struct_pack(s := symbol, d := trade_date)"
YEARS = f"""select y, {ROW} as id, trade_date, max({ROW}) over (partition by y) as hi
  from (select *, year(trade_date) as y from bars)"""
AFTER = f"""select y, trade_date from ({YEARS}) where y % 4 <> 1 or id <> hi
union all select y, trade_date from ({YEARS}) where y % 5 = 0 and id = hi"""


@query("verify_dataset", f"""
select 'year=' || y as path, a.n as row_count, concat_ws(',',
  case when a.n <> b.n then 'ROW_COUNT_MISMATCH' end,
  case when a.lo <> b.lo then 'MIN_DATE_MISMATCH' end,
  case when a.hi <> b.hi then 'MAX_DATE_MISMATCH' end,
  case when y % 3 = 0 or y % 4 = 1 or y % 5 = 0 then 'DIGEST_MISMATCH' end) as codes
from (select y, count(*) as n, min(trade_date) as lo, max(trade_date) as hi from ({AFTER})
    group by 1) a
join (select y, count(*) as n, min(trade_date) as lo, max(trade_date) as hi from ({YEARS})
    group by 1) b using (y)""")
def verify_dataset(spark, sf):
    return joined_codes(O.verify_years(spark, *_damaged(spark, sf)))


@query("verify_files", """
select 'year=' || year(trade_date) as folder,
  year(trade_date) % 3 = 0 or year(trade_date) % 4 = 1 as missing,
  year(trade_date) % 3 = 0 or year(trade_date) % 4 = 1 or year(trade_date) % 5 = 0 as undeclared
from bars group by all""")
def verify_files(spark, sf):
    found = O.verify_files(spark, *_damaged(spark, sf))
    return found.groupBy(F.substring_index("path", "/", 1).alias("folder")).agg(
        *[F.bool_or(F.array_contains("codes", f"{c.upper()}_FILE")).alias(c)
          for c in ("missing", "undeclared")])


@query("pk_order", f"""
select copy, folder, row_count, case when copy = 'planted' and y % 3 = 0 and row_count > 1 then 1
    else 0 end as inversions, 0 as overlaps
from (select y, 'year=' || y as folder, count(*) as row_count from ({YEARS}) group by all),
  (values ('published'), ('planted')) c(copy)""")
def pk_order(spark, sf):
    """The files of a published dataset, and of one that has a year's last row first."""
    root, dataset_id = _published(spark, sf)
    path = f"{root}/datasets/{O.read_manifest(spark, root, dataset_id).first().run}"
    rows = spark.read.schema(STORED).parquet(path)
    key = F.struct("symbol", "trade_date")
    ends = rows.groupBy("year").agg(F.max(key).alias("hi"))
    first = (F.col("year") % 3 != 0) | (key != F.col("hi"))
    planted = fresh_path(spark, "planted")
    # A shuffled join by year would take the place of the repartition, and adaptive execution may
    # split its years; after a broadcast each year is one file.
    (rows.join(small(ends, "year"), "year").withColumn("late", first).repartition("year")
     .sortWithinPartitions("year", "late", "symbol", "trade_date").select(*STORED.names)
     .write.partitionBy("year").parquet(planted))
    found = O.pk_order(spark, path).withColumn("copy", F.lit("published")).union(
        O.pk_order(spark, planted).withColumn("copy", F.lit("planted")))
    return found.groupBy("copy", "folder").agg(
        F.sum("row_count").alias("row_count"), F.sum("inversions").alias("inversions"),
        F.count_if("overlaps").alias("overlaps"))


@query("manifest", f"""
select 'year=' || y as folder, count(*) as row_count, min(trade_date) as first_day,
  max(trade_date) as last_day, true as sized, 1 as datasets from ({YEARS}) group by 1""")
def manifest(spark, sf):
    files = O.read_manifest(spark, *_published(spark, sf))
    return files.groupBy(F.substring_index("path", "/", 1).alias("folder")).agg(
        F.sum("row_count").alias("row_count"), F.min("min_trade_date").alias("first_day"),
        F.max("max_trade_date").alias("last_day"), F.bool_and(F.col("file_size") > 0).alias(
            "sized"), F.countDistinct("dataset_id").alias("datasets"))


@query("publish_dataset", """
select symbol, count(*) as row_count, min(trade_date) as first_day, max(trade_date) as last_day
from bars group by 1""")
def publish_dataset(spark, sf):
    return O.load_dataset(spark, *_published(spark, sf)).groupBy("symbol").agg(
        F.count("*").alias("row_count"), F.min("trade_date").alias("first_day"),
        F.max("trade_date").alias("last_day"))


def _index_sql(name, cells, source):
    return (f"select 'dataset' as dataset_id, '{name}' as path, * from ("
            + fingerprint_sql({"table": name}, cells, source) + ")")


@query("auxiliary_index",
       _index_sql("adj_factors", "ts_code, cast(trade_date as varchar)", "adj_factors")
       + " union all "
       + _index_sql("suspensions", "ts_code, cast(trade_date as varchar), suspend_type",
                    "suspensions"))
def auxiliary_index(spark, sf):
    return O.auxiliary_index({
        "adj_factors": (T.adj_factors(spark, sf), ["ts_code", "trade_date"]),
        "suspensions": (T.suspensions(spark, sf), ["ts_code", "trade_date", "suspend_type"]),
    }, "dataset")


# Request evidence -----------------------------------------------------------------------

TELEMETRY = """
select {name} as api_name, count(*) filter (not is_retry and "offset" = 0) as logical_calls,
  count(*) filter (not is_retry) as pages, count(*) as attempts,
  count(*) filter (outcome = 'SUCCESS') as successes,
  count(*) filter (outcome = 'FAILURE') as failures, count(*) filter (is_retry) as retries,
  count(*) filter (transient) as transient_errors,
  count(*) filter (transient and error_reason <> 'timeout') as rate_limit_errors,
  count(*) filter (transient and error_reason = 'timeout') as other_transient_errors,
  true as reconciles
from (select * exclude (is_retry), coalesce(is_retry, false) as is_retry from attempts) {group}"""


@query("api_telemetry", TELEMETRY.format(name="api_name", group="group by api_name") + " union all "
       + TELEMETRY.format(name="'(all)'", group=""))
def api_telemetry(spark, sf):
    return L.api_telemetry(T.request_log(spark, sf))


@query("page_audit", """
select sequence, api_name, request_id, page, unnest(string_split(codes, ',')) as code from (
  select *, concat_ws(',', case when page_hash = lag(page_hash) over w and row_count > 0
      then 'IDENTICAL_PAGE' end,
    case when row_number() over w > 200 then 'PAGE_LIMIT_EXCEEDED' end,
    case when lag(row_count) over w < page_limit then 'SHORT_PAGE_NOT_LAST' end) as codes,
    row_number() over w as page
  from request_log where outcome = 'SUCCESS'
  window w as (partition by api_name, request_id order by sequence)) where codes <> ''""")
def page_audit(spark, sf):
    return L.page_audit(T.request_log(spark, sf))


@query("redact_log", r"""
select sequence, 'ts_code=' || request_id || ';api_Token=***;note='
  || case when sequence % 3 = 0 then '***' else 'plain' end as params,
  regexp_replace(substr(message, 1, 200), '[0-9a-fA-F]{8,}', '***', 'g') as message
from request_log""")
def redact_log(spark, sf):
    log = L.redact_log(T.request_log(spark, sf), "s3cret")
    shown = F.array_join(F.transform("params", lambda p: F.concat(p["name"], F.lit("="),
                                                                 p["value"])), ";")
    return log.select("sequence", shown.alias("params"), "message")


@query("source_identity", f"""
select page_id, host, host = '{T.OFFICIAL_HOST}' as is_official,
  case when host = '{T.OFFICIAL_HOST}' then 'official' else 'non-official' end as source,
  case when host <> '{T.OFFICIAL_HOST}' then 'NON_OFFICIAL_VENDOR_ENDPOINT' end as warning
from (select page_id, lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)) as host from pages)""")
def source_identity(spark, sf):
    urls = T.table(spark, sf, "pages").select("page_id", "url")
    return L.source_identity(urls, T.OFFICIAL_HOST)


@query("reconcile_batches", f"""
select *, raw_rows = accepted_rows + rejected_rows and symbols_in_two_batches = 0 as reconciles
from (select batch, count(*) as raw_rows, count(*) filter (reason_code is null) as accepted_rows,
    count(*) filter (reason_code = 'INVALID_VENDOR_TS_CODE') as rejected_rows,
    count(*) filter (reason_code <> 'INVALID_VENDOR_TS_CODE') as failed_rows,
    0::bigint as symbols_in_two_batches
  from ({PARSED_SECURITIES}) group by 1)""")
def reconcile_batches(spark, sf):
    return L.reconcile_batches(O.parse_securities(T.raw_securities(spark, sf)))


@query("master_expectations", f"""
select w.symbol, concat_ws(',', case when p.ts_code is null then 'MISSING_SYMBOL' end,
  case when p.list_status <> w.list_status then 'LIST_STATUS_CHANGED' end,
  case when p.ts_code is not null and (p.list_date is null or p.list_date > date '1995-05-01')
    then 'INVALID_LIST_DATE' end,
  case when p.ts_code is not null and p.delist_date is distinct from w.delist_date
    then 'DELIST_DATE_CHANGED' end) as codes
from (select ts_code as symbol, case when k % 14 = 5 then 'P' else list_status end as list_status,
    case when k % 15 = 4 then date '2001-01-31' else delist_date end as delist_date
  from securities) w
left join (select s.*, p.reason_code from ({PARSED_SECURITIES}) p join securities s
    on s.ts_code = p.ts_code where p.reason_code is null) p on p.ts_code = w.symbol""")
def master_expectations(spark, sf):
    wanted = T.securities(spark, sf).select(
        F.col("ts_code").alias("symbol"),
        F.when(F.col("k") % 14 == 5, "P").otherwise(F.col("list_status")).alias("list_status"),
        F.when(F.col("k") % 15 == 4, F.lit("2001-01-31").cast("date"))
        .otherwise(F.col("delist_date")).alias("delist_date"))
    judged = O.parse_securities(T.raw_securities(spark, sf))
    return joined_codes(L.master_expectations(judged, wanted, "1995-05-01"))


# Signals --------------------------------------------------------------------------------

@query("resolve_state", """
select run, case when not (execution_data_valid and previous_target_known) then 'HOLD'
  when risk_action = 'FLAT' then 'FLAT'
  when champion = 'WITHDRAWN' or risk_action = 'REDUCE' then 'REDUCE_ONLY'
  when not (decision_data_valid and contracts_valid and hashes_valid) then 'HOLD'
  when champion = 'NEVER_ACTIVATED' then 'FLAT' else 'ACTIVE' end as state from health""")
def resolve_state(spark, sf):
    return S.resolve_states(T.health(spark, sf)).select("run", "state")
