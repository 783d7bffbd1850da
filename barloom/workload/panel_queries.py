"""Queries on bars: features, labels, ranks, calendars and their checks."""

from __future__ import annotations

import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer
from pyspark.sql import functions as F

from ..operators import bars as B
from ..operators import calendars as C
from ..operators import features as X
from ..operators import ranking as R
from . import fixtures as T
from .ctes import half_up
from .registry import query

FEATURES_ROUNDED = ", ".join(f"round({n}, 6) as {n}" for n in X.FEATURE_NAMES)


def rounded(df, *names, to=6):
    return df.select(*[F.round(c, to).alias(c) if c in names else c for c in df.columns])


@query("feature_panel", f"select symbol, trade_date, {FEATURES_ROUNDED} from features")
def feature_panel(spark, sf):
    return rounded(X.feature_panel(T.bars(spark, sf)), *X.FEATURE_NAMES)


@query("returns", """
select symbol, trade_date, round(close / lag(close, 1) over w - 1, 6) as ret_1d,
  round(close / lag(close, 5) over w - 1, 6) as ret_5d,
  round(close / lag(close, 10) over w - 1, 6) as ret_10d,
  round(close / lag(close, 20) over w - 1, 6) as ret_20d
from bars window w as (partition by symbol order by trade_date)""")
def returns(spark, sf):
    names = X.FEATURE_NAMES[:4]
    return rounded(X.with_columns(T.bars(spark, sf), names), *names)


@query("volume_ratio", """
select symbol, trade_date, round(volume / avg(volume) over w5, 6) as vol_ratio_5d,
  round(volume / avg(volume) over w20, 6) as vol_ratio_20d
from bars window
  w5 as (partition by symbol order by trade_date rows between 4 preceding and current row),
  w20 as (partition by symbol order by trade_date rows between 19 preceding and current row)""")
def volume_ratio(spark, sf):
    names = X.FEATURE_NAMES[4:6]
    return rounded(X.with_columns(T.bars(spark, sf), names), *names)


@query("amount_zscore", """
select symbol, trade_date, round(case when stddev_pop(amount) over w > 0
  then (amount - avg(amount) over w) / stddev_pop(amount) over w else 0.0 end, 6) as amount_z_20d
from bars
window w as (partition by symbol order by trade_date rows between 19 preceding and current row)""")
def amount_zscore(spark, sf):
    return rounded(X.with_columns(T.bars(spark, sf), ["amount_z_20d"]), "amount_z_20d")


@query("high_low_position", """
select symbol, trade_date, round(close / max(high) over w, 6) as close_to_high_20d,
  round(case when max(high) over w > min(low) over w
    then (close - min(low) over w) / (max(high) over w - min(low) over w) else 0.5 end, 6)
    as range_position_20d
from bars
window w as (partition by symbol order by trade_date rows between 19 preceding and current row)""")
def high_low_position(spark, sf):
    names = X.FEATURE_NAMES[7:]
    return rounded(X.with_columns(T.bars(spark, sf), names), *names)


@query("feature_replay", f"""
select symbol, trade_date,
  {half_up('close / lag(close) over w - 1', 12)} as close_return_1d,
  {half_up('volume / nullif(avg(volume) over w5, 0)', 12)} as volume_ratio_5d
from bars where trade_date <= date '{T.AS_OF}'
window w as (partition by symbol order by trade_date),
  w5 as (partition by symbol order by trade_date rows between 4 preceding and current row)""")
def feature_replay(spark, sf):
    return X.feature_replay(T.bars(spark, sf), as_of=T.AS_OF, dataset_as_of=T.LAST_DAY)


@query("forward_labels", """
select symbol, trade_date, round(lead(close, 1) over w / close - 1, 6) as label_1,
  lead(trade_date, 1) over w as label_end_1,
  round(lead(close, 3) over w / close - 1, 6) as label_3,
  lead(trade_date, 3) over w as label_end_3,
  round(lead(close, 5) over w / close - 1, 6) as label_5,
  lead(trade_date, 5) over w as label_end_5
from bars window w as (partition by symbol order by trade_date)""")
def forward_labels(spark, sf):
    return rounded(X.forward_labels(T.bars(spark, sf)), "label_1", "label_3", "label_5")


@query("safe_labels", f"""
select l.symbol, l.trade_date, horizon,
  round(case when s.idx + horizon <= c.idx and label_end <= c.trade_date then label end, 6)
    as label,
  case when s.idx + horizon <= c.idx and label_end <= c.trade_date then label_end end as label_end
from labels_h l join sessions s on s.trade_date = l.trade_date,
  (select * from sessions where trade_date = date '{T.AS_OF}') c
where l.trade_date <= c.trade_date""")
def safe_labels(spark, sf):
    bars = T.bars(spark, sf)
    wide = X.safe_labels(bars, C.calendar_index(C.sessions(bars)), T.AS_OF)
    each = F.explode(F.array(*[F.struct(
        F.lit(h).alias("horizon"), F.round(f"label_{h}", 6).alias("label"),
        F.col(f"label_end_{h}").alias("label_end")) for h in X.DEFAULT_HORIZONS]))
    return wide.select("symbol", "trade_date", each.alias("x")).select(
        "symbol", "trade_date", "x.*")


@query("as_of", f"select * from bars where trade_date <= date '{T.AS_OF}'")
def as_of(spark, sf):
    return B.as_of(T.bars(spark, sf), T.AS_OF, T.LAST_DAY)


@query("eligible_bars", """
select bars.* from bars where symbol in (select ts_code from securities where k % 6 <> 0)""")
def eligible_bars(spark, sf):
    return B.eligible_bars(T.bars(spark, sf), T.universe(spark, sf))


@query("panel_equality", """
select 'left' as only_in, 0::bigint as row_count union all select 'right', 0""")
def panel_equality(spark, sf):
    bars = T.bars(spark, sf)
    full = B.as_of(X.feature_panel(bars), T.AS_OF)
    again = X.feature_panel(bars, as_of=T.AS_OF)
    found = X.panel_difference(full, again).groupBy("only_in").agg(
        F.sum("copies").alias("row_count"))
    sides = spark.createDataFrame([("left",), ("right",)], "only_in string")
    return sides.join(found, "only_in", "left").select(
        "only_in", F.coalesce("row_count", F.lit(0)).alias("row_count"))


@query("daily_rank", """
select symbol, trade_date, round(score, 6) as score, cast(rnk as int) as "rank",
  round(1 - (rnk - 1) / n, 4) as rank_strength from ranked""")
def daily_rank(spark, sf):
    panel = X.feature_panel(T.bars(spark, sf)).select(
        "symbol", "trade_date", F.col("ret_20d").alias("score"))
    return rounded(R.daily_rank(panel), "score")


@query("top_k_targets", """
select symbol, trade_date, round(score, 6) as score, cast(rnk as int) as "rank",
  0.2::double as target_weight from ranked where rnk <= 5""")
def top_k_targets(spark, sf):
    panel = X.feature_panel(T.bars(spark, sf)).select(
        "symbol", "trade_date", F.col("ret_20d").alias("score"))
    return rounded(R.top_k_targets(panel, 5, 0.25, 0.2), "score")


@query("score_with", """
select symbol, trade_date, cast(r as int) as "rank", 0.1::double as target_weight from (
  select symbol, trade_date, row_number() over (partition by trade_date
    order by 0.75 * ret_5d + 0.25 * ret_20d desc, symbol) as r from features) where r <= 3""")
def score_with(spark, sf):
    scored = R.score_with(X.feature_panel(T.bars(spark, sf)),
                          F.lit(0.75) * F.col("ret_5d") + F.lit(0.25) * F.col("ret_20d"))
    return R.top_k_targets(scored, 3, 0.1, 0.2).drop("score")


@query("score_with_forms", """
select form, symbol, trade_date, round(0.75 * ret_5d + 0.25 * ret_20d, 6) as score
from features, (values ('function'), ('model'), ('pandas')) f(form)""")
def score_with_forms(spark, sf):
    """The same score by a vectorised user function, a fitted pipeline and a function of tables."""
    panel = X.feature_panel(T.bars(spark, sf))

    @F.pandas_udf("double")
    def weighed(short: pd.Series, long: pd.Series) -> pd.Series:
        return 0.75 * short + 0.25 * long

    sql = "select *, 0.75D * ret_5d + 0.25D * ret_20d as prediction from __THIS__"
    forms = {"pandas": weighed("ret_5d", "ret_20d"),
             "model": PipelineModel([SQLTransformer(statement=sql)]),
             "function": lambda df: df.withColumn("score", F.expr("0.75D * ret_5d + 0.25D * ret_20d"))}
    parts = [rounded(R.score_with(panel, how).select(
        F.lit(name).alias("form"), "symbol", "trade_date", "score"), "score")
        for name, how in sorted(forms.items())]
    return parts[0].union(parts[1]).union(parts[2])


@query("momentum_argmax", """
select trade_date, m.symbol as symbol, round(m.ret, 6) as ret, 1.0::double as target_weight from (
  select trade_date, max(struct_pack(ret := ret, symbol := symbol)) as m from (
    select symbol, trade_date, close / lag(close) over (partition by symbol order by trade_date) - 1
      as ret from bars where symbol in (select ts_code from securities where k % 6 <> 0))
  where ret is not null group by 1)""")
def momentum_argmax(spark, sf):
    return rounded(R.momentum_argmax(T.bars(spark, sf), T.universe(spark, sf)), "ret")


@query("latest_two_bars", """
select symbol, max(case when n = 1 then trade_date end) as last_date,
  max(case when n = 1 then close end) as last_close,
  max(case when n = 2 then trade_date end) as second_date,
  max(case when n = 2 then close end) as second_close
from (select *, row_number() over (partition by symbol order by trade_date desc) as n from bars)
where n <= 2 group by symbol""")
def latest_two_bars(spark, sf):
    return B.latest_two(T.bars(spark, sf))


@query("duplicate_keys", """
select ts_code, trade_date, count(*) as copies from raw_bars group by 1, 2 having count(*) > 1""")
def duplicate_keys(spark, sf):
    return B.duplicate_keys(T.raw_bars(spark, sf), ["ts_code", "trade_date"])


@query("dataset_stats", """
select symbol, count(*) as row_count, min(trade_date) as min_date, max(trade_date) as max_date
from bars group by 1""")
def dataset_stats(spark, sf):
    return B.dataset_stats(T.bars(spark, sf))


@query("universe_members", """
select distinct symbol, (select min(trade_date) from bars) as valid_from,
  cast(null as date) as valid_to, true as eligible, 'DATA_COMPLETE,MEMBER' as reason_codes
from bars""")
def universe_members(spark, sf):
    members = B.universe_members(T.bars(spark, sf), ["MEMBER", "DATA_COMPLETE"])
    return members.withColumn("reason_codes", F.array_join("reason_codes", ","))


@query("calendar_index", "select trade_date, idx from sessions")
def calendar_index(spark, sf):
    return C.calendar_index(C.sessions(T.bars(spark, sf)))


@query("open_sessions", "select distinct trade_date from open_days")
def open_sessions(spark, sf):
    return C.open_sessions(T.trade_calendar(spark, sf))


@query("calendar_gaps", """
select cal_date, 'MISSING' as kind from (
  select cast(unnest(generate_series(date '1994-12-25', date '2001-10-31', interval 1 day))
    as date) as cal_date) where cal_date not in (select cal_date from trade_calendar)
union all select cal_date, 'EXTRA' from trade_calendar
  where cal_date not between date '1994-12-25' and date '2001-10-31'""")
def calendar_gaps(spark, sf):
    return C.calendar_gaps(T.trade_calendar(spark, sf), "1994-12-25", "2001-10-31")


@query("as_of_is_last_open", f"""
select max(cal_date) as last_open, max(cal_date) = date '{T.EXPECTED_AS_OF}' as matches
from trade_calendar where is_open = 1""")
def as_of_is_last_open(spark, sf):
    return C.as_of_is_last_open(T.trade_calendar(spark, sf), T.EXPECTED_AS_OF)


ORACLE_FRESHNESS = f"""
select symbol as name, latest as latest_date, lag_sessions, codes = '' as passed,
  codes as reason_codes
from (select *, concat_ws(',',
    case when date '{T.EXPECTED_AS_OF}' not in (select trade_date from open_days)
      then 'EXPECTED_AS_OF_NOT_TRADING_DAY' end,
    case when latest not in (select trade_date from open_days)
      then 'LATEST_COMPLETE_NOT_TRADING_DAY' end,
    case when latest > date '{T.EXPECTED_AS_OF}' then 'LATEST_COMPLETE_IN_FUTURE' end,
    case when lag_sessions > 1 then 'DATA_STALE' end) as codes
  from (select symbol, latest, (select count(*) from open_days d where d.trade_date > latest
      and d.trade_date <= date '{T.EXPECTED_AS_OF}') as lag_sessions
    from (select symbol, max(trade_date) as latest from bars group by 1)))"""


@query("freshness", ORACLE_FRESHNESS)
def freshness(spark, sf):
    latest = T.bars(spark, sf).groupBy(F.col("symbol").alias("name")).agg(
        F.max("trade_date").alias("latest_date"))
    rated = C.freshness(latest, T.open_days(spark, sf), T.EXPECTED_AS_OF, 1)
    return rated.withColumn("reason_codes", F.array_join("reason_codes", ","))


@query("stage_health", f"""
select 'run-1' as run_id, 'data' as stage, case when codes = '' then 'pass' else 'fail' end as status,
  '2001-11-05T00:00:00Z' as started_at, '2001-11-05T00:05:00Z' as finished_at,
  '{"ab" * 32}' as dataset_manifest_sha256, codes as reason_codes
from (select coalesce(string_agg(distinct c, ',' order by c), '') as codes
  from (select unnest(string_split(reason_codes, ',')) as c from ({ORACLE_FRESHNESS}))
  where c <> '')""")
def stage_health(spark, sf):
    latest = T.bars(spark, sf).groupBy(F.col("symbol").alias("name")).agg(
        F.max("trade_date").alias("latest_date"))
    rated = C.freshness(latest, T.open_days(spark, sf), T.EXPECTED_AS_OF, 1)
    row = C.stage_health(rated, "run-1", "2001-11-05T00:00:00Z", "2001-11-05T00:05:00Z", "ab" * 32)
    return row.withColumn("reason_codes", F.array_join("reason_codes", ","))


@query("session_label", """
select event_id, cast(local as date) as calendar_date, label as session_label,
  label = 'OPEN' as is_open
from (select event_id, local, case when dayofweek(local) = 0 then 'HOLIDAY'
    when m >= 555 and m < 570 then 'PRE_OPEN' when m >= 570 and m < 690 then 'OPEN'
    when m >= 690 and m < 780 then 'MIDDAY_BREAK' when m >= 780 and m < 900 then 'OPEN'
    else 'CLOSED' end as label
  from (select *, hour(local) * 60 + minute(local) as m
    from (select event_id, ts + interval 8 hour as local from events)))""")
def session_label(spark, sf):
    events = T.table(spark, sf, "events").select("event_id", "ts")
    span = events.agg(F.min(F.to_date("ts")).alias("a"), F.max(F.to_date("ts")).alias("b"))
    days = (span.select(F.explode(F.sequence("a", F.date_add("b", 1))).alias("trade_date"))
            .where("dayofweek(trade_date) <> 1"))
    return C.label_sessions(events, days).select(
        "event_id", "calendar_date", "session_label", "is_open")


@query("classify_board", """
select symbol, split_part(symbol, '.', 2) as market, case when symbol like '%.BJ' then 'unsupported'
  when symbol like '688%' then 'star' when substr(symbol, 1, 3) in ('300', '301', '302') then 'gem'
  else 'main' end as board, count(*) as bars from bars group by all""")
def classify_board(spark, sf):
    from ..functions import board, market
    return (T.bars(spark, sf).groupBy("symbol").agg(F.count("*").alias("bars"))
            .select("symbol", market("symbol").alias("market"), board("symbol").alias("board"),
                    "bars"))
