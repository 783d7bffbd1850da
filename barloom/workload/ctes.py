"""The derived market tables as DuckDB SQL, for the result checks."""

from __future__ import annotations

import re

HEAD = """(case {k} % 5 when 0 then '600' when 1 then '000' when 2 then '300' when 3 then '688'
 else '430' end)"""
SYMBOL = f"""(case when {{k}} // 5 < 88000
 then lpad(cast(cast({HEAD} as bigint) * 1000 + {{k}} // 5 as varchar), 6, '0')
 else {HEAD} || cast({{k}} // 5 as varchar) end || case {{k}} % 5 when 0 then '.SH'
 when 1 then '.SZ' when 2 then '.SZ' when 3 then '.SH' else '.BJ' end)"""
SEQ = "(l_orderkey * 10000000 + l_partkey * 10 + l_linenumber)"


def symbol(k: str) -> str:
    return SYMBOL.format(k=k)


def exact(x: str) -> str:
    """A double as the decimal of its shortest text form, as Spark casts it."""
    return f"cast(cast({x} as varchar) as decimal(30,8))"


def half_up(x: str, places: int) -> str:
    """A double rounded half up on its shortest text form, as Spark rounds it."""
    return f"cast(round(cast(cast({x} as varchar) as decimal(38,20)), {places}) as double)"


CTES = {
    "kbars": f"""
select l_suppkey as k, cast(l_shipdate as date) as trade_date,
  arg_min(l_extendedprice / l_quantity, {SEQ}) as open, max(l_extendedprice / l_quantity) as high,
  min(l_extendedprice / l_quantity) as low, arg_max(l_extendedprice / l_quantity, {SEQ}) as close,
  cast(sum(cast(l_quantity as bigint)) as double) as volume,
  cast(sum(cast(l_extendedprice as decimal(18,2))) as double) as amount
from lineitem group by all""",
    "bars": f"""
select {symbol('k')} as symbol, trade_date, open, high, low, close, volume, amount from kbars""",
    "instruments": "select distinct s_suppkey as k from supplier",
    "trade_calendar": """
select 'SSE' as exchange, d as cal_date, case when dayofweek(d) = 0 then 0 else 1 end as is_open,
  d - case when dayofweek(d) = 1 then 2 else 1 end as pretrade_date
from (select cast(unnest(generate_series(a, b, interval 1 day)) as date) as d from
  (select min(l_shipdate) as a, max(l_shipdate) as b from lineitem))""",
    "open_days": "select cal_date as trade_date from trade_calendar where is_open = 1",
    "securities": f"""
select k, {symbol('k')} as ts_code, substr({symbol('k')}, 1, 6) as symbol,
  'Company ' || k as name, case when k % 9 <> 0 then 'Area ' || (k % 9) end as area,
  'Industry' as industry, case when k % 6 <> 0 then 'Market' end as market,
  date '1995-01-02' + cast(k % 200 as int) as list_date,
  case when k % 7 = 3 then date '2000-06-30' end as delist_date,
  case when k % 7 = 3 then 'D' when k % 11 = 5 then 'P' else 'L' end as list_status
from instruments""",
    "lifecycles": """
select ts_code as symbol, list_date as listed_on, delist_date as delisted_on from securities""",
    "memberships": f"""
select {symbol('k')} as symbol, valid_from, valid_to from (
  select k, date '1995-01-02' as valid_from, cast(null as date) as valid_to
    from instruments where k % 4 = 0
  union all select k, date '1996-01-01', date '1999-12-31' from instruments where k % 4 = 1
  union all select k, date '1995-01-02', date '1997-06-30' from instruments where k % 4 = 2
  union all select k, date '1998-01-01', null from instruments where k % 4 = 2
  union all select k, date '1995-01-02', date '1998-06-30' from instruments where k % 4 = 3
  union all select k, case when k % 8 = 7 then date '1998-06-01' else date '1998-07-01' end, null
    from instruments where k % 4 = 3)""",
    "suspensions": f"""
select {symbol('k')} as ts_code, trade_date, cast(null as varchar) as suspend_timing,
  case when (k + dayofyear(trade_date)) % 5 < 3 then 'S' else 'R' end as suspend_type
from (select k, cast(unnest(generate_series(date '1995-01-02', date '2001-11-04',
        interval 1 day)) as date) as trade_date from instruments) d
where (k + dayofyear(trade_date)) % 5 < 4
  and not exists (select 1 from kbars b where b.k = d.k and b.trade_date = d.trade_date)""",
    "raw_bars": f"""
select {symbol('k')} as ts_code, trade_date, case when d = 0 then 0.0 else open end as open, high,
  case when d = 1 then high + 1 else low end as low,
  case when d = 5 then 'nan'::double else close end as close,
  case when d = 4 then 0.0 when d = 6 then -1.0 else volume / 100 end as vol,
  case when d = 2 then amount / 500 else amount / 1000 end as amount
from (select *, (k * 31 + dayofyear(trade_date)) % 97 as d from kbars) b,
  (select 1 as copy union all select 2) c
where copy = 1 or d = 3""",
    "requested": f"select {symbol('k')} as symbol from instruments where k % 50 <> 49",
    "adj_factors": f"""
select {symbol('k')} as ts_code, trade_date, cast(1 + (k % 10) / 10 as double) as adj_factor
  from kbars where (k + dayofyear(trade_date)) % 23 = 0 or (k + dayofyear(trade_date)) % 19 <> 0
union all
select {symbol('k')}, trade_date + 3650, cast(1 + (k % 10) / 10 as double)
  from kbars where (k + dayofyear(trade_date)) % 23 = 0""",
    "cost_segments": """
select m as market, s.* from (values ('SH'), ('SZ')) t(m), (values
  ('old', date '1990-01-01', date '1998-06-30', 0.0::decimal(10,6), 0.001::decimal(10,6),
   0.00001::decimal(10,6), 0.00001::decimal(10,6)),
  ('new', date '1998-07-01', null, 0.0, 0.0005, 0.00001, 0.00001))
  s(segment_id, effective_from, effective_to, stamp_buy, stamp_sell, transfer_buy,
    transfer_sell)""",
    "market_rules": """
select * from (values ('main', 100, 0.10::double), ('gem', 100, 0.20::double),
  ('star', 100, 0.20::double)) t(board, lot_size, price_limit_pct)""",
    "trades": f"""
select concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey,
    strftime(l_shipdate, '%Y%m%d')) as trade_id,
  o_custkey as account, {symbol('l_suppkey')} as symbol,
  cast(l_shipdate as date) as trade_date,
  case when l_returnflag = 'R' then 'sell' else 'buy' end as side,
  cast(l_quantity as bigint) * 100 as shares, l_extendedprice / l_quantity as price,
  cast(cast(l_extendedprice as decimal(18,2)) * 100 as decimal(20,2)) as gross
from lineitem join orders on l_orderkey = o_orderkey""",
    "accounts": """
select c_custkey as account, cast(cast(c_acctbal as decimal(18,2)) * 1000 as decimal(20,2)) as cash
from customer""",
    "order_requests": """
select trade_id as order_id, account, symbol, trade_date, side, shares from trades""",
    "holdings": """
select account, symbol, shares, least(late, shares) as locked_shares from (
  select account, symbol,
    cast(sum(case when side = 'buy' then shares else -shares end) as bigint) as shares,
    cast(sum(case when side = 'buy' and trade_date >= date '2001-09-01' then shares else 0 end)
      as bigint) as late
  from trades group by 1, 2) where shares > 0""",
    "signals": """
select chain, signal_id, as_of, state, sequence, run_id, generated_at, document_hash,
  case when signal_id % 59 = 0 then sha256(cast(signal_id as varchar))
    else lag(document_hash) over (partition by chain order by position)
    end as previous_signal_hash
from (select *, sha256(concat_ws('|', cast(signal_id as varchar), cast(chain as varchar),
        cast(sequence as varchar), state, cast(as_of as varchar), cast(generated_at as varchar)))
        as document_hash
  from (select chain, position, signal_id, as_of, state,
      position + case when signal_id % 53 = 0 then 1 else 0 end as sequence,
      'run-' || case when signal_id % 67 = 0 then 0 else signal_id end as run_id,
      (as_of - date '1990-01-01') * 100 + position
        - case when signal_id % 61 = 0 then 100000 else 0 end as generated_at
    from (select o_orderkey as signal_id, o_custkey as chain, cast(o_orderdate as date) as as_of,
        case o_orderstatus when 'F' then 'ACTIVE' when 'O' then 'HOLD' else 'REDUCE_ONLY' end
          as state,
        row_number() over (partition by o_custkey order by cast(o_orderdate as date), o_orderkey)
          as position
      from orders)))""",
    "signal_heads": """
select chain, signal_id, as_of as head_as_of,
  sequence + case when signal_id % 71 = 0 then 1 else 0 end as head_sequence,
  document_hash as head_signal_hash,
  generated_at + case when signal_id % 73 = 0 then 1 else 0 end as head_generated_at
  from signals""",
    "targets": f"""
select l_orderkey as signal_id, {symbol('l_suppkey')} as symbol,
  l_quantity / 200 as weight from lineitem""",
    "health": """
select o_orderkey as run, o_orderkey % 13 <> 0 as execution_data_valid,
  o_orderkey % 17 <> 0 as previous_target_known, o_orderkey % 7 <> 0 as decision_data_valid,
  o_orderkey % 11 <> 0 as contracts_valid, o_orderkey % 19 <> 0 as hashes_valid,
  case o_orderkey % 5 when 0 then 'NEVER_ACTIVATED' when 1 then 'WITHDRAWN' else 'HEALTHY' end
    as champion,
  case when o_orderkey % 23 = 0 then 'FLAT' when o_orderkey % 29 = 0 then 'REDUCE' else 'NONE' end
    as risk_action
from orders""",
    "request_log": """
select event_id as sequence, event_type as api_name, user_id as request_id,
  event_id % 3 * 5000 as "offset", 5000 as page_limit,
  case when event_id % 4 = 0 then 'FAILURE' else 'SUCCESS' end as outcome,
  case when event_id % 4 = 0 then case (event_id // 4) % 5 when 0 then 'http_429'
    when 1 then 'rate_limit' when 2 then 'vendor_code_-2000' when 3 then 'timeout'
    else 'bad_request' end end as error_reason,
  event_id % 4 = 0 and (event_id // 4) % 5 < 4 as transient,
  case when event_id % 4 = 0 then 0 when event_id % 3 = 2 then event_id % 5000 else 5000 end
    as row_count,
  case when event_id % 4 <> 0 then sha256((event_id % 3) || '|' || user_id) end as page_hash,
  'failed at ' || hex(event_id) || ' key deadbeef0123 ' || props as message
from events""",
}

# Shared steps of more than one check.
CTES["sessions"] = """
select trade_date, row_number() over (order by trade_date) - 1 as idx
from (select distinct trade_date from kbars)"""
CTES["features"] = """
select * from (
  select symbol, trade_date,
    close / lag(close, 1) over w - 1 as ret_1d, close / lag(close, 5) over w - 1 as ret_5d,
    close / lag(close, 10) over w - 1 as ret_10d, close / lag(close, 20) over w - 1 as ret_20d,
    case when avg(volume) over w5 > 0 then volume / avg(volume) over w5 else 1.0 end
      as vol_ratio_5d,
    case when avg(volume) over w20 > 0 then volume / avg(volume) over w20 else 1.0 end
      as vol_ratio_20d,
    case when stddev_pop(amount) over w20 > 0
      then (amount - avg(amount) over w20) / stddev_pop(amount) over w20 else 0.0 end
      as amount_z_20d,
    close / max(high) over w20 as close_to_high_20d,
    case when max(high) over w20 > min(low) over w20
      then (close - min(low) over w20) / (max(high) over w20 - min(low) over w20) else 0.5 end
      as range_position_20d,
    row_number() over w as observations
  from bars
  window w as (partition by symbol order by trade_date),
    w5 as (partition by symbol order by trade_date rows between 4 preceding and current row),
    w20 as (partition by symbol order by trade_date rows between 19 preceding and current row))
where observations >= 21"""
CTES["labels_h"] = """
select symbol, trade_date, h as horizon, label, label_end from (
  select symbol, trade_date, 1 as h, lead(close, 1) over w / close - 1 as label,
    lead(trade_date, 1) over w as label_end from bars
    window w as (partition by symbol order by trade_date)
  union all select symbol, trade_date, 3, lead(close, 3) over w / close - 1,
    lead(trade_date, 3) over w from bars window w as (partition by symbol order by trade_date)
  union all select symbol, trade_date, 5, lead(close, 5) over w / close - 1,
    lead(trade_date, 5) over w from bars window w as (partition by symbol order by trade_date))"""
CTES["split"] = """
select max(case when idx = cast(floor(n * 0.60::double) as bigint) - 1 then trade_date end)
    as train_end,
  max(case when idx = cast(floor(n * 0.60::double) as bigint) then trade_date end)
    as validation_start,
  max(case when idx = cast(floor(n * 0.78::double) as bigint) - 1 then trade_date end)
    as validation_end,
  max(case when idx = cast(floor(n * 0.78::double) as bigint) then trade_date end) as test_start,
  max(n) as n
from (select *, count(*) over () as n from sessions)"""
CTES["ranked"] = """
select symbol, trade_date, ret_20d as score,
  row_number() over (partition by trade_date order by ret_20d desc, symbol) as rnk,
  count(*) over (partition by trade_date) as n
from features"""
CTES["expected"] = """
select distinct m.symbol, d.trade_date, l.delisted_on
from memberships m join lifecycles l on m.symbol = l.symbol
join open_days d on d.trade_date between greatest(m.valid_from, l.listed_on)
  and least(coalesce(m.valid_to, date '9999-12-31'), coalesce(l.delisted_on, date '9999-12-31'))
where d.trade_date between date '1995-02-01' and date '2001-09-30'"""
CTES["classified"] = """
select e.symbol, e.trade_date, e.delisted_on, case when b.symbol is not null then 'BAR'
  when s.ts_code is not null then 'SUSPENDED'
  when e.delisted_on = e.trade_date then 'EXPECTED_DELISTED' else 'MISSING' end as class
from expected e left join bars b on b.symbol = e.symbol and b.trade_date = e.trade_date
left join (select distinct ts_code, trade_date from suspensions where suspend_type = 'S') s
  on s.ts_code = e.symbol and s.trade_date = e.trade_date"""
CTES["costed"] = """
select t.*, n.matches, case when matches <> 1 then null when gross = 0 then 0.00::decimal(20,2)
    else round(greatest(gross * 0.0003::decimal(10,6), 5.0::decimal(20,2)), 2) end as commission,
  case when matches <> 1 then null else round(gross * case side when 'buy' then stamp_buy
    else stamp_sell end, 2) end as stamp_duty,
  case when matches <> 1 then null else round(gross * case side when 'buy' then transfer_buy
    else transfer_sell end, 2) end as transfer_fee
from trades t
left join (select trade_id, count(segment_id) as matches, min(segment_id) as segment_id
  from trades left join cost_segments s on s.market = split_part(symbol, '.', 2)
    and trade_date >= effective_from
    and trade_date <= coalesce(effective_to, date '9999-12-31') group by 1) n
  on n.trade_id = t.trade_id
left join cost_segments s on s.market = split_part(t.symbol, '.', 2)
  and s.segment_id = n.segment_id"""
CTES["attempts"] = """
select *, (transient_before and before = 'FAILURE') as is_retry from (
  select *, lag(outcome) over w as before, coalesce(lag(transient) over w, false)
    as transient_before
  from request_log
  window w as (partition by api_name, request_id, "offset" order by sequence))"""

CTES["moved_orders"] = """
select * exclude (trade_date), trade_date + case when shares % 900 = 0 then 1 else 0 end
  as trade_date from order_requests"""
CTES["moves_held"] = """
select *, s - least(min(s) over (partition by account, symbol order by trade_date, id, kind), 0)
    as held
from (select *, sum(d) over (partition by account, symbol order by trade_date, id, kind) as s,
    sum(greatest(d, 0)) over (partition by account, symbol, trade_date order by id, kind) as bought
  from (select account, symbol, trade_date, order_id as id, 0 as kind, 0 as d from moved_orders
    union all select account, symbol, trade_date, trade_id, 1,
      case side when 'buy' then shares else -shares end from trades))"""

CTES["rebalance_rows"] = f"""
select coalesce(h.account, t.account) as account, coalesce(h.symbol, t.symbol) as symbol, h.shares,
  t.rank from holdings h full join (
    select o_custkey as account, {symbol('l_suppkey')} as symbol,
      min(l_linenumber) as rank
    from lineitem join (select o_custkey, max(struct_pack(d := o_orderdate, k := o_orderkey)).k
      as o_orderkey from orders group by 1) on l_orderkey = o_orderkey group by 1, 2) t
  on t.account = h.account and t.symbol = h.symbol"""
CTES["rebalance_sized"] = """
select *, case reason when 'KEEP' then shares when 'REBALANCE_TRIM' then shares - move
    when 'REBALANCE_TOPUP' then shares + move end as after
from (select *, case reason when 'MODEL_EXIT' then shares
    when 'REBALANCE_TRIM' then least(moved, shares)
    when 'REBALANCE_TOPUP' then cast(floor(moved / 100) * 100 as bigint) end as move
  from (select *, case when shares is not null and rank is null then 'MODEL_EXIT'
      when shares is not null and price is null then 'KEEP'
      when shares is not null and moved >= lot and drift < -0.02::double then 'REBALANCE_TRIM'
      when shares is not null and moved >= lot and drift > 0.02::double then 'REBALANCE_TOPUP'
      when shares is not null then 'KEEP'
      when price is not null and lot is not null then 'MODEL_TOP_SCORE' else 'SKIP' end as reason
    from (select *, cast(floor(abs(drift) * total / price) as bigint) as moved
      from (select r.*, p.price, a.total, m.lot_size as lot,
          0.2::double - r.shares * p.price / a.total as drift
        from rebalance_rows r left join (select symbol, arg_max(close, trade_date) as price
          from bars where trade_date <= date '2000-12-29' group by 1) p on p.symbol = r.symbol
        join (select a.account, round(abs(cash)::double * 10 + coalesce(v, 0.0), 2) as total
          from accounts a left join (select account, sum(shares * price) as v from holdings h
            join (select symbol, arg_max(close, trade_date) as price from bars
              where trade_date <= date '2000-12-29' group by 1) p on p.symbol = h.symbol
            group by 1) h on h.account = a.account) a on a.account = r.account
        left join market_rules m on m.board = case when r.symbol like '%.BJ' then 'unsupported'
          when r.symbol like '688%' then 'star' when r.symbol like '300%' then 'gem'
          else 'main' end))))"""


def with_ctes(body: str) -> str:
    """``body`` behind a WITH clause holding exactly the tables it names."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in CTES:
            if name not in needed and re.search(rf"\b{name}\b", text):
                visit_one(name)

    def visit_one(name: str) -> None:
        for other in CTES:
            if other != name and other not in needed and re.search(rf"\b{other}\b", CTES[name]):
                visit_one(other)
        if name not in needed:
            needed.append(name)

    visit(body)
    if not needed:
        return body.strip()
    parts = ",\n".join(f"{n} as materialized ({CTES[n].strip()})" for n in needed)
    # A body may go on with tables of its own, after a comma.
    return f"with {parts}\n{body.strip()}"
