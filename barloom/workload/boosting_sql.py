"""Boosted trees in SQL: what the fitted models and their scores are checked against."""

from __future__ import annotations

from ..operators.features import FEATURE_NAMES
from ..operators.model import BINS, BIN_SAMPLE, MODEL_SETTINGS

SAFE = "case when s.idx + {h} <= c.idx and l.end_{h} <= c.trade_date then {v} end"
#: Labels of all horizons in one pass over the bars.
LEADS = "(select symbol, trade_date, " + ", ".join(
    f"lead(close, {h}) over w / close - 1 as label_{h}, lead(trade_date, {h}) over w as end_{h}"
    for h in (1, 3, 5)) + " from bars window w as (partition by symbol order by trade_date))"


def boosting_sql(trees: int, horizons=(1, 3, 5)) -> str:
    """CTEs up to ``boosted``: the last state of every row (``f`` is its score, ``id`` that of
    ``binned``) and every split made (``id`` below 0: ``tree``, ``node``, ``feature``, ``bin``),
    by one recursion whose turns are the levels of the trees. ``edges`` has the bin edges."""
    names, n = FEATURE_NAMES, len(FEATURE_NAMES)
    depth, least = MODEL_SETTINGS["maxDepth"], MODEL_SETTINGS["minInstancesPerNode"]
    step = MODEL_SETTINGS["stepSize"]
    features = ", ".join(f"round(f.{x}, 6) as x{i}" for i, x in enumerate(names))
    labels = ", ".join(f"round({SAFE.format(h=h, v=f'l.label_{h}')}, 6) as y{h}" for h in horizons)
    picked = " union all ".join(f"select {i} as i, x{i} as x from sampled" for i in range(n))
    bins = ", ".join(
        f"len(list_filter((select e from lists where i = {i}), lambda e: e < x{i}))::int"
        for i in range(n))
    rows = " union all ".join(
        f"select {h} as h, id, y{h} as y from binned" for h in horizons)
    return f"""
, panel as materialized (select f.symbol, f.trade_date, f.trade_date <= c.trade_date as inside,
  {features}, {labels}
from features f join {LEADS} l on l.symbol = f.symbol and l.trade_date = f.trade_date
left join sessions s on s.trade_date = f.trade_date,
  (select * from sessions where trade_date = (select train_end from split)) c),
sampled as materialized (select * from panel where inside
  and ('0x' || substr(md5(symbol || '|' || trade_date::varchar), 1, 8))::bigint
    * (select count(*) from panel where inside) < {BIN_SAMPLE} * 4294967296::bigint),
edges as materialized (select i, x as e, row_number() over (partition by i order by x) - 1 as bin
  from (select distinct i, x from (
    select i, x, row_number() over (partition by i order by x) as k,
      count(*) over (partition by i) as m from ({picked})) p,
    (select unnest(range(1, {BINS})) as q) where k = (q * m + {BINS} - 1) // {BINS})),
lists as (select i, list(e order by e) as e from edges group by i),
binned as materialized (select *, [{bins}] as b, row_number() over () as id from panel),
cells as materialized (select id, unnest(b) as bin, unnest(range({n})) as feature from binned
  where inside),
boosted as (select * from (
  with recursive boosted(h, id, turn, tree, node, feature, bin, f, y) using key (h, id) as (
    select h, id, 0 as turn, 0 as tree, 1 as node, 0 as feature, 0 as bin, 0.0::double as f, y
    from ({rows})
    union
    (with now as (select *, case when tree = 0 then y else 2 * (y - f) end as r
        from boosted where id > 0 and tree < {trees}),
    held as (select h, node, count(*) as n, sum(r) as s from now where y is not null group by all),
    hist as (select h, node, c.feature, c.bin, count(*) as n, sum(r) as s
      from now join cells c using (id) where y is not null group by all),
    running as (select h, node, feature, bin, sum(n) over w as nl, sum(s) over w as sl from hist
      window w as (partition by h, node, feature order by bin)),
    best as (select h, node, feature, bin, tree, turn from running r
      join held t using (h, node), (select any_value(tree) as tree, any_value(turn) as turn from now)
      where nl >= {least} and t.n - nl >= {least}
        and sl * sl / nl + (t.s - sl) * (t.s - sl) / (t.n - nl) - t.s * t.s / t.n > 0
      qualify row_number() over (partition by h, node order by
        sl * sl / nl + (t.s - sl) * (t.s - sl) / (t.n - nl) desc, feature, bin) = 1),
    moved as (select now.* exclude (node), case when best.node is null then now.node
        when b[best.feature + 1] <= best.bin then 2 * now.node else 2 * now.node + 1 end as node
      from now join binned using (id) left join best on best.h = now.h and best.node = now.node),
    leaf as (select h, node, avg(r) as p from moved where y is not null group by all)
    select m.h, id, turn + 1, case when turn % {depth} = {depth - 1} then tree + 1
        else tree end, case when turn % {depth} = {depth - 1} then 1 else m.node end, 0, 0,
      case when turn % {depth} = {depth - 1}
        then f + case when tree = 0 then 1.0 else {step}::double end * p else f end, y
    from moved m left join leaf l on l.h = m.h and l.node = m.node
    union all
    select h, -(tree * 100 + node), turn, tree, node, feature, bin, 0.0, null from best))
  select * from boosted))
"""
