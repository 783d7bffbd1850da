"""Queries on walk-forward models: splits, training data, fits, scores and checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import calendars as C
from ..operators import features as X
from ..operators import model as G
from ..operators import ranking as R
from ..session import stored
from . import fixtures as T
from .boosting_sql import LEADS, SAFE, boosting_sql
from .registry import query


@query("walk_forward_split", """
select train_end, validation_start, validation_end, test_start from split""")
def walk_forward_split(spark, sf):
    return G.walk_forward_split(C.calendar_index(C.sessions(T.bars(spark, sf))))


def _cut_sql(columns: str, last: str) -> str:
    """Columns of the panel with labels up to the day of the split named ``last``."""
    return f"""select {columns}
from features f join {LEADS} l on l.symbol = f.symbol and l.trade_date = f.trade_date
join sessions s on s.trade_date = f.trade_date,
  (select * from sessions where trade_date = (select {last} from split)) c
where f.trade_date <= c.trade_date"""


def _matrix_sql() -> str:
    features = ", ".join(f"round(f.{n}, 6) as {n}" for n in X.FEATURE_NAMES)
    labels = ", ".join(
        f"round({SAFE.format(h=h, v=f'l.label_{h}')}, 6) as label_{h}, "
        f"{SAFE.format(h=h, v=f'l.end_{h}')} as label_end_{h}" for h in (1, 3, 5))
    return _cut_sql(f"f.symbol, f.trade_date, {features}, {labels}", "train_end")


def _kept_bars(spark, sf):
    """Bars stored once, for queries that read them many times with other columns each time:
    their plans share no shuffle, so every reading would build the bars from ticks again."""
    return stored(T.bars(spark, sf), "model-bars")


def _matrix(bars):
    index = C.calendar_index(C.sessions(bars))
    cutoff = G.walk_forward_split(index).first().train_end
    return G.training_matrix(bars, index, cutoff)


def _rounded(df, labels=True):
    names = {*X.FEATURE_NAMES, *(("label_1", "label_3", "label_5") if labels else ())}
    return df.select(*[F.round(c, 6).alias(c) if c in names else c for c in df.columns])


@query("training_matrix", _matrix_sql())
def training_matrix(spark, sf):
    return _rounded(_matrix(T.bars(spark, sf)))


@query("fit_multi_horizon", boosting_sql(G.MODEL_SETTINGS["maxIter"]) + f"""
select h::int as horizon, tree::int as tree, node::int as node,
  {[*X.FEATURE_NAMES]}[b.feature + 1] as feature, e.e as threshold
from boosted b join edges e on e.i = b.feature and e.bin = b.bin where b.id < 0""")
def fit_multi_horizon(spark, sf):
    """Every split of every tree; SQL grows the same trees from the same matrix."""
    matrix = _rounded(_matrix(T.bars(spark, sf)))
    nodes = G.model_nodes(G.fit_multi_horizon(matrix), matrix)
    return nodes.where("feature is not null").drop("prediction")


@query("score_panel", boosting_sql(G.MODEL_SETTINGS["maxIter"]) + """
select symbol, trade_date, round(sum(f) / 3, 6) as score
from boosted join binned using (id) where id > 0 group by all""")
def score_panel(spark, sf):
    bars = _kept_bars(spark, sf)
    models = G.fit_multi_horizon(_rounded(_matrix(bars)))
    panel = _rounded(X.feature_panel(bars))
    return G.score_panel(panel, models).select("symbol", "trade_date",
                                               F.round("score", 6).alias("score"))


def _fits_sql(model: str, cut: str) -> str:
    """Usable rows, cutoff and trees per horizon of the matrix that ends with ``cut``."""
    labels = ", ".join(f"{SAFE.format(h=h, v=f'l.label_{h}')} as label_{h}" for h in (1, 3, 5))
    matrix = _cut_sql(f"f.trade_date, {labels}", "train_end").replace(
        "(select train_end from split)", cut)
    return " union all ".join(
        f"select '{model}' as model, {h} as horizon, max(trade_date) as cutoff, "
        f"count(label_{h}) as usable_rows, 120 as trees from ({matrix})" for h in (1, 3, 5))


@query("model_fits", _fits_sql("evaluation", "(select train_end from split)") + " union all "
       + _fits_sql("production", "(select trade_date from sessions where idx = "
                                 "(select max(idx) - 5 from sessions))"))
def model_fits(spark, sf):
    bars = _kept_bars(spark, sf)
    matrix = _matrix(bars)
    found = G.fit_summary(matrix, G.fit_multi_horizon(matrix)).withColumn(
        "model", F.lit("evaluation"))
    refit = G.fit_summary(*G.production_fit(bars, C.calendar_index(C.sessions(bars))))
    return found.unionByName(refit.withColumn("model", F.lit("production")))


def _planted_sql() -> str:
    """The matrix that ends with the validation part, and the end of training."""
    ends = ", ".join(f"{SAFE.format(h=h, v=f'l.end_{h}')} as label_end_{h}" for h in (1, 3, 5))
    return _cut_sql(f"f.trade_date, {ends}, (select train_end from split) as train_end",
                    "validation_end")


@query("leak_checks", """
select check_id, 'pass' as status, 0::bigint as violations from (values
  ('temporal_split_monotonic'), ('label_window_inside_train'), ('training_rows_time_ordered'),
  ('validation_labels_outside_test'), ('feature_pit_truncation_invariant'),
  ('universe_fixed_audit_set_disclosed')) t(check_id)""")
def leak_checks(spark, sf):
    return G.audit_leaks(_kept_bars(spark, sf))


@query("leak_checks_planted", f"""
select check_id, case when violations = 0 then 'pass' else 'fail' end as status, violations
from (
  select 'temporal_split_monotonic' as check_id, 1::bigint as violations
  union all select 'label_window_inside_train', count(*) from ({_planted_sql()})
    where greatest(label_end_1, label_end_3, label_end_5) > train_end
  union all select 'training_rows_time_ordered', count(*) from ({_planted_sql()})
    where trade_date > train_end
  union all select 'validation_labels_outside_test', count(*) from features f
    join labels_h l on l.symbol = f.symbol and l.trade_date = f.trade_date and l.horizon = 5,
    split p where f.trade_date between p.validation_start and p.validation_end
    and l.label_end >= p.test_start
  union all select 'feature_pit_truncation_invariant', count(*) from features, split
    where trade_date = validation_end
  union all select 'universe_fixed_audit_set_disclosed', 1)""")
def leak_checks_planted(spark, sf):
    """Tables with a leak for every check: a matrix up to the end of validation, pairs without
    their guard, a replay that lacks a day, a split in the wrong order."""
    bars = _kept_bars(spark, sf)
    index = C.calendar_index(C.sessions(bars))
    split = G.walk_forward_split(index)
    found = split.first()
    matrix = G.training_matrix(bars, index, found.validation_end)
    pairs = X.panel_with_labels(bars, (5,)).where(F.col("trade_date").between(
        F.lit(found.validation_start), F.lit(found.validation_end))).select(
        F.col("label_end_5").alias("label_end"))
    panel = X.feature_panel(bars).where(F.col("trade_date") <= F.lit(found.validation_end))
    replayed = panel.where(F.col("trade_date") < F.lit(found.validation_end))
    wrong = split.withColumn("validation_end", F.date_sub("validation_start", 1))
    return G.leak_checks(matrix, pairs, wrong, panel, replayed, universe_disclosed=False)


PAIRS = """
select f.symbol, f.trade_date, f.ret_20d as score, l.label from features f
join labels_h l on l.symbol = f.symbol and l.trade_date = f.trade_date and l.horizon = 5
where l.label is not null"""
IC = f"""
select trade_date, count(*) as pairs, corr(rx, ry) as ic from (
  select trade_date, row_number() over (partition by trade_date order by score, symbol) as rx,
    row_number() over (partition by trade_date order by label, symbol) as ry from ({PAIRS}))
group by 1 having count(*) >= 3"""


def _pairs(spark, sf):
    return X.panel_with_labels(T.bars(spark, sf), (5,)).select(
        "symbol", "trade_date", F.col("ret_20d").alias("score"), F.col("label_5").alias("label"))


@query("rank_ic", f"select count(*) as dates, round(avg(ic), 6) as rank_ic from ({IC})")
def rank_ic(spark, sf):
    return R.rank_ic(_pairs(spark, sf)).withColumn("rank_ic", F.round("rank_ic", 6))


@query("rank_ic_by_date", f"select trade_date, pairs, round(ic, 6) + 0.0 as ic from ({IC})")
def rank_ic_by_date(spark, sf):
    return R.rank_ic_by_date(_pairs(spark, sf)).withColumn("ic", F.round("ic", 6))


@query("validation_pairs", """
select f.symbol, f.trade_date, round(f.ret_20d, 6) as score, round(l.label, 6) as label, l.label_end
from features f join labels_h l on l.symbol = f.symbol and l.trade_date = f.trade_date
  and l.horizon = 5 join sessions s on s.trade_date = f.trade_date, split p
where f.trade_date between p.validation_start and p.validation_end and l.label_end < p.test_start
  and s.idx + 5 < (select idx from sessions where trade_date = p.test_start)""")
def validation_pairs(spark, sf):
    bars = T.bars(spark, sf)
    scored = X.panel_with_labels(bars, (5,)).withColumn("score", F.col("ret_20d"))
    pairs = G.validation_pairs(scored, C.calendar_index(C.sessions(bars)))
    return pairs.select("symbol", "trade_date", F.round("score", 6).alias("score"),
                        F.round("label", 6).alias("label"), "label_end")


SCORED_PAIRS = """
select f.symbol, f.trade_date, f.score, l.label
from (select symbol, trade_date, round(sum(f) / 3, 9) as score from boosted
    join binned using (id) where id > 0 group by all) f
join labels_h l on l.symbol = f.symbol and l.trade_date = f.trade_date and l.horizon = 5
join sessions s on s.trade_date = f.trade_date, split p
where f.trade_date between p.validation_start and p.validation_end and l.label_end < p.test_start
  and s.idx + 5 < (select idx from sessions where trade_date = p.test_start)"""


@query("model_rank_ic", boosting_sql(G.MODEL_SETTINGS["maxIter"]) + f"""
select trade_date, pairs, round(ic, 6) + 0.0 as ic from ({IC.replace(PAIRS, SCORED_PAIRS)})""")
def model_rank_ic(spark, sf):
    """How well the fitted models rank the symbols on each validation date."""
    bars = _kept_bars(spark, sf)
    models = G.fit_multi_horizon(_rounded(_matrix(bars)))
    panel = _rounded(X.panel_with_labels(bars, (G.VALIDATION_HORIZON,)), labels=False)
    scored = G.score_panel(panel, models).withColumn("score", F.round("score", 9))
    pairs = G.validation_pairs(scored, C.calendar_index(C.sessions(bars)))
    return R.rank_ic_by_date(pairs.select("symbol", "trade_date", "score", "label")).withColumn(
        "ic", F.round("ic", 6))


def _importance_sql() -> str:
    ranks = " union all ".join(
        f"select '{n}' as name, row_number() over (order by {n}, symbol) as rx, "
        "row_number() over (order by score, symbol) as ry from latest" for n in X.FEATURE_NAMES)
    return f"""
select name, weight from (select name, round(abs(corr(rx, ry)), 6) as weight
  from (with latest as (select *, 0.75 * ret_5d + 0.25 * ret_20d as score from features
    where trade_date = (select max(trade_date) from features)) {ranks}) group by 1)
order by weight desc, name limit 3"""


@query("feature_importance", _importance_sql())
def feature_importance(spark, sf):
    scored = R.score_with(X.feature_panel(T.bars(spark, sf)),
                          F.lit(0.75) * F.col("ret_5d") + F.lit(0.25) * F.col("ret_20d"))
    return R.feature_importance(scored)


@query("model_document", f"""
select trade_date, part, parts, cast(count(*) as int) as ranked, arg_min(symbol, rnk) as first,
  any_value(train_end) as train_end, any_value(passed) as passed, round(any_value(top), 6) as top
from (select *, cast((rnk - 1) // 40 + 1 as int) as part,
    cast((count(*) over (partition by trade_date) - 1) // 40 + 1 as int) as parts from ranked),
  (select train_end from split), (select 6::bigint as passed),
  (select max(weight) as top from ({_importance_sql()}))
group by 1, 2, 3""")
def model_document(spark, sf):
    from ..operators.report import model_document as build

    bars = _kept_bars(spark, sf)
    panel = X.feature_panel(bars)
    scored = R.score_with(panel, F.col("ret_20d"))
    ranks = R.daily_rank(scored.select("symbol", "trade_date", "score"))
    split = G.walk_forward_split(C.calendar_index(C.sessions(bars)))
    weighed = R.score_with(panel, F.lit(0.75) * F.col("ret_5d") + F.lit(0.25) * F.col("ret_20d"))
    docs = build(ranks, R.feature_importance(weighed), G.audit_leaks(bars), split, ["SYNTHETIC"],
                 part_rows=40)
    body = F.from_json("document", "rankings array<struct<rank int, symbol string>>, "
                       "factors array<struct<name string, weight double>>, "
                       "leak_checks array<struct<check_id string, status string>>, "
                       "splits struct<train_end date>")
    return docs.withColumn("b", body).select(
        "trade_date", "part", "parts", "ranked", F.col("b.rankings")[0]["symbol"].alias("first"),
        F.col("b.splits.train_end").alias("train_end"), F.size(F.filter(
            "b.leak_checks", lambda c: c["status"] == "pass")).cast("bigint").alias("passed"),
        F.round(F.array_max(F.col("b.factors.weight")), 6).alias("top"))
