"""Market tables derived by Spark from the driver's Parquet tables.

Every table grows with its source. Rows with planted defects are picked by key
arithmetic so that each rule of the operators has something to find.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.bars import bars_from_ticks
from ..plans import ordered_scan, spread

# The request window and the as-of dates the queries use.
WINDOW_START, WINDOW_END = "1995-02-01", "2001-09-30"
FIRST_DAY, LAST_DAY = "1995-01-02", "2001-11-04"
AS_OF = "2000-12-29"
EXPECTED_AS_OF = "2001-11-03"
OFFICIAL_HOST = "blog.tionsh.example.net"
SIX_DIGIT_TURNS = 88_000  # 600000 and this many more stay below 688000


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def day(text: str) -> Column:
    return F.lit(text).cast("date")


def symbol_of(k: Column) -> Column:
    """A code of its own and the exchange of instrument ``k``; five families by ``k % 5``.

    Codes count up in six digits from the family's first one; instruments that six digits do not
    hold without meeting another family get longer codes.
    """
    family = (k % 5).cast("int") + 1
    head = F.element_at(F.array(*map(F.lit, ("600", "000", "300", "688", "430"))), family)
    tail = F.element_at(F.array(*map(F.lit, (".SH", ".SZ", ".SZ", ".SH", ".BJ"))), family)
    turn = F.floor(k / 5)
    short = F.lpad((head.cast("bigint") * 1000 + turn).cast("string"), 6, "0")
    return F.concat(F.when(turn < SIX_DIGIT_TURNS, short).otherwise(
        F.concat(head, turn.cast("string"))), tail)


def ticks(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("k"),
        F.col("l_shipdate").cast("date").alias("trade_date"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        (F.col("l_orderkey") * 10000000 + F.col("l_partkey") * 10 + F.col("l_linenumber"))
        .alias("seq"),
        F.col("l_quantity").cast("bigint").alias("volume"),
        F.col("l_extendedprice").cast("decimal(18,2)").alias("amount"),
    )


def keyed_bars(spark: SparkSession, sf: str) -> DataFrame:
    return bars_from_ticks(ticks(spark, sf), ["k", "trade_date"])


def bars(spark: SparkSession, sf: str) -> DataFrame:
    return keyed_bars(spark, sf).select(
        symbol_of(F.col("k")).alias("symbol"), "trade_date", "open", "high", "low", "close",
        "volume", "amount")


def instruments(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("k")).distinct()


def trade_calendar(spark: SparkSession, sf: str) -> DataFrame:
    """Every day the trades span; Sundays are closed."""
    span = table(spark, sf, "lineitem").agg(
        F.min("l_shipdate").cast("date").alias("a"), F.max("l_shipdate").cast("date").alias("b"))
    days = span.select(F.explode(F.sequence("a", "b")).alias("cal_date"))
    weekday = F.dayofweek("cal_date")
    return days.select(
        F.lit("SSE").alias("exchange"), "cal_date",
        F.when(weekday == 1, 0).otherwise(1).alias("is_open"),
        F.date_sub("cal_date", F.when(weekday == 2, 2).otherwise(1)).alias("pretrade_date"))


def open_days(spark: SparkSession, sf: str) -> DataFrame:
    return trade_calendar(spark, sf).where("is_open = 1").select(
        F.col("cal_date").alias("trade_date"))


def securities(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("k")
    ts_code = symbol_of(k)
    return instruments(spark, sf).select(
        "k", ts_code.alias("ts_code"), F.substring(ts_code, 1, 6).alias("symbol"),
        F.concat(F.lit("Company "), k.cast("string")).alias("name"),
        F.when(k % 9 != 0, F.concat(F.lit("Area "), (k % 9).cast("string"))).alias("area"),
        F.lit("Industry").alias("industry"),
        F.when(k % 6 != 0, "Market").alias("market"),
        F.date_add(day(FIRST_DAY), (k % 200).cast("int")).alias("list_date"),
        F.when(k % 7 == 3, day("2000-06-30")).alias("delist_date"),
        F.when(k % 7 == 3, "D").when(k % 11 == 5, "P").otherwise("L").alias("list_status"))


def lifecycles(spark: SparkSession, sf: str) -> DataFrame:
    return securities(spark, sf).select(
        F.col("ts_code").alias("symbol"), F.col("list_date").alias("listed_on"),
        F.col("delist_date").alias("delisted_on"))


def memberships(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("k")

    def span(start: str, end: str | None) -> Column:
        return F.struct(day(start).alias("valid_from"),
                        (day(end) if end else F.lit(None).cast("date")).alias("valid_to"))

    spans = (
        F.when(k % 4 == 0, F.array(span("1995-01-02", None)))
        .when(k % 4 == 1, F.array(span("1996-01-01", "1999-12-31")))
        .when(k % 4 == 2, F.array(span("1995-01-02", "1997-06-30"), span("1998-01-01", None)))
        .when(k % 8 == 7, F.array(span("1995-01-02", "1998-06-30"), span("1998-06-01", None)))
        .otherwise(F.array(span("1995-01-02", "1998-06-30"), span("1998-07-01", None)))
    )
    return (instruments(spark, sf)
            .select(symbol_of(k).alias("symbol"), F.explode(spans).alias("s"))
            .select("symbol", "s.valid_from", "s.valid_to"))


def suspensions(spark: SparkSession, sf: str) -> DataFrame:
    """Records on days without a bar: S, R or none by ``(k + day of year) % 5``.

    An instrument meets its traded days as one array, a calendar at most, and is laid out to the
    other days after that, so no row per instrument and day is shuffled.
    """
    traded = ticks(spark, sf).groupBy("k").agg(F.collect_set("trade_date").alias("traded"))
    every = F.sequence(day(FIRST_DAY), day(LAST_DAY))
    days = (spread(instruments(spark, sf), "k").join(traded, "k", "left")
            .select("k", F.explode(F.array_except(every, F.coalesce(
                "traded", F.array().cast("array<date>")))).alias("trade_date")))
    pick = (F.col("k") + F.dayofyear("trade_date")) % 5
    return (days.where(pick < 4)
            .select(symbol_of(F.col("k")).alias("ts_code"), "trade_date",
                    F.lit(None).cast("string").alias("suspend_timing"),
                    F.when(pick < 3, "S").otherwise("R").alias("suspend_type")))


def raw_bars(spark: SparkSession, sf: str) -> DataFrame:
    """Vendor bars in lots and thousands, with one defect in about 13."""
    defect = (F.col("k") * 31 + F.dayofyear("trade_date")) % 97
    copies = F.when(defect == 3, 2).otherwise(1)
    raw = keyed_bars(spark, sf).withColumn("d", defect)
    return raw.select(
        symbol_of(F.col("k")).alias("ts_code"), "trade_date",
        F.when(F.col("d") == 0, 0.0).otherwise(F.col("open")).alias("open"),
        "high",
        F.when(F.col("d") == 1, F.col("high") + 1).otherwise(F.col("low")).alias("low"),
        F.when(F.col("d") == 5, float("nan")).otherwise(F.col("close")).alias("close"),
        F.when(F.col("d") == 4, 0.0).when(F.col("d") == 6, -1.0)
        .otherwise(F.col("volume") / 100).alias("vol"),
        F.when(F.col("d") == 2, F.col("amount") / 500).otherwise(F.col("amount") / 1000)
        .alias("amount"),
        F.explode(F.sequence(F.lit(1), copies)).alias("copy"),
    ).drop("copy")


def requested(spark: SparkSession, sf: str) -> DataFrame:
    return instruments(spark, sf).where("k % 50 <> 49").select(
        symbol_of(F.col("k")).alias("symbol"))


def adj_factors(spark: SparkSession, sf: str) -> DataFrame:
    """Factors for most bars, plus some dated ten years later that match none."""
    doy = F.dayofyear("trade_date")
    days = (F.when((F.col("k") + doy) % 23 == 0, F.array(F.lit(0), F.lit(3650)))
            .when((F.col("k") + doy) % 19 != 0, F.array(F.lit(0))).otherwise(F.array().cast(
                "array<int>")))
    return (ticks(spark, sf).select("k", "trade_date").distinct()
            .select("k", "trade_date", F.explode(days).alias("shift"))
            .select(symbol_of(F.col("k")).alias("ts_code"),
                    F.date_add("trade_date", F.col("shift")).alias("trade_date"),
                    (1 + (F.col("k") % 10) / 10).cast("double").alias("adj_factor")))


def cost_segments(spark: SparkSession) -> DataFrame:
    """One row per market and period; the third exchange has none."""
    rate = "decimal(10,6)"
    rows = [("old", "1990-01-01", "1998-06-30", "0.001"), ("new", "1998-07-01", None, "0.0005")]
    return spark.createDataFrame(
        [(m, n, a, b, "0", s, "0.00001", "0.00001") for m in ("SH", "SZ") for n, a, b, s in rows],
        "market string, segment_id string, effective_from string, effective_to string, "
        "stamp_buy string, stamp_sell string, transfer_buy string, transfer_sell string",
    ).select("market", "segment_id",
             F.col("effective_from").cast("date").alias("effective_from"),
             F.col("effective_to").cast("date").alias("effective_to"),
             *[F.col(c).cast(rate).alias(c)
               for c in ("stamp_buy", "stamp_sell", "transfer_buy", "transfer_sell")])


def market_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [("main", "normal", 100, 0.10), ("gem", "normal", 100, 0.20),
         ("star", "normal", 100, 0.20), ("main", "special", 100, 0.05)],
        "board string, security_status string, lot_size int, price_limit_pct double")


def _of_line() -> list[Column]:
    return [
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                    F.date_format("l_shipdate", "yyyyMMdd")).alias("trade_id"),
        symbol_of(F.col("l_suppkey")).alias("symbol"),
        F.col("l_shipdate").cast("date").alias("trade_date"),
        F.when(F.col("l_returnflag") == "R", "sell").otherwise("buy").alias("side"),
        (F.col("l_quantity").cast("bigint") * 100).alias("shares"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        (F.col("l_extendedprice").cast("decimal(18,2)") * 100).cast("decimal(20,2)")
        .alias("gross")]


def traded_lines(spark: SparkSession, sf: str) -> DataFrame:
    """What a trade takes from its line item."""
    return table(spark, sf, "lineitem").select("l_orderkey", *_of_line())


def trades(spark: SparkSession, sf: str) -> DataFrame:
    """Executed trades: one per line item, booked on the account of its order. Ids and names are
    made after the join, which moves plain numbers."""
    orders = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("account"))
    return table(spark, sf, "lineitem").join(orders, "l_orderkey").select(*_of_line(), "account")


def accounts(spark: SparkSession, sf: str) -> DataFrame:
    """Opening cash of every account."""
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("account"),
        (F.col("c_acctbal").cast("decimal(18,2)") * 1000).cast("decimal(20,2)").alias("cash"))


def order_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Orders to screen: the trades' intents, without their fills."""
    return trades(spark, sf).select("trade_id", "account", "symbol", "trade_date", "side",
                                    "shares").withColumnRenamed("trade_id", "order_id")


def holdings(spark: SparkSession, sf: str) -> DataFrame:
    """Net long shares per account and symbol, and what was bought on the last day."""
    net = F.sum(F.when(F.col("side") == "buy", F.col("shares")).otherwise(-F.col("shares")))
    late = F.sum(F.when((F.col("side") == "buy") & (F.col("trade_date") >= day("2001-09-01")),
                        F.col("shares")).otherwise(0))
    return (trades(spark, sf).groupBy("account", "symbol")
            .agg(net.alias("shares"), late.alias("bought_late"))
            .where("shares > 0")
            .select("account", "symbol", "shares",
                    F.least("bought_late", "shares").alias("locked_shares")))


def signals(spark: SparkSession, sf: str) -> DataFrame:
    """One signal document per order, chained per customer, some links damaged."""
    key = F.col("o_orderkey")
    numbered = ordered_scan(
        table(spark, sf, "orders").select(
            key.alias("signal_id"), F.col("o_custkey").alias("chain"),
            F.col("o_orderdate").cast("date").alias("as_of"),
            F.when(F.col("o_orderstatus") == "F", "ACTIVE")
            .when(F.col("o_orderstatus") == "O", "HOLD").otherwise("REDUCE_ONLY").alias("state")),
        ["chain"], ["as_of", "signal_id"], number="position", slice_by=F.trunc("as_of", "year"))
    sid = F.col("signal_id")
    made = numbered.select(
        "chain", "position", "signal_id", "as_of", "state",
        (F.col("position") + F.when(sid % 53 == 0, 1).otherwise(0)).alias("sequence"),
        F.concat(F.lit("run-"), F.when(sid % 67 == 0, 0).otherwise(sid).cast("string"))
        .alias("run_id"),
        (F.datediff("as_of", day("1990-01-01")).cast("bigint") * 100 + F.col("position")
         - F.when(sid % 61 == 0, 100000).otherwise(0)).alias("generated_at"))
    hashed = made.withColumn("document_hash", F.sha2(F.concat_ws(
        "|", sid.cast("string"), "chain", "sequence", "state", F.col("as_of").cast("string"),
        "generated_at"), 256))
    linked = ordered_scan(hashed, ["chain"], ["position"],
                          previous={"previous_signal_hash": "document_hash"},
                          slice_by=F.floor(F.col("position") / 100_000))
    return linked.withColumn(
        "previous_signal_hash",
        F.when(sid % 59 == 0, F.sha2(sid.cast("string"), 256))
        .otherwise(F.col("previous_signal_hash"))).drop("position")


def signal_heads(spark: SparkSession, sf: str) -> DataFrame:
    """Head record of every signal; some name another sequence."""
    return signals(spark, sf).select(
        "chain", "signal_id", F.col("as_of").alias("head_as_of"),
        (F.col("sequence") + F.when(F.col("signal_id") % 71 == 0, 1).otherwise(0))
        .alias("head_sequence"),
        F.col("document_hash").alias("head_signal_hash"),
        (F.col("generated_at") + F.when(F.col("signal_id") % 73 == 0, 1).otherwise(0))
        .alias("head_generated_at"))


def targets(spark: SparkSession, sf: str) -> DataFrame:
    """Target weights of each signal: one per line item."""
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("signal_id"),
        symbol_of(F.col("l_suppkey")).alias("symbol"),
        (F.col("l_quantity") / 200).alias("weight"))


def health(spark: SparkSession, sf: str) -> DataFrame:
    """Health flags of one run per order."""
    key = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        key.alias("run"),
        (key % 13 != 0).alias("execution_data_valid"),
        (key % 17 != 0).alias("previous_target_known"),
        (key % 7 != 0).alias("decision_data_valid"),
        (key % 11 != 0).alias("contracts_valid"),
        (key % 19 != 0).alias("hashes_valid"),
        F.when(key % 5 == 0, "NEVER_ACTIVATED").when(key % 5 == 1, "WITHDRAWN")
        .otherwise("HEALTHY").alias("champion"),
        F.when(key % 23 == 0, "FLAT").when(key % 29 == 0, "REDUCE").otherwise("NONE")
        .alias("risk_action"))


def request_log(spark: SparkSession, sf: str) -> DataFrame:
    """Attempt log of a paging client: one row per event."""
    e = F.col("event_id")
    failed = e % 4 == 0
    cause = F.floor(e / 4) % 5
    return table(spark, sf, "events").select(
        e.alias("sequence"), F.col("event_type").alias("api_name"),
        F.array(
            F.struct(F.lit("ts_code").alias("name"), F.col("user_id").cast("string").alias("value")),
            F.struct(F.lit("api_Token").alias("name"), e.cast("string").alias("value")),
            F.struct(F.lit("note").alias("name"),
                     F.when(e % 3 == 0, "s3cret").otherwise("plain").alias("value")),
        ).alias("params"),
        F.col("user_id").alias("request_id"),
        (e % 3 * 5000).alias("offset"), F.lit(5000).cast("bigint").alias("page_limit"),
        F.when(failed, "FAILURE").otherwise("SUCCESS").alias("outcome"),
        F.when(failed, F.when(cause == 0, "http_429").when(cause == 1, "rate_limit")
               .when(cause == 2, "vendor_code_-2000").when(cause == 3, "timeout")
               .otherwise("bad_request")).alias("error_reason"),
        (failed & (cause < 4)).alias("transient"),
        F.when(failed, 0).when(e % 3 == 2, e % 5000).otherwise(5000).cast("bigint")
        .alias("row_count"),
        F.when(~failed, F.sha2(F.concat_ws("|", (e % 3).cast("string"),
                                           F.col("user_id").cast("string")), 256))
        .alias("page_hash"),
        F.concat(F.lit("failed at "), F.hex(e), F.lit(" key deadbeef0123 "),
                 F.col("props")).alias("message"))


def vendor_text(date: str) -> Column:
    return F.date_format(date, "yyyyMMdd")


def raw_calendar(spark: SparkSession, sf: str) -> DataFrame:
    """The calendar as vendor text with damaged rows picked by day of year."""
    doy = F.dayofyear("cal_date")
    copies = F.when(doy % 59 == 0, 2).otherwise(1)
    return trade_calendar(spark, sf).select(
        F.when(doy % 43 == 0, "SZSE").otherwise(F.col("exchange")).alias("exchange"),
        F.when(doy % 37 == 0, F.concat(F.year("cal_date").cast("string"), F.lit("0931")))
        .otherwise(vendor_text("cal_date")).alias("cal_date"),
        F.when(doy % 41 == 0, "2").otherwise(F.col("is_open").cast("string")).alias("is_open"),
        F.when(doy % 47 == 0, "soon").when(doy % 53 == 0, "")
        .otherwise(vendor_text("pretrade_date")).alias("pretrade_date"),
        F.explode(F.sequence(F.lit(1), copies)).alias("copy")).drop("copy")


def raw_securities(spark: SparkSession, sf: str) -> DataFrame:
    """Master rows as vendor text, with the batch that returned them."""
    k = F.col("k")
    odd = k % 13 == 6
    copies = F.when(k % 37 == 30, 2).otherwise(1)
    return securities(spark, sf).select(
        F.col("list_status").alias("batch"),
        F.when(odd, F.concat(F.lit("T"), "ts_code")).otherwise(F.col("ts_code")).alias("ts_code"),
        F.when(odd, F.concat(F.lit("T"), "symbol")).when(k % 31 == 8, "999999")
        .otherwise(F.col("symbol")).alias("symbol"),
        F.when(k % 17 == 2, "").otherwise(F.col("name")).alias("name"),
        "area", "industry", "market",
        F.when(k % 19 == 4, "20230931").otherwise(vendor_text("list_date")).alias("list_date"),
        F.when(k % 23 == 9, "19900101").otherwise(vendor_text("delist_date"))
        .alias("delist_date"),
        F.when(k % 29 == 1, "X").otherwise(F.col("list_status")).alias("list_status"),
        F.explode(F.sequence(F.lit(1), copies)).alias("copy")).drop("copy")


def raw_daily(spark: SparkSession, sf: str) -> DataFrame:
    """Bars as vendor text with damaged rows."""
    d = F.col("d")
    copies = F.when(d == 3, 2).otherwise(1)
    k = F.col("k")
    return (keyed_bars(spark, sf)
            .withColumn("d", (k * 31 + F.dayofyear("trade_date")) % 89).select(
        F.when(d == 0, F.concat(F.lit("X"), symbol_of(k))).otherwise(symbol_of(k)).alias("ts_code"),
        F.when(d == 1, "20230931").otherwise(vendor_text("trade_date")).alias("trade_date"),
        F.when(d == 2, "abc").otherwise(F.col("open").cast("string")).alias("open"),
        F.col("high").cast("string").alias("high"), F.col("low").cast("string").alias("low"),
        F.when(d == 4, "NaN").otherwise(F.col("close").cast("string")).alias("close"),
        F.col("volume").cast("string").alias("vol"),
        F.col("amount").cast("string").alias("amount"),
        F.explode(F.sequence(F.lit(1), copies)).alias("copy")).drop("copy"))


def raw_suspensions(spark: SparkSession, sf: str) -> DataFrame:
    day_of_year = F.dayofyear("trade_date")
    copies = F.when(day_of_year % 59 == 0, 2).otherwise(1)
    return suspensions(spark, sf).select(
        "ts_code", vendor_text("trade_date").alias("trade_date"), "suspend_timing",
        F.when(day_of_year % 61 == 0, "Q").otherwise(F.col("suspend_type")).alias("suspend_type"),
        F.explode(F.sequence(F.lit(1), copies)).alias("copy")).drop("copy")


def raw_adj_factors(spark: SparkSession, sf: str) -> DataFrame:
    day_of_year = F.dayofyear("trade_date")
    return adj_factors(spark, sf).select(
        "ts_code", vendor_text("trade_date").alias("trade_date"),
        F.when(day_of_year % 61 == 0, "-1").when(day_of_year % 67 == 0, "Infinity")
        .otherwise(F.col("adj_factor").cast("string")).alias("adj_factor"))


def envelopes(spark: SparkSession, sf: str) -> DataFrame:
    """Responses of the bar API: one page per symbol and year, every other page with its
    fields reversed, some pages damaged."""
    k = F.col("k")
    cells = F.array(symbol_of(k), vendor_text("trade_date"),
                    F.col("volume").cast("bigint").cast("string"))
    names = F.array(*map(F.lit, ("ts_code", "trade_date", "vol")))
    page = F.col("k") * 10000 + F.col("year")
    pages = (keyed_bars(spark, sf).withColumn("year", F.year("trade_date"))
             .groupBy("k", "year").agg(F.collect_list(cells).alias("items")))
    turned = page % 2 == 1
    return pages.select(
        page.alias("sequence"), F.lit("daily").alias("api_name"), F.lit(0).alias("code"),
        F.when(page % 11 == 0, F.array(*map(F.lit, ("ts_code", "trade_date", "other"))))
        .when(turned, F.reverse(names)).otherwise(names).alias("fields"),
        F.when(page % 13 == 0, F.transform("items", lambda r: F.slice(r, 1, 2)))
        .when(turned, F.transform("items", F.reverse)).otherwise(F.col("items")).alias("items"))


def account_targets(spark: SparkSession, sf: str) -> DataFrame:
    """Ranked targets of every account: the lines of its latest order."""
    latest = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("account")).agg(
        F.max(F.struct("o_orderdate", "o_orderkey")).alias("m")).select(
        "account", F.col("m.o_orderkey").alias("l_orderkey"))
    return (table(spark, sf, "lineitem").join(latest, "l_orderkey")
            .select("account", symbol_of(F.col("l_suppkey")).alias("symbol"),
                    "l_linenumber")
            .groupBy("account", "symbol").agg(F.min("l_linenumber").alias("rank")))


def signal_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Signals with the id of the previous one in their chain, and a runtime state."""
    listed = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("signal_id"), F.col("o_custkey").alias("chain"),
        F.col("o_orderdate").cast("date").alias("as_of"))
    linked = ordered_scan(listed, ["chain"], ["as_of", "signal_id"],
                          previous={"previous_signal_id": "signal_id"},
                          slice_by=F.trunc("as_of", "year"))
    sid = F.col("signal_id")
    return linked.select("signal_id", "previous_signal_id", F.when(sid % 4 == 0, "ACTIVE").when(
        sid % 4 == 1, "HOLD").when(sid % 4 == 2, "REDUCE_ONLY").otherwise("FLAT").alias("state"))


def bindings(spark: SparkSession, sf: str, actual: bool) -> DataFrame:
    """Bound contract values per run; the actual ones differ on some runs."""
    run = F.col("o_orderkey")

    def value(name: str, every: int) -> Column:
        base = F.concat(F.lit(f"{name}-"), (run % 5).cast("string"))
        return F.when(run % every == 0, "changed").otherwise(base) if actual else base

    fields = {"cost_model": 7, "execution_policy": 11, "market_rules": 13, "portfolio_risk": 17,
              "dataset_family": 19, "data_schema": 23, "normalization_version": 29,
              "universe_policy": 31, "universe_policy_version": 37, "lockfile": 41}
    return table(spark, sf, "orders").select(
        run.alias("run"), *[value(n, e).alias(n) for n, e in fields.items()],
        ((run % 43 != 0) | F.lit(not actual)).alias("adapter_verified"))


def universe(spark: SparkSession, sf: str) -> DataFrame:
    return instruments(spark, sf).select(symbol_of(F.col("k")).alias("symbol"),
                                         (F.col("k") % 6 != 0).alias("eligible"))
