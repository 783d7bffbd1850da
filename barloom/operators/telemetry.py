"""Audits of a paging client's attempt log and of the master batches it fetched."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import mask_message, redact_params, row_fingerprint, source_columns
from ..plans import ordered_scan

# Error reasons that mean "too many requests", and the page limit.
RATE_LIMIT_REASONS = ("http_429", "rate_limit", "vendor_code_-2000")
MAX_PAGES = 200

SLICE_ROWS = 100_000  # consecutive sequence numbers in a slice of an ordered scan

REQUEST_KEY = ["api_name", "request_id", "offset"]


def attempts(log: DataFrame) -> DataFrame:
    """The log with ``is_retry``: the attempt before it on the same page failed in passing."""
    linked = ordered_scan(log, REQUEST_KEY, ["sequence"],
                          previous={"_before": "outcome", "_passing": "transient"},
                          slice_by=F.floor(F.col("sequence") / SLICE_ROWS))
    retry = (F.col("_before") == "FAILURE") & F.col("_passing")
    return linked.withColumn("is_retry", F.coalesce(retry, F.lit(False))).drop(
        "_before", "_passing")


def api_telemetry(log: DataFrame) -> DataFrame:
    """Counters per API, and in total under ``(all)``."""
    passing = F.col("transient")
    limited = passing & F.col("error_reason").isin(*RATE_LIMIT_REASONS)
    fresh = ~F.col("is_retry")
    counted = attempts(log).rollup("api_name").agg(
        F.count_if(fresh & (F.col("offset") == 0)).alias("logical_calls"),
        F.count_if(fresh).alias("pages"),
        F.count("*").alias("attempts"),
        F.count_if(F.col("outcome") == "SUCCESS").alias("successes"),
        F.count_if(F.col("outcome") == "FAILURE").alias("failures"),
        F.count_if(F.col("is_retry")).alias("retries"),
        F.count_if(passing).alias("transient_errors"),
        F.count_if(limited).alias("rate_limit_errors"),
        F.count_if(passing & ~limited).alias("other_transient_errors"))
    return counted.withColumn("api_name", F.coalesce("api_name", F.lit("(all)"))).withColumn(
        "reconciles", (F.col("attempts") == F.col("successes") + F.col("failures"))
        & (F.col("attempts") == F.col("pages") + F.col("retries")))


def page_audit(log: DataFrame) -> DataFrame:
    """Findings per successful page of every request: the same page twice in a row, too
    many pages, or rows after a short page."""
    pages = log.where("outcome = 'SUCCESS'")
    linked = ordered_scan(pages, ["api_name", "request_id"], ["sequence"], number="page",
                          previous={"_hash": "page_hash", "_rows": "row_count"},
                          slice_by=F.floor(F.col("sequence") / SLICE_ROWS))
    code = F.array_compact(F.array(
        F.when((F.col("page_hash") == F.col("_hash")) & (F.col("row_count") > 0),
               "IDENTICAL_PAGE"),
        F.when(F.col("page") > MAX_PAGES, "PAGE_LIMIT_EXCEEDED"),
        F.when(F.col("_rows") < F.col("page_limit"), "SHORT_PAGE_NOT_LAST")))
    return linked.select("sequence", "api_name", "request_id", "page",
                         F.explode(code).alias("code"))


def redact_log(log: DataFrame, secret: str) -> DataFrame:
    """The log with secrets masked in parameters and messages."""
    return (log.withColumn("params", redact_params("params", F.lit(secret)))
            .withColumn("message", mask_message("message")))


def source_identity(urls: DataFrame, official_host: str, url: str = "url") -> DataFrame:
    """Host, official flag, source label and warning of every endpoint; drops the URL."""
    keep = [c for c in urls.columns if c != url]
    return urls.select(*keep, *source_columns(url, official_host))


def with_fingerprint(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.withColumn("row_fingerprint", row_fingerprint(columns))


def master_expectations(judged: DataFrame, expected: DataFrame, window_start) -> DataFrame:
    """Every expected symbol with what its accepted master row breaks.

    ``expected`` has symbol, list_status and delist_date (null for none); ``judged`` is the output
    of the master parser. A list date must be known and not after the start of the window.
    """
    rows = judged.where("reason_code is null").select(
        F.col("ts_code").alias("symbol"), F.col("list_status").alias("_status"),
        F.col("list_date").alias("_listed"), F.col("delist_date").alias("_delisted"))
    found = F.col("_status").isNotNull()
    late = F.col("_listed").isNull() | (F.col("_listed") > F.lit(str(window_start)).cast("date"))
    codes = F.array_compact(F.array(
        F.when(~found, "MISSING_SYMBOL"),
        F.when(found & (F.col("_status") != F.col("list_status")), "LIST_STATUS_CHANGED"),
        F.when(found & late, "INVALID_LIST_DATE"),
        F.when(found & ~F.col("_delisted").eqNullSafe(F.col("delist_date")),
               "DELIST_DATE_CHANGED")))
    return expected.join(rows, "symbol", "left").select("symbol", codes.alias("codes"))


def reconcile_batches(judged: DataFrame) -> DataFrame:
    """Accepted and rejected rows per status batch, and symbols found in two batches.

    ``judged`` is the output of the master parser: list_status, ts_code, reason_code.
    """
    accepted = F.col("reason_code").isNull()
    spread = (judged.where(accepted).groupBy("ts_code", "batch").agg(F.count("*").alias("n"))
              .groupBy("ts_code").agg(F.count("*").alias("batches"),
                                      F.min("batch").alias("batch")))
    clashes = spread.where("batches > 1").groupBy("batch").agg(
        F.count("*").alias("symbols_in_two_batches"))
    counts = judged.groupBy("batch").agg(
        F.count("*").alias("raw_rows"), F.count_if(accepted).alias("accepted_rows"),
        F.count_if(F.col("reason_code") == "INVALID_VENDOR_TS_CODE").alias("rejected_rows"),
        F.count_if(~accepted & (F.col("reason_code") != "INVALID_VENDOR_TS_CODE"))
        .alias("failed_rows"))
    return (counts.join(clashes, "batch", "left").select(
        "batch", "raw_rows", "accepted_rows", "rejected_rows", "failed_rows",
        F.coalesce("symbols_in_two_batches", F.lit(0)).alias("symbols_in_two_batches"))
        .withColumn("reconciles", (F.col("raw_rows") == F.col("accepted_rows")
                                   + F.col("rejected_rows"))
                    & (F.col("symbols_in_two_batches") == 0)))
