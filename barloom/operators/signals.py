"""Checks on tables of signals and targets. Every check returns all codes that apply."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import resolve_state
from ..plans import ordered_scan

# Tolerances and the names of the bound fields.
SUM_TOLERANCE = 1e-12
CONTRACT_FIELDS = (
    "cost_model", "execution_policy", "market_rules", "portfolio_risk", "dataset_family",
    "data_schema", "normalization_version", "universe_policy", "universe_policy_version",
)
HASH_FIELDS = ("lockfile",)
SLICE_ROWS = 100_000  # consecutive sequence numbers in a slice of an ordered scan


def resolve_states(health: DataFrame) -> DataFrame:
    return health.withColumn("state", resolve_state())


def codes(*rules: tuple[Column, str]) -> Column:
    """Codes of all rules that fire, in the order given."""
    return F.array_compact(F.array(*[F.when(hit, code) for hit, code in rules]))


def portfolio_constraints(targets: DataFrame, universe: DataFrame, max_positions: int,
                          max_single_weight: float, max_gross_exposure: float) -> DataFrame:
    """Violations of the portfolio contract per signal."""
    if max_positions < 1:
        raise ValueError("max_positions must be positive")
    if not 0 < max_single_weight <= 1 or not 0 <= max_gross_exposure <= 1:
        raise ValueError("weights must lie in the unit interval")
    members = universe.where("eligible").select("symbol", F.lit(True).alias("_ok"))
    # First per (signal, symbol), which finds duplicates and shrinks a hot signal.
    lines = targets.groupBy("signal_id", "symbol").agg(
        F.count("*").alias("n"), F.sum("weight").alias("w"), F.max("weight").alias("top"))
    per_signal = lines.join(members, "symbol", "left").groupBy("signal_id").agg(
        F.sum("n").alias("targets"), F.max("n").alias("copies"),
        F.count_if(F.col("_ok").isNull()).alias("ineligible"), F.max("top").alias("top"),
        F.sum("w").alias("gross"))
    return per_signal.select(
        "signal_id", "targets", codes(
            (F.col("copies") > 1, "DUPLICATE_SYMBOL"),
            (F.col("targets") > max_positions, "TOO_MANY_POSITIONS"),
            (F.col("ineligible") > 0, "INELIGIBLE_SYMBOL"),
            (F.col("top") > max_single_weight, "SINGLE_WEIGHT_EXCEEDED"),
            (F.col("gross") > max_gross_exposure + SUM_TOLERANCE, "GROSS_EXPOSURE_EXCEEDED"),
        ).alias("codes"))


def target_transition(signals: DataFrame, targets: DataFrame) -> DataFrame:
    """Violations of the rules for moving from the previous targets to the current ones.

    ``signals`` has signal_id, previous_signal_id (null for the first) and state. Current
    and previous lines are tagged, unioned and grouped, so the full join is one
    aggregation by (signal, symbol).
    """
    lines = targets.groupBy("signal_id", "symbol").agg(
        F.count("*").alias("n"), F.sum("weight").alias("w"))
    now = signals.select("signal_id").join(lines, "signal_id").select(
        "signal_id", "symbol", F.col("n").alias("cn"), F.col("w").alias("cw"),
        F.lit(None).cast("bigint").alias("pn"), F.lit(None).cast("double").alias("pw"))
    then = (signals.where("previous_signal_id is not null")
            .select("signal_id", "previous_signal_id")
            .join(lines.withColumnRenamed("signal_id", "previous_signal_id"), "previous_signal_id")
            .select("signal_id", "symbol", F.lit(None).cast("bigint"),
                    F.lit(None).cast("double"), F.col("n"), F.col("w")))
    pairs = now.union(then).groupBy("signal_id", "symbol").agg(
        *[F.max(c).alias(c) for c in ("cn", "cw", "pn", "pw")])
    summed = pairs.groupBy("signal_id").agg(
        F.count("cw").alias("current"), F.count("pw").alias("previous"),
        F.max("cn").alias("cn"), F.max("pn").alias("pn"),
        F.sum("cw").alias("cw"), F.sum("pw").alias("pw"),
        F.count_if(F.col("pw").isNull()).alias("added"),
        F.count_if(F.col("cw") > F.col("pw") + SUM_TOLERANCE).alias("raised"),
        F.count_if(~F.col("cw").eqNullSafe(F.col("pw"))).alias("different"))
    row = signals.select("signal_id", "state", F.col("previous_signal_id").isNull()
                         .alias("first")).join(summed, "signal_id", "left")
    n = {c: F.coalesce(F.col(c), F.lit(0)) for c in
         ("current", "previous", "cn", "pn", "added", "raised", "different")}
    hold, reduce_ = F.col("state") == "HOLD", F.col("state") == "REDUCE_ONLY"
    known = ~F.col("first")
    return row.select("signal_id", "state", codes(
        (n["cn"] > 1, "CURRENT_DUPLICATE_SYMBOL"),
        (n["pn"] > 1, "PREVIOUS_DUPLICATE_SYMBOL"),
        (F.coalesce("cw", F.lit(0.0)) > 1 + SUM_TOLERANCE, "CURRENT_WEIGHT_ABOVE_ONE"),
        (F.coalesce("pw", F.lit(0.0)) > 1 + SUM_TOLERANCE, "PREVIOUS_WEIGHT_ABOVE_ONE"),
        ((F.col("state") == "FLAT") & (n["current"] > 0), "FLAT_NOT_EMPTY"),
        (hold & ~known, "HOLD_WITHOUT_PREVIOUS"),
        (hold & known & (n["different"] > 0), "HOLD_CHANGED"),
        (reduce_ & ~known, "REDUCE_WITHOUT_PREVIOUS"),
        (reduce_ & known & (n["added"] > 0), "REDUCE_ADDS_SYMBOL"),
        (reduce_ & known & (n["raised"] > 0), "REDUCE_RAISES_WEIGHT"),
    ).alias("codes"))


def binding_issues(expected: DataFrame, actual: DataFrame, key: str = "run") -> DataFrame:
    """Fields whose expected and actual values differ, per run, in two groups.

    Both sides carry one row per run with the same field columns. A column ``adapter_verified`` of
    ``actual`` adds a code to the runs in which it is not true.
    """
    fields = [c for c in CONTRACT_FIELDS + HASH_FIELDS if c in expected.columns]
    verified = (F.col("adapter_verified") if "adapter_verified" in actual.columns
                else F.lit(True))
    pairs = (expected.select(key, F.struct(*fields).alias("e"))
             .join(actual.select(key, F.struct(*fields).alias("a"), verified.alias("ok")), key,
                   "left"))
    found = F.array_compact(F.array(*[
        F.when(~F.col(f"e.{c}").eqNullSafe(F.col(f"a.{c}")), F.struct(
            F.lit("hash" if c in HASH_FIELDS else "contract").alias("group"),
            F.lit(f"CHAMPION_{c.upper()}_MISMATCH").alias("code"))) for c in fields],
        F.when(~F.coalesce("ok", F.lit(False)), F.struct(
            F.lit("hash").alias("group"), F.lit("ADAPTER_VERIFICATION_FAILED").alias("code")))))
    return pairs.select(key, F.explode(found).alias("i")).select(key, "i.group", "i.code")


def signal_chain_audit(signals: DataFrame, heads: DataFrame) -> DataFrame:
    """Broken links of every signal chain, one row per signal with its codes."""
    earlier = {f"_p_{c}": c for c in ("sequence", "document_hash", "as_of", "generated_at",
                                      "run_id", "signal_id")}
    linked = ordered_scan(signals, ["chain"], ["sequence", "generated_at", "signal_id"],
                          previous=earlier, slice_by=F.floor(F.col("sequence") / SLICE_ROWS))
    joined = linked.join(heads.drop("chain"), "signal_id", "left")
    first = F.col("_p_signal_id").isNull()
    rest = ~first
    stored_hash = F.col("previous_signal_hash")
    later = (~F.col("head_generated_at").eqNullSafe(F.col("generated_at"))
             if "head_generated_at" in heads.columns else F.lit(False))
    return joined.select("chain", "signal_id", "sequence", codes(
        (first & (F.col("sequence") != 1), "FIRST_SEQUENCE_NOT_ONE"),
        (first & stored_hash.isNotNull(), "FIRST_HAS_PREVIOUS_HASH"),
        (rest & (F.col("sequence") != F.col("_p_sequence") + 1), "SEQUENCE_GAP"),
        (rest & ~stored_hash.eqNullSafe(F.col("_p_document_hash")), "PREVIOUS_HASH_MISMATCH"),
        (rest & (F.col("as_of") < F.col("_p_as_of")), "AS_OF_DECREASES"),
        (rest & (F.col("generated_at") <= F.col("_p_generated_at")), "GENERATED_AT_NOT_LATER"),
        (rest & (F.col("run_id") == F.col("_p_run_id")), "RUN_ID_REUSED"),
        (rest & (F.col("signal_id") == F.col("_p_signal_id")), "SIGNAL_ID_REUSED"),
        (~F.col("head_sequence").eqNullSafe(F.col("sequence"))
         | ~F.col("head_as_of").eqNullSafe(F.col("as_of"))
         | ~F.col("head_signal_hash").eqNullSafe(F.col("document_hash")) | later, "HEAD_MISMATCH"),
    ).alias("codes"))
