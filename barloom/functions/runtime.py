"""Runtime state of a signal run from its health flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def resolve_state(
    execution_data_valid: str = "execution_data_valid",
    previous_target_known: str = "previous_target_known",
    decision_data_valid: str = "decision_data_valid",
    contracts_valid: str = "contracts_valid",
    hashes_valid: str = "hashes_valid",
    champion: str = "champion",
    risk_action: str = "risk_action",
) -> Column:
    """First matching state. An unknown (null) flag is treated as not valid."""
    def ok(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(False))

    blind = ~(ok(execution_data_valid) & ok(previous_target_known))
    doubtful = ~(ok(decision_data_valid) & ok(contracts_valid) & ok(hashes_valid))
    return (
        F.when(blind, "HOLD")
        .when(F.col(risk_action) == "FLAT", "FLAT")
        .when((F.col(champion) == "WITHDRAWN") | (F.col(risk_action) == "REDUCE"), "REDUCE_ONLY")
        .when(doubtful, "HOLD")
        .when(F.col(champion) == "NEVER_ACTIVATED", "FLAT")
        .otherwise("ACTIVE")
    )
