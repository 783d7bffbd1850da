"""Vendor responses ``{fields, items}`` read by field name."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def envelope_findings(envelopes: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Envelopes whose field set or row width is wrong, with codes."""
    want = F.array(*[F.lit(f) for f in fields])
    have = F.col("fields")
    code = F.array_compact(F.array(
        F.when(F.size(have) != F.size(F.array_distinct(have)), "DUPLICATE_FIELDS"),
        F.when(F.size(F.array_except(want, have)) > 0, "MISSING_FIELDS"),
        F.when(F.size(F.array_except(have, want)) > 0, "EXTRA_FIELDS"),
        F.when(F.exists("items", lambda r: F.size(r) != F.size(have)), "ROW_WIDTH")))
    return envelopes.select("sequence", F.explode(code).alias("code"))


def scan_raw_envelopes(envelopes: DataFrame, fields: Sequence[str]) -> DataFrame:
    """One row per item with the requested fields as text columns, in request order.

    The order of the fields and the split into pages do not matter. An envelope with the
    wrong field set or a row of the wrong width yields no rows here; see
    ``envelope_findings``.
    """
    want = F.array(*[F.lit(f) for f in fields])
    have = F.col("fields")
    good = ((F.size(have) == len(fields)) & (F.size(F.array_except(want, have)) == 0)
            & ~F.exists("items", lambda r: F.size(r) != len(fields)))
    rows = envelopes.where(good).select("sequence", "fields", F.posexplode("items").alias("n", "r"))
    return rows.select("sequence", F.col("n").cast("int").alias("row_number"),
                       *[F.get("r", F.array_position("fields", f) - 1).alias(f) for f in fields])
