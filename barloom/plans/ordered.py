"""Order-dependent columns for groups that may be far larger than one task.

A window puts a whole group in one task. That is fine where a key bounds the group
(one symbol has one row per session) and wrong where it does not: one account,
chain or request key may hold a third of a table. ``ordered_scan`` cuts every group into
slices along its order, by a column of the data (a month, a block of sequence numbers):

1. pre-aggregate every (keys, slice) to one row, on the map side, and carry the running state
   over the slices of a key; a key has as many such rows as slices;
2. lay each slice's carried state before its rows, as one row more, and compute the columns by
   one window over (keys, slice), which then begins with the state so far.

No row meets another by a join. There is one plan at every size, no job runs while it is built and
nothing is stored.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_RUNNING = {"sum": F.sum, "min": F.min, "max": F.max, "min_before": F.min}


def ordered_scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    *,
    slice_by: Column,
    number: str | None = None,
    running: Mapping[str, tuple[str, str]] | None = None,
    previous: Mapping[str, str] | None = None,
) -> DataFrame:
    """Add row number, running aggregates and previous-row values to each group.

    ``order`` must order a group totally and ``slice_by`` must not decrease along it; it should
    keep a slice of a group within one task. ``running`` maps a new column to ``(kind, column)``
    with kind sum, min or max over the rows so far, or min_before over the rows before;
    ``previous`` maps a new column to the column to take from the row before.
    """
    running = dict(running or {})
    previous = dict(previous or {})
    keys, order = list(keys), list(order)
    sliced = df.withColumn("_scan_slice", slice_by)
    last = F.struct(F.lit(0).alias("_"), *[F.col(c).alias(n) for n, c in previous.items()])
    totals = sliced.groupBy(*keys, "_scan_slice").agg(
        F.count("*").alias("_scan_rows"),
        F.max_by(last, F.struct(*order)).alias("_scan_last"),
        *[_RUNNING[kind](column).alias(f"_scan_{name}")
          for name, (kind, column) in running.items()])
    along = Window.partitionBy(*keys).orderBy("_scan_slice")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(
        *keys, "_scan_slice", F.sum("_scan_rows").over(before).alias("_scan_rows"),
        F.lag("_scan_last").over(along).alias("_scan_last"),
        *[_RUNNING[kind](f"_scan_{name}").over(before).alias(f"_scan_{name}")
          for name, (kind, _) in running.items()]).where("_scan_rows is not null")
    kinds = {f.name: f.dataType for f in carry.schema.fields}
    made = {"_scan_rows": F.lit(1), "_scan_last": last,
            **{f"_scan_{name}": F.col(column) for name, (_, column) in running.items()}}
    rows = sliced.select("*", F.lit(True).alias("_scan_own"),
                         *[c.cast(kinds[n]).alias(n) for n, c in made.items()])
    both = rows.unionByName(carry.withColumn("_scan_own", F.lit(False)), allowMissingColumns=True)
    window = Window.partitionBy(*keys, "_scan_slice").orderBy("_scan_own", *order)
    so_far = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = window.rowsBetween(Window.unboundedPreceding, -1)
    out = []
    if number:
        out.append(F.sum("_scan_rows").over(so_far).alias(number))
    for name, (kind, _) in running.items():
        over = earlier if kind == "min_before" else so_far
        out.append(_RUNNING[kind](f"_scan_{name}").over(over).cast(kinds[f"_scan_{name}"])
                   .alias(name))
    lagged = F.lag("_scan_last").over(window)
    out.extend(lagged[name].alias(name) for name in previous)
    return both.select(*df.columns, "_scan_own", *out).where("_scan_own").drop("_scan_own")
