"""Mixing of sources to token targets by entropy balancing, with built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import stored

#: A cell (source, size) is dealt to so many buckets, so that no cell is ranked in one task.
BUCKETS = 64


def words_in(text: Column) -> Column:
    """The number of runs of bytes outside space and U+0009 to U+000D."""
    return F.when(text.isNull(), F.lit(0)).otherwise(
        F.size(F.regexp_extract_all(text, F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0)))).cast("long")


def source_targets(cells: DataFrame, weights: tuple[float, ...], most: float) -> DataFrame:
    """One row per source ``s``: ``source_size``, ``target`` and the bracket of its multiplier.

    ``s`` is (is null, name): ordered by code point, nulls last. Filling to a common level of
    target per weight, below the caps, is what resharing the excess until none is left ends in.
    The windows without keys run over one row per source.
    """
    by_name = Window.orderBy("s")
    sources = cells.groupBy("s").agg(
        F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("docs"),
        F.min(F.when(F.col("size") > 0, F.col("size"))).alias("least"))
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    sources = sources.withColumn("weight", F.element_at(
        F.array(*map(F.lit, map(float, weights))), (turn + 1).cast("int")))
    cap = F.col("source_size") * F.lit(float(most))
    sources = sources.withColumn("cap", cap).withColumn("ratio", F.col("cap") / F.col("weight"))
    order = Window.orderBy("ratio", "s")
    every = Window.partitionBy()
    level = (F.sum("source_size").over(every) - F.coalesce(
        F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))) / F.sum(
        "weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    sources = sources.withColumn("level", level)
    fits = F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "s", "level"))
    sources = sources.withColumn("level", F.min(fits).over(every)["level"])
    sources = sources.withColumn(
        "target", F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), "cap")))
    mean = F.col("source_size") / F.col("docs")
    share = F.log(F.col("target") / F.col("source_size")) * mean / F.col("least")
    return sources.select(
        "s", "source_size", "target", mean.alias("mean"),
        F.when(F.col("target") < F.col("source_size"), share).otherwise(0.0).alias("lo"),
        F.when(F.col("target") < F.col("source_size"), 0.0).otherwise(
            F.log(F.lit(float(most))) * mean / F.col("least")).alias("hi"),
        F.lit(0.0).alias("tilt"),
        (F.col("target") >= F.col("cap") * (1 - 1e-12)).alias("full"))


def rate(most: float) -> Column:
    """Copies wanted of a document: exponential in its tokens, at most ``most``."""
    return F.when(F.col("full"), F.lit(float(most))).otherwise(F.least(
        F.lit(float(most)), F.exp(F.col("tilt") * F.col("size") / F.col("mean"))))


def balanced(cells: DataFrame, sources: DataFrame, most: float, tolerance: float,
             rounds: int) -> DataFrame:
    """``sources`` with the multiplier ``tilt`` at which each source's tokens meet its target.

    Each round is one Newton step of the convex dual: a map-side aggregate of the gradient and the
    second derivative over all cells. A step that leaves the bracket of the root is replaced by
    the bracket's middle. The state, one row per source, is written each round.
    """
    state = stored(sources, "mix-state")
    for _ in range(rounds):
        tilted = rate(most)
        free = ~F.col("full") & (tilted < most)
        sums = cells.join(state, "s").groupBy("s").agg(
            F.sum(F.col("n") * F.col("size") * tilted).alias("tokens"),
            F.sum(F.when(free, F.col("n") * F.col("size") * F.col("size") / F.col("mean")
                         * tilted)).alias("slope"))
        gap = F.col("tokens") - F.col("target")
        met = F.col("full") | (F.abs(gap) <= F.col("target") * tolerance) | (
            F.col("target") <= 0)
        lo = F.when(gap < 0, F.col("tilt")).otherwise(F.col("lo"))
        hi = F.when(gap > 0, F.col("tilt")).otherwise(F.col("hi"))
        newton = F.col("tilt") - gap / F.col("slope")
        inside = F.coalesce((newton > lo) & (newton < hi), F.lit(False))
        step = F.when(met, F.col("tilt")).when(inside, newton).otherwise((lo + hi) / 2)
        state = stored(state.join(sums, "s").select(
            "s", "source_size", "target", "mean", lo.alias("lo"), hi.alias("hi"),
            step.alias("tilt"), "full", met.alias("met")), "mix-state")
        if state.where("not met").isEmpty():
            break
    return state


def copies_of_cells(cells: DataFrame, state: DataFrame, most: int, mends: int) -> DataFrame:
    """Whole copies ``k`` of each cell's documents, whose tokens add up close to the target.

    Systematic rounding along ascending sizes; then up to ``mends`` times each source gives or
    takes the one copy that comes nearest to what is still missing.
    """
    order = Window.partitionBy("s").orderBy("size").rowsBetween(Window.unboundedPreceding, 0)
    ends = cells.join(state, "s").withColumn("wanted", F.col("n") * rate(most)).withColumn(
        "end", F.sum("wanted").over(order))
    whole = F.floor(F.col("end") + 0.5) - F.floor(F.col("end") - F.col("wanted") + 0.5)
    ends = ends.withColumn("k", F.greatest(F.lit(0), F.least(whole, F.col("n") * most)))
    ends = stored(ends.select("s", "size", "n", "source_size", "target",
                              F.col("k").cast("long").alias("k")), "mix-cells")
    for _ in range(mends):
        missing = ends.groupBy("s").agg(
            (F.first("target") - F.sum(F.col("k") * F.col("size"))).alias("missing"))
        able = F.when(F.col("missing") > 0, F.col("k") < F.col("n") * most).otherwise(
            F.col("k") > 0) & (F.col("size") > 0) & (F.col("size") < 2 * F.abs("missing"))
        best = ends.join(missing, "s").where(able).groupBy("s", "missing").agg(
            F.min(F.struct(F.abs(F.col("size") - F.abs("missing")).alias("off"), "size"))["size"]
            .alias("size"))
        step = best.select("s", "size", F.signum("missing").cast("long").alias("step"))
        ends = stored(ends.join(step, ["s", "size"], "left").select(
            "s", "size", "n", "source_size", "target",
            (F.col("k") + F.coalesce("step", F.lit(0))).alias("k")), "mix-cells")
    return ends


def mix_sources(docs: DataFrame, *, weights: tuple[float, ...] = (1.0, 2.0, 3.0), most: int = 3,
                id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                tolerance: float = 1e-9, rounds: int = 60, mends: int = 3,
                prefix: str = "mix_") -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target``, ``taken`` and ``copies``, each name
    after ``prefix``.

    A document's size is its number of words (null text: 0). Sources, by code point and null last,
    carry ``weights`` in turn and share all sizes; no target is above ``most`` times its source's
    size. Rates minimise the relative entropy to one copy each under the token constraints; copies
    are whole and at most ``most``. All documents of one source and size have one rate, so the
    dual is solved on the table of (source, size), and a cell's odd copies go to the documents of
    lowest id hash. Reruns agree; rows equal in id may swap copies. Documents of size 0 have one
    copy. Repeated rows count each. Other columns are kept; an empty table gives no rows.
    """
    s = F.struct(docs[source_col].isNull().alias("none"),
                 F.coalesce(docs[source_col].cast("string"), F.lit("")).alias("name"))
    rows = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("doc"), docs[id_col].alias("id"),
        s.alias("s"), words_in(docs[text_col]).alias("size"),
        F.pmod(F.xxhash64(docs[id_col]), F.lit(BUCKETS)).alias("bucket"))
    buckets = stored(rows.groupBy("s", "size", "bucket").agg(F.count("*").alias("n")), "mix-size")
    cells = buckets.groupBy("s", "size").agg(F.sum("n").alias("n"))
    cells = stored(cells, "mix-cells")
    state = balanced(cells, source_targets(cells, weights, most), most, tolerance, rounds)
    cells = copies_of_cells(cells, state, most, mends)
    order = Window.partitionBy("s", "size").orderBy("bucket").rowsBetween(
        Window.unboundedPreceding, 0)
    each = F.floor(F.col("k") / F.col("n"))
    quotas = buckets.withColumnRenamed("n", "own").join(cells, ["s", "size"]).withColumn(
        "each", each).withColumn("odd", F.col("k") - F.col("each") * F.col("n")).withColumn(
        "end", F.sum("own").over(order))
    to = F.floor(F.col("end") * F.col("odd") / F.col("n"))
    before = F.floor((F.col("end") - F.col("own")) * F.col("odd") / F.col("n"))
    quotas = quotas.select("s", "size", "bucket", "source_size", "target", "each",
                           (to - before).alias("odd"))
    rank = F.row_number().over(Window.partitionBy("s", "size", "bucket").orderBy(
        F.xxhash64("id", F.lit(1)), "id"))
    rows = rows.join(quotas, ["s", "size", "bucket"]).withColumn("rank", rank)
    copies = (F.col("each") + (F.col("rank") <= F.col("odd")).cast("long")).cast("long")
    return rows.select(
        "doc.*", F.col("size").alias(prefix + "size"),
        F.col("source_size").alias(prefix + "source_size"),
        F.col("target").alias(prefix + "target"),
        (copies * F.col("size")).alias(prefix + "taken"), copies.alias(prefix + "copies"))
