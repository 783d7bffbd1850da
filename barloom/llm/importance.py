"""Importance resampling towards a target distribution, with features counted once per line."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import stored
from .tokens import LOWER, bounds, crc32
from .words import slices, utf8

HOT_SHARE = 1000  # a line is hot from this part of all lines on, so at most as many are


def features(data: np.ndarray, offsets: np.ndarray, order: int, buckets: int, crossing: bool):
    """Buckets of all runs of 1 to ``order`` words of each row, where each row's begin, and words.

    With ``crossing`` only runs that hold a newline between their words; else rows are taken whole.
    """
    starts, ends, begins = bounds(data, offsets)
    lower, space = LOWER[data], np.frombuffer(b" ", np.uint8)
    last = np.repeat(begins[1:], np.diff(begins))
    line = np.cumsum(data == 10)[starts] if len(starts) else starts
    found, at = [], []
    crc, here = crc32(lower, starts, ends), np.arange(len(starts))
    for k in range(1, order + 1):
        if k > 1:
            keep = here + k - 1 < last[here]
            here, crc = here[keep], crc[keep]
            gap = np.zeros(len(here), np.int64)
            crc = crc32(space, gap, gap + 1, crc)
            crc = crc32(lower, starts[here + k - 1], ends[here + k - 1], crc)
        pick = line[here] != line[here + k - 1] if crossing else slice(None)
        found.append((crc % np.uint32(buckets)).astype(np.int32)[pick])
        at.append(here[pick])
    at, found = np.concatenate(at), np.concatenate(found)
    turn = np.argsort(at, kind="stable")
    return found[turn], np.searchsorted(at[turn], begins), np.diff(begins)


def bucketed(texts: DataFrame, text_col: str, order: int, buckets: int,
             crossing: bool = False) -> DataFrame:
    """``texts`` with ``n_words`` and the feature ``buckets`` of each row in place of its text."""
    kept = [f for f in texts.schema.fields if f.name != text_col]
    schema = T.StructType([*kept, T.StructField("n_words", T.LongType()),
                           T.StructField("buckets", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch[text_col])
            for a, b in slices(offsets):
                found, begins, words = features(
                    data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], order, buckets,
                    crossing)
                yield pa.RecordBatch.from_arrays(
                    [*[batch[f.name].slice(a, b - a) for f in kept], pa.array(words),
                     pa.ListArray.from_arrays(pa.array(begins, pa.int32()), pa.array(found))],
                    names=schema.fieldNames())

    return texts.mapInArrow(run, schema)


def counted(rows: DataFrame, times: str, size: int) -> DataFrame:
    """``bucket`` and ``n``: how often the features of ``rows`` fall there, each row ``times``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            lists = batch["buckets"]
            weights = np.repeat(batch[times].to_numpy(), np.diff(lists.offsets.to_numpy()))
            np.add.at(total, lists.flatten().to_numpy(), weights)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])],
                                         names=["bucket", "n"])

    return rows.select(times, "buckets").mapInArrow(run, "bucket long, n long").groupBy(
        "bucket").agg(F.sum("n").alias("n"))


def weighed(rows: DataFrame, gains: np.ndarray) -> DataFrame:
    """``rows`` with ``n_features`` and ``weight`` (the sum of gains) in place of its buckets."""
    kept = [f for f in rows.schema.fields if f.name != "buckets"]
    schema = T.StructType([*kept, T.StructField("n_features", T.LongType()),
                           T.StructField("weight", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begins = batch["buckets"].offsets.to_numpy()
            sums = np.concatenate([[0], np.cumsum(
                gains[batch["buckets"].flatten().to_numpy()])]).astype(np.int64)
            begins = begins - begins[0]
            yield pa.RecordBatch.from_arrays(
                [*[batch[f.name] for f in kept], pa.array(np.diff(begins).astype(np.int64)),
                 pa.array(np.diff(sums[begins]))], names=schema.fieldNames())

    return rows.mapInArrow(run, schema)


def line_keys(line) -> list:
    """A line's 128-bit key: two hashes from different seeds."""
    return [F.xxhash64(line).alias("k1"), F.xxhash64(F.lit(1), line).alias("k2")]


def bucket_gains(corpus: DataFrame, target: DataFrame, size: int) -> np.ndarray:
    """floor(1000 * ln(...)) of the smoothed share of each bucket in ``target`` to ``corpus``."""
    spark = corpus.sparkSession
    s, t = (df.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] for df in (corpus, target))
    ratio = ((F.coalesce("t", F.lit(0)) + 1) * F.lit(float(s + size))
             / ((F.coalesce("s", F.lit(0)) + 1) * F.lit(float(t + size))))
    table = spark.range(size).withColumnRenamed("id", "bucket").join(
        corpus.withColumnRenamed("n", "s"), "bucket", "left").join(
        target.withColumnRenamed("n", "t"), "bucket", "left").select(
        "bucket", F.floor(1000 * F.log(ratio)).alias("gain"))
    gains = np.zeros(size, np.int64)
    for bucket, gain in table.collect():  # one row per bucket
        gains[bucket] = gain
    return gains


def resample(docs: DataFrame, target: DataFrame, *, order: int = 1, size: int = 10_000,
             seed: int = 2024, percent: int = 10, least_words: int = 20, id_col: str = "doc_id",
             text_col: str = "text", target_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_features``, ``n_words``, ``weight``, ``score`` and ``rank`` of every row.

    Features are runs of 1 to ``order`` words, hashed by CRC-32 into ``size`` buckets. A row's
    weight is the sum of its features' gains, a gain the log of the target's share of a bucket over
    the corpus's, in thousandths. Gumbel noise of the hashed id is added, and of the rows with at
    least ``least_words`` words the ``percent`` highest scores are drawn; ``rank`` is null for the
    others. That draws without replacement in proportion to the importance weights.

    Newlines separate words, so a run either lies in one line or crosses lines. Distinct lines are
    found first; each is cut into words once, its counts are multiplied by its occurrences, and its
    weight is joined to the documents that hold it. Runs across lines (``order`` above 1) are
    counted per document and added. Lines with a thousandth of all occurrences or more, a thousand
    at most, are looked up in a broadcast table, so a line that stands everywhere is no hot key.
    Ranks are given by range of score, with the counts of the ranges before.

    Null texts and texts without words have no features, weight 0 and their noise as score. Ties
    go to the smaller id, null ids last (their noise is that of the empty string). Repeated rows
    are counted, scored and ranked each. Texts of any length are read whole. Empty tables: no rows,
    or a target without features (all gains follow the corpus alone). Other columns are not read.
    """
    spark = docs.sparkSession
    docs = docs.select(docs[id_col].alias("doc_id"),
                       F.coalesce(docs[text_col], F.lit("")).alias("text"))
    every = docs.select(F.explode(F.split("text", "\n", -1)).alias("line"))
    lines = every.groupBy("line").agg(F.count("*").alias("times")).select(
        *line_keys(F.col("line")), "times", "line")
    lines = stored(bucketed(lines, "line", order, size), "feature-lines")
    marked = docs.withColumn("t", F.xxhash64("text"))
    corpus = counted(lines, "times", size)
    if order > 1:
        crossing = bucketed(marked.withColumn("times", F.lit(1).cast("long")), "text", order, size,
                            crossing=True)
        crossing = stored(crossing.where(F.size("buckets") > 0), "crossing-features")
        corpus = corpus.union(counted(crossing, "times", size)).groupBy("bucket").agg(
            F.sum("n").alias("n"))
    wanted = target.select(F.lit(1).cast("long").alias("times"), target[target_col].alias("text"))
    gains = bucket_gains(stored(corpus, "corpus-counts"), stored(counted(
        bucketed(wanted, "text", order, size), "times", size), "target-counts"), size)

    lines = weighed(lines, gains)
    total = lines.agg(F.coalesce(F.sum("times"), F.lit(0))).first()[0]
    facts = F.struct("n_words", "n_features", "weight")
    hot = F.broadcast(lines.where(F.col("times") * HOT_SHARE >= total).select(
        F.col("k1").alias("h1"), F.col("k2").alias("h2"), facts.alias("hot")))
    held = marked.select("doc_id", "t", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    held = held.withColumns(dict(zip(("k1", "k2"), line_keys(F.col("line")), strict=True)))
    held = held.join(hot, (F.col("k1") == F.col("h1")) & (F.col("k2") == F.col("h2")), "left")
    alone = F.when(F.col("hot").isNull(), F.col("k1")).otherwise(F.xxhash64("doc_id", "t", "pos"))
    found = held.select(
        "doc_id", "t", (F.col("pos") == 0).cast("long").alias("first"), alone.alias("k1"), "k2",
        "hot").join(lines.select("k1", "k2", facts.alias("facts")), ["k1", "k2"], "left").select(
        "doc_id", "t", "first", F.coalesce("hot", "facts").alias("facts"))
    if order > 1:
        extra = weighed(crossing.withColumn("n_words", F.lit(0).cast("long")), gains)
        found = found.union(extra.select("doc_id", "t", F.lit(0).cast("long"), facts))
    found = found.groupBy("doc_id", "t").agg(  # equal rows add up, "first" counts them
        F.sum("first").alias("first"), *[F.sum(f"facts.{c}").alias(c)
                                         for c in ("n_words", "n_features", "weight")])

    noise = F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    uniform = (F.conv(F.substring(F.sha2(noise, 256), 1, 8), 16, 10).cast("long") + 0.5) / 2.0**32
    scored = found.select(
        "doc_id", "t", F.col("first").alias("rows"),
        *[F.expr(f"{c} div first").alias(c) for c in ("n_words", "n_features", "weight")])
    scored = scored.withColumn(
        "score", F.col("weight") + F.floor(-1000 * F.log(-F.log(uniform))))
    scored = stored(scored, "scored")
    fit = F.col("n_words") >= least_words
    eligible = scored.where(fit).agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    keys = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("t")]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = stored(scored.where(fit).repartitionByRange(parts, *keys).withColumn(
        "range", F.spark_partition_id()), "ranged")
    before = F.broadcast(ranged.groupBy("range").agg(F.sum("rows").alias("n")).select(  # one each
        "range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("before")))
    running = F.sum("rows").over(Window.partitionBy("range").orderBy(*keys).rowsBetween(
        Window.unboundedPreceding, 0)) - F.col("rows")
    ranked = ranged.join(before, "range").withColumn("before", F.col("before") + running)
    ranked = ranked.select(*scored.columns, "before").union(scored.where(~fit).withColumn(
        "before", F.lit(None).cast("long")))
    rank = F.col("before") + F.col("copy")
    return ranked.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "rows"))).select(
        "doc_id", "n_features", "n_words", "weight", "score",
        F.when(rank <= percent * eligible // 100, rank).alias("rank"))
