"""Hard negatives of labelled vectors by a secondary sort."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import stored

_CHUNK = 1 << 21  # scores held at once


def products(a: list[np.ndarray], x: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """Exact inner products of each vector of ``a`` with all of ``x``, some rows at a time."""
    a, x = np.array(a, np.int64), np.array(x, np.int64)
    top = max(abs(int(edge)) for m in (a, x) if m.size for edge in (m.min(), m.max())) if (
        a.size and x.size) else 0
    bound = top * top * a.shape[1]
    kind = np.float64 if bound < 2**53 else np.int64 if bound < 2**63 else object
    a, x = a.astype(kind), x.astype(kind)
    step = max(1, _CHUNK // max(1, len(x)))
    for lo in range(0, len(a), step):
        scores = a[lo:lo + step] @ x.T
        if kind is object:  # beyond a long: the nearest long
            scores = np.clip(scores, 1 - 2**63, 2**63 - 1)
        for i, row in enumerate(scores.astype(np.int64)):
            yield lo + i, row


def by_length(table: pa.Table) -> dict[int, np.ndarray]:
    sizes = np.diff(table["v"].combine_chunks().offsets.to_numpy())
    return {int(n): np.flatnonzero(sizes == n) for n in np.unique(sizes)}


def cells(rows: DataFrame, anchors: DataFrame, counts: tuple[int, int], block_rows: int):
    """Blocks of all rows laid beside blocks of anchors: one bounded cell per pair of blocks."""
    across, down = (max(1, math.ceil(n / block_rows)) for n in counts)

    def dealt(df: DataFrame, own: str, n: int, other: str, m: int) -> DataFrame:
        return df.withColumn(own, F.pmod(F.xxhash64("rid"), F.lit(n)).cast("int")).withColumn(
            other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))

    left = dealt(rows, "block", across, "turn", down)
    right = dealt(anchors, "turn", down, "block", across)
    return left.groupBy("block", "turn").cogroup(right.groupBy("block", "turn"))


def paired(rows: pa.Table, anchors: pa.Table):
    """For each anchor with rows of its vector length: its place, the places of those rows in
    order of id, and their scores."""
    if not rows.num_rows or not anchors.num_rows:
        return
    vectors, asked = rows["v"].to_pandas(), anchors["v"].to_pandas()
    ids, places = rows["id"].to_numpy(), by_length(rows)
    for n, at in by_length(anchors).items():
        if n in places:
            mine = places[n][np.argsort(ids[places[n]], kind="stable")]
            for i, scores in products(list(asked.iloc[at]), list(vectors.iloc[mine])):
                yield at[i], mine, scores


def nearest_positives(k: int):
    """The ``k`` first rows of each anchor's label in a cell: most score, then least id."""
    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        found = {name: [] for name in ("arid", "anchor_id", "id", "score")}
        rid, ids, labels = (rows[c].to_numpy() for c in ("rid", "id", "label"))
        asked = {c: anchors[c].to_numpy() for c in ("rid", "id", "label")}
        for i, mine, scores in paired(rows, anchors):
            same = np.flatnonzero((labels[mine] == asked["label"][i])
                                  & (rid[mine] != asked["rid"][i]))
            if len(same) > k:  # what is below the k-th score goes before sorting
                least = np.partition(scores[same], len(same) - k)[len(same) - k]
                same = same[scores[same] >= least]
            for j in same[np.argsort(-scores[same], kind="stable")][:k].tolist():
                found["arid"].append(int(asked["rid"][i]))
                found["anchor_id"].append(int(asked["id"][i]))
                found["id"].append(int(ids[mine[j]]))
                found["score"].append(int(scores[j]))
        return pa.table({c: pa.array(v, pa.int64()) for c, v in found.items()})
    return run


def within(negative: int, positive: int, low: int, high: int) -> bool:
    return low * positive <= 100 * negative <= high * positive


def window_candidates(k: int, low: int, high: int):
    """Of each anchor's rows of other labels in a cell, the ``k`` first of each positive's window."""
    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        found = {name: [] for name in ("arid", "anchor_id", "id", "score")}
        ids, labels = rows["id"].to_numpy(), rows["label"].to_numpy()
        asked = {c: anchors[c].to_numpy() for c in ("rid", "id", "label")}
        limits = anchors["limits"].to_pylist()
        for i, mine, scores in paired(rows, anchors):
            other = np.flatnonzero(labels[mine] != asked["label"][i])
            other = other[np.argsort(-scores[other], kind="stable")]
            falling, taken = -scores[other], set()
            for p in limits[i]:
                at = int(np.searchsorted(falling, -(high * p // 100)))
                for j in range(at, min(at + k, len(other))):
                    if within(int(-falling[j]), p, low, high):
                        taken.add(j)
            for j in sorted(taken):
                found["arid"].append(int(asked["rid"][i]))
                found["anchor_id"].append(int(asked["id"][i]))
                found["id"].append(int(ids[mine[other[j]]]))
                found["score"].append(int(-falling[j]))
        return pa.table({c: pa.array(v, pa.int64()) for c, v in found.items()})
    return run


def emit(k: int, low: int, high: int):
    """Read pairs in order of anchor, falling score and id; open a window at each positive."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor, open_ = None, []
        for batch in batches:
            out = []
            for arid, anchor_id, negative, score, pid in zip(
                    *[batch[c].to_pylist() for c in ("arid", "anchor_id", "negative", "score",
                                                     "id")], strict=True):
                if arid != anchor:
                    anchor, open_ = arid, []
                if not negative:
                    open_.append([pid, score, 0])
                    continue
                open_ = [w for w in open_ if w[2] < k and low * w[1] <= 100 * score]
                for window in open_:
                    if within(score, window[1], low, high):
                        window[2] += 1
                        out.append((anchor_id, window[0], window[2], pid, window[1], score))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(
                    zip(*out, strict=True) if out else [[]] * 6,
                    [pa.int64(), pa.int64(), pa.int32(), *[pa.int64()] * 3], strict=True)],
                names=_RESULT.fieldNames())
    return run


_RESULT = T.StructType([
    T.StructField("anchor_id", T.LongType()), T.StructField("positive_id", T.LongType()),
    T.StructField("rank", T.IntegerType()), T.StructField("negative_id", T.LongType()),
    T.StructField("positive_score", T.LongType()), T.StructField("negative_score", T.LongType())])
_PAIRS = "arid long, anchor_id long, id long, score long"


def valid_rows(vectors: DataFrame, id_col: str, vector_col: str, label, scale: int) -> DataFrame:
    """``id``, ``label`` and ``v`` (floor of ``scale`` times each component) of rows that count."""
    wide = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    ok = F.forall(F.col(vector_col), lambda x: x.isNotNull() & ~F.isnan(x.cast("double"))
                  & (F.abs(x.cast("double")) < float("inf")))
    return vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & ok).select(
        F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"),
        F.transform(wide, lambda x: F.floor(x * scale)).alias("v")).where("label is not null")


def mine_negatives(vectors: DataFrame, *, anchor=None, positives: int = 5, negatives: int = 5,
                   low: int = 80, high: int = 100, scale: int = 256, block_rows: int = 16_384,
                   id_col: str = "vec_id", vector_col: str = "embedding",
                   label=None) -> DataFrame:
    """For each anchor and each of its ``positives`` nearest rows of its label, the first
    ``negatives`` rows of other labels with ``low * p <= 100 * n <= high * p``.

    Scores are integer inner products of components ``floor(scale * x)``; higher come first, then
    smaller ids. ``anchor`` is a condition on ``id`` (those divisible by 100 by default), ``label``
    an expression (the column ``label``).

    Anchors and rows are laid out as a grid of cells of ``block_rows`` by ``block_rows``. Cells
    first give each anchor's nearest rows of its label, which are merged; a second turn gives, per
    cell and positive, the first rows of its window, which holds all that can come out. These pairs
    are repartitioned by anchor and sorted within partitions by (anchor, falling score, positives
    first, id); an iterator opens a window at each positive and emits negatives as they pass, so no
    anchor's pairs are held. A vector that many rows share is no hot key, since cells are dealt by
    row.

    Rows without id, label or vector, or with a component that is null or not finite, take no part;
    vectors of different lengths have no score together. Repeated rows are rows of their own.
    Scores beyond a long count as the nearest long; a component may have any length of vector.
    An anchor without positives, or without a row in a window, has no rows. Empty tables: none.
    Other columns are not read.
    """
    if high > 100:
        raise ValueError("a window reaches down from its positive: high is 100 at most")
    spark = vectors.sparkSession
    label = F.col("label") if label is None else label
    anchor = F.col("id") % 100 == 0 if anchor is None else anchor
    rows = stored(valid_rows(vectors, id_col, vector_col, label, scale).withColumn(
        "rid", F.monotonically_increasing_id()), "labelled")
    anchors = rows.where(anchor).select(*[F.col(c).alias(c) for c in rows.columns])
    counts = (rows.count(), anchors.count())
    if not counts[1]:
        return spark.createDataFrame([], _RESULT)
    best = Window.partitionBy("arid").orderBy(F.desc("score"), "id")
    near = stored(cells(rows, anchors, counts, block_rows).applyInArrow(
        nearest_positives(positives), _PAIRS).withColumn("at", F.row_number().over(best)).where(
        F.col("at") <= positives).drop("at"), "positives")
    limits = near.groupBy(F.col("arid").alias("rid")).agg(
        F.collect_set("score").alias("limits"))
    found = cells(rows, anchors.join(limits, "rid"), counts, block_rows).applyInArrow(
        window_candidates(negatives, low, high), _PAIRS)
    pairs = near.withColumn("negative", F.lit(False)).union(found.withColumn(
        "negative", F.lit(True)))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return pairs.repartition(parts, "arid").sortWithinPartitions(
        "arid", F.desc("score"), "negative", "id").mapInArrow(
        emit(negatives, low, high), _RESULT)
