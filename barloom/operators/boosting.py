"""Least-squares boosting of trees on binned features, for all labels of a table at once.

Spark's own boosted trees run some jobs per level, round and label, whose lineage grows with the
rounds. Here the rows lie in blocks, one per task; a job adds up the histograms (label, node,
feature, bin) of one level of a round for every label, so a round has as many jobs as levels. Only
histograms and trees pass the driver. Scores so far are taken from the labels in the blocks every
few rounds.

Of two sister nodes only the smaller one is counted, the other is what is left of their parent; and
features are counted by pairs, whose histogram holds those of both.

Residuals are summed as integers, so neither the order of rows nor their tasks can change a tree,
and what is left of a parent is exact.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame

# Rounds between two states of the blocks; a residual is cut into two integers of
# so many bits; tasks whose histograms the driver adds up by itself; bins up to which two features
# are counted at once.
CARRY, BITS, FEW_TASKS, PAIR_BINS = 2, 30, 64, 64


@dataclass
class Tree:
    """Arrays by node (root 1, children 2n and 2n + 1): ``feature`` (-1: leaf), ``cut`` (the last
    bin that goes left), ``value`` of leaves and ``gain`` of splits."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    gain: np.ndarray


Block = tuple[np.ndarray, np.ndarray]  # bins by feature; labels less scores so far by label


def _encoded(batches: Iterator[pa.RecordBatch], features: int) -> Iterator[pa.RecordBatch]:
    held = [pa.Table.from_batches([b]) for b in batches if b.num_rows]
    if held:
        columns = [c.to_numpy() for c in pa.concat_tables(held).itercolumns()]
        bins = np.stack(columns[:features]).astype("<u2")
        labels = np.stack(columns[features:]).astype("<f8")  # null: nan
        yield pa.RecordBatch.from_arrays([
            pa.array([bins.tobytes()], pa.binary()), pa.array([labels.tobytes()], pa.binary())],
            ["bins", "labels"])


def _decoded(row, features: int, labels: int, n_bins: int) -> Block:
    bins = np.frombuffer(row.bins, "<u2").reshape(features, -1)
    return (bins.astype(np.uint8 if n_bins <= 256 else np.uint16),
            np.frombuffer(row.labels, "<f8").reshape(labels, -1))


def nodes_of(bins: np.ndarray, tree: Tree, levels: int) -> np.ndarray:
    """The node each row has come to after ``levels`` levels; ``bins`` is by feature."""
    kind = np.uint8 if levels < 8 else np.uint16 if levels < 16 else np.int64
    node = np.ones(bins.shape[1], kind)
    # Plain integers, so that the comparisons stay in the type of the bins.
    splits = zip(tree.feature.tolist(), tree.cut.tolist())
    for at, (feature, cut) in enumerate(list(splits)[:1 << levels]):
        if feature >= 0:  # its rows go from ``at`` to 2 * at or one more
            step = (bins[feature] > cut).view(np.uint8) + kind(at)
            step *= node == at
            node += step
    return node


def _advanced(block: Block, rounds: Sequence[Sequence[tuple[float, Tree]]], depth: int) -> Block:
    if not rounds:
        return block
    bins, left = block[0], block[1].copy()
    for trees in rounds:
        for h, (weight, tree) in enumerate(trees):
            left[h] -= (weight * tree.value)[nodes_of(bins, tree, depth)]
    return bins, left


def _histograms(block: Block, rounds: Sequence, now: Sequence[Tree], asked: Sequence[Sequence[int]],
                level: int, depth: int, first: bool, unit: float, n_bins: int) -> np.ndarray:
    """Rows and both parts of the residuals by (label, asked node of the level, feature, bin)."""
    bins, left = _advanced(block, rounds, depth)
    slots, width = max(map(len, asked)), 2 if n_bins <= PAIR_BINS else 1
    out = np.zeros((len(left), 3, slots, len(bins), n_bins), np.int64)
    keys = []
    for i in range(0, len(bins), width):
        key = bins[i].astype(np.uint16)
        if i + 1 < min(len(bins), i + width):
            key *= np.uint16(n_bins)
            key += bins[i + 1]
        keys.append((i, n_bins ** len(bins[i:i + width]), key))
    for h, tree in enumerate(now):
        used, slot = ~np.isnan(left[h]), None
        if level:
            place = np.full(2 << level, slots, np.uint8 if slots < 256 else np.int64)
            place[list(asked[h])] = np.arange(len(asked[h]))
            slot = place[nodes_of(bins, tree, level)]
            used &= slot < slots
        used = slice(None) if used.all() else np.flatnonzero(used)
        residual = left[h][used] * (unit if first else 2 * unit)
        high = np.rint(residual)
        low = np.rint((residual - high) * 2.0 ** BITS)
        slot = None if slot is None else slot[used].astype(np.int64)
        for i, cells, key in keys:
            key = key[used].astype(np.int64)
            if slot is not None:
                key += slot * cells
            for k, w in enumerate((None, high, low)):
                if k or level or first:  # the rows of a root are those of the first round
                    sums = np.bincount(key, w, slots * cells).astype(np.int64)
                    if cells > n_bins:
                        sums = sums.reshape(slots, n_bins, n_bins)
                        out[h, k, :, i], out[h, k, :, i + 1] = sums.sum(2), sums.sum(1)
                    else:
                        out[h, k, :, i] = sums.reshape(slots, n_bins)
    return out


def _summed(histograms: RDD) -> np.ndarray:
    if histograms.getNumPartitions() > FEW_TASKS:
        return histograms.treeReduce(np.add, 2)
    return histograms.reduce(np.add)


def _split(tree: Tree, held: dict[int, np.ndarray], unit: float, least: int
           ) -> tuple[list[int], dict[int, np.ndarray]]:
    """Split the nodes ``held`` (rows and both parts of the residuals by feature and bin) at the
    largest gain, ties to the first feature and bin; give leaves their mean.

    Returns the smaller child of each node that was split, and what is held of these nodes.
    """
    def real(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return a.astype(float) / unit + b.astype(float) / (unit * 2.0 ** BITS)

    smaller, parents = [], {}
    for at, histogram in held.items():
        left_n, highs, lows = np.cumsum(histogram, axis=-1)
        n, high, low = left_n[0, -1], highs[0, -1], lows[0, -1]
        if not n:
            continue
        total, right_n = real(high, low), n - left_n
        left, right = real(highs, lows), real(high - highs, low - lows)
        tree.value[at] = total / n
        fits = (left_n >= max(least, 1)) & (right_n >= max(least, 1))
        with np.errstate(divide="ignore", invalid="ignore"):
            score = np.where(fits, left * left / left_n + right * right / right_n, -np.inf)
        feature, cut = np.unravel_index(np.argmax(score), score.shape)
        gain = score[feature, cut] - total * total / n
        if gain > 0:
            tree.feature[at], tree.cut[at], tree.gain[at], tree.value[at] = feature, cut, gain, 0.0
            tree.value[2 * at] = left[feature, cut] / left_n[feature, cut]
            tree.value[2 * at + 1] = right[feature, cut] / right_n[feature, cut]
            smaller.append(2 * at + int(right_n[feature, cut] < left_n[feature, cut]))
            parents[at] = histogram
    return smaller, parents


def boost(rows: DataFrame, labels: int, largest: float, *, n_bins: int, maxIter: int,
          stepSize: float, maxDepth: int, minInstancesPerNode: int) -> list[list[Tree]]:
    """For each label the trees of all rounds; the first counts once, the others ``stepSize``.

    ``rows`` holds bin numbers below ``n_bins`` (smallint) and then ``labels`` labels (double, null
    where a row has none, at most ``largest`` in size), in partitions that fit a task.
    """
    features = len(rows.columns) - labels
    unit = 2.0 ** (BITS - np.ceil(np.log2(4 * largest)) if largest > 0 else BITS)
    blocks = rows.mapInArrow(partial(_encoded, features=features), "bins binary, labels binary").rdd
    blocks = blocks.map(partial(_decoded, features=features, labels=labels, n_bins=n_bins)).persist(
        StorageLevel.MEMORY_AND_DISK)
    before, done, pending, rows_in = None, [], [], None
    try:
        for number in range(maxIter):
            size = 1 << (maxDepth + 1)
            now = [Tree(np.full(size, -1, np.int16), np.zeros(size, np.int16), np.zeros(size),
                        np.zeros(size)) for _ in range(labels)]
            asked, parents = [[1] for _ in now], [{} for _ in now]
            for level in range(max(maxDepth, 1)):
                found = _summed(blocks.map(partial(
                    _histograms, rounds=pending, now=now, asked=asked, level=level, depth=maxDepth,
                    first=number == 0, unit=unit, n_bins=n_bins)))
                if before is not None:  # the new state is in place
                    before = before.unpersist() and None
                if level == 0:
                    rows_in = found[:, 0].copy() if number == 0 else rows_in
                    found[:, 0] = rows_in
                if maxDepth == 0:
                    for tree, (n, high, low) in zip(now, found[:, :, 0, 0].sum(axis=-1)):
                        tree.value[1] = (high / unit + low / (unit * 2.0 ** BITS)) / n
                    break
                for h, tree in enumerate(now):
                    held = {at: found[h, :, k] for k, at in enumerate(asked[h])}
                    if level:
                        held |= {at ^ 1: parents[h][at // 2] - own for at, own in held.items()}
                    asked[h], parents[h] = _split(tree, held, unit, minInstancesPerNode)
                if not any(asked):
                    break
            done.append(now)
            pending.append([(stepSize if number else 1.0, t) for t in now])
            if len(pending) == CARRY and number + 1 < maxIter:
                before, blocks = blocks, blocks.map(partial(
                    _advanced, rounds=pending, depth=maxDepth)).persist(StorageLevel.MEMORY_AND_DISK)
                pending = []
        return [list(trees) for trees in zip(*done)]
    finally:
        for state in (before, blocks):
            if state is not None:
                state.unpersist()
