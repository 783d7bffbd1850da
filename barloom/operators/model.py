"""Walk-forward split, training data, boosted trees per horizon, and leak checks."""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import fresh_path, stored
from .boosting import Tree, boost, nodes_of
from .calendars import calendar_index, sessions, small
from .features import (
    DEFAULT_HORIZONS, FEATURE_NAMES, feature_panel, mask_labels, panel_difference,
    panel_with_labels,
)

# Split points, minimum sizes and model settings.
TRAIN_SHARE, VALIDATION_SHARE = 0.60, 0.78
MIN_SESSIONS = 40
MIN_TRAINING_ROWS = 20
VALIDATION_HORIZON = 5
MODEL_SETTINGS = {"maxIter": 120, "stepSize": 0.05, "maxDepth": 3, "minInstancesPerNode": 30}
BINS, BIN_SAMPLE = 32, 10_000
ROWS_PER_TASK = 250_000  # of a boosting round


def session_splits(index: DataFrame) -> DataFrame:
    """Every session with its part: train, validation or test. ``index`` is the calendar."""
    n = F.count("*").over(Window.partitionBy(F.lit(0)))
    train = F.floor(n * F.lit(TRAIN_SHARE))
    validation = F.floor(n * F.lit(VALIDATION_SHARE))
    enough = F.when(n < MIN_SESSIONS, F.raise_error(F.lit(
        f"a walk-forward split needs at least {MIN_SESSIONS} sessions")).cast("string"))
    part = enough.when(F.col("idx") < train, "train").when(
        F.col("idx") < validation, "validation").otherwise("test")
    return index.select("trade_date", "idx", part.alias("part"))


def walk_forward_split(index: DataFrame) -> DataFrame:
    """One row: the four boundary dates of the split."""
    def edge(fn, part: str) -> Column:
        return fn(F.when(F.col("part") == part, F.col("trade_date")))

    return session_splits(index).agg(
        edge(F.max, "train").alias("train_end"),
        edge(F.min, "validation").alias("validation_start"),
        edge(F.max, "validation").alias("validation_end"),
        edge(F.min, "test").alias("test_start"))


def production_cutoff(index: DataFrame, horizons: Sequence[int] = DEFAULT_HORIZONS) -> DataFrame:
    """One row: the latest session whose longest label is inside the data."""
    last = F.max("idx").over(Window.partitionBy(F.lit(0)))
    return (index.select("trade_date", (last - F.col("idx")).alias("_left"))
            .where(F.col("_left") == max(horizons)).select("trade_date"))


def training_matrix(bars: DataFrame, index: DataFrame, cutoff,
                    horizons: Sequence[int] = DEFAULT_HORIZONS) -> DataFrame:
    """Features and one safe label per horizon for every row up to the cutoff.

    Features and labels come from the same windows, so the panel is shuffled once. A label
    is null unless both clocks hold: the calendar (position + horizon) and the symbol's own
    label end.
    """
    cut = F.lit(str(cutoff)).cast("date")
    panel = panel_with_labels(bars, horizons).where(F.col("trade_date") <= cut)
    return mask_labels(panel, index, cut, horizons)


@dataclass(frozen=True)
class Trees:
    """A fitted ensemble as plain rows.

    ``nodes`` has (tree, node, feature, threshold, prediction) with the root as node 1 and the
    children of n as 2n and 2n + 1; a leaf has no feature. A row goes left if its feature is at
    most the threshold. ``weights`` has one factor per tree, ``importances`` one share per feature.
    """

    nodes: tuple[tuple[int, int, str | None, float | None, float], ...]
    weights: tuple[float, ...]
    importances: tuple[float, ...]


def bin_edges(training: DataFrame, rows: int, bins: int = BINS,
              sample: int = BIN_SAMPLE) -> list[list[float]]:
    """Ascending edges of each feature of ``rows`` rows, at most ``bins - 1``: values at even ranks
    of a sample.

    The sample is the rows whose hash of symbol and date is small, about ``sample`` of them
    whatever the size of the table; all rows if there are fewer.
    """
    name = F.concat_ws("|", "symbol", F.col("trade_date").cast("string"))
    hashed = F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("decimal(20,0)")
    picked = training.where(hashed * rows < F.lit(sample * 2**32).cast("decimal(38,0)"))
    edges = []
    for values in zip(*picked.select(*FEATURE_NAMES).collect(), strict=True):  # about ``sample``
        ranked, n = sorted(values), len(values)
        edges.append(sorted({ranked[-(-q * n // bins) - 1] for q in range(1, bins)}))
    return edges or [[] for _ in FEATURE_NAMES]


def binned(features: DataFrame, edges: Sequence[Sequence[float]]) -> list[Column]:
    """For each feature, the number of edges below its value."""
    def place(name: str, own: Sequence[float]) -> Column:
        held = F.array(*[F.lit(float(e)) for e in own]).cast("array<double>")
        return F.size(F.filter(held, lambda e: e < F.col(name))).cast("double").alias(name)

    return [place(name, own) for name, own in zip(FEATURE_NAMES, edges, strict=True)]


def read_trees(model: GBTRegressionModel, edges: Sequence[Sequence[float]]) -> Trees:
    """The nodes of a model fitted on bins, with thresholds on the features themselves.

    Goes through the model's saved form, which is a table of nodes.
    """
    spark = SparkSession.active()
    path = fresh_path(spark, "trees")
    model.write().save(path)
    saved = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").collect()
    by_tree: dict[int, dict] = {}
    for row in saved:  # (2 ** (depth + 1) - 1) rows per tree
        by_tree.setdefault(row.treeID, {})[row.id] = row
    nodes = []
    for tree, held in sorted(by_tree.items()):
        def walk(at: int, number: int, tree=tree, held=held) -> None:
            row = held[at]
            if row.leftChild < 0:
                nodes.append((tree, number, None, None, row.prediction))
                return
            feature, cut = row.split.featureIndex, row.split.leftCategoriesOrThreshold[0]
            nodes.append((tree, number, FEATURE_NAMES[feature], edges[feature][int(cut)],
                          row.prediction))
            walk(row.leftChild, 2 * number)
            walk(row.rightChild, 2 * number + 1)
        walk(0, 1)
    return Trees(tuple(nodes), tuple(model.treeWeights),
                 tuple(float(w) for w in model.featureImportances.toArray()))


def fit_multi_horizon(training: DataFrame, horizons: Sequence[int] = DEFAULT_HORIZONS, *,
                      bins: int = BINS, sample: int = BIN_SAMPLE, **settings) -> dict[int, Trees]:
    """One boosted-tree regressor per horizon, on the rows whose label is usable.

    Trees split at the edges of ``bins`` bins per feature (see ``bin_edges``).
    """
    params = {**MODEL_SETTINGS, **settings}
    labels = [f"label_{h}" for h in horizons]
    # Read three times: once for the sizes, once for the edges, once to be dealt.
    training = stored(training.select("symbol", "trade_date", *FEATURE_NAMES, *labels), "training")
    usable = training.agg(F.count("*").alias("rows"), *[F.count(c).alias(c) for c in labels], *[
        F.max(F.abs(c)).alias(f"largest_{c}") for c in labels]).first()
    rows_in = usable["rows"]
    edges = bin_edges(training, rows_in, bins, sample)
    for h, label in zip(horizons, labels):
        if usable[label] < MIN_TRAINING_ROWS:
            raise ValueError(f"horizon {h} has fewer than {MIN_TRAINING_ROWS} training rows")
        if not math.isfinite(usable[f"largest_{label}"]):
            raise ValueError(f"horizon {h} has a label that is not finite")
    # Every round reads the matrix again, one job per level: tasks of a few rows would cost more
    # than what they compute.
    dealt = training.select(
        "symbol", "trade_date", *[b.cast("smallint").alias(n) for n, b in zip(
            FEATURE_NAMES, binned(training, edges))], *[F.col(c).cast("double") for c in labels]
    ).repartition(max(1, -(-rows_in // ROWS_PER_TASK)), "symbol", "trade_date")
    grown = boost(dealt.drop("symbol", "trade_date"), len(labels),
                  max(usable[f"largest_{c}"] for c in labels),
                  n_bins=max(map(len, edges)) + 1, **params)
    return {h: _trees(trees, edges, params["stepSize"]) for h, trees in zip(horizons, grown)}


def _trees(grown: Sequence[Tree], edges: Sequence[Sequence[float]], step: float) -> Trees:
    """Grown trees as rows, with thresholds on the features themselves."""
    nodes, gains = [], [0.0] * len(FEATURE_NAMES)
    for number, tree in enumerate(grown):
        def walk(at: int, number=number, tree=tree) -> None:
            feature = int(tree.feature[at])
            if feature < 0:
                nodes.append((number, at, None, None, float(tree.value[at])))
                return
            nodes.append((number, at, FEATURE_NAMES[feature],
                          edges[feature][int(tree.cut[at])], 0.0))
            gains[feature] += float(tree.gain[at])
            walk(2 * at)
            walk(2 * at + 1)
        walk(1)
    total = sum(gains) or 1.0
    return Trees(tuple(nodes), tuple(step if n else 1.0 for n in range(len(grown))),
                 tuple(g / total for g in gains))


def production_fit(bars: DataFrame, index: DataFrame,
                   horizons: Sequence[int] = DEFAULT_HORIZONS,
                   **settings) -> tuple[DataFrame, dict[int, Trees]]:
    """The training matrix up to the production cutoff, and the models refitted on it."""
    cutoff = production_cutoff(index, horizons).first()
    if cutoff is None:
        raise ValueError("no session has its longest label inside the data")
    matrix = training_matrix(bars, index, cutoff.trade_date, horizons)
    return matrix, fit_multi_horizon(matrix, horizons, **settings)


def fit_summary(matrix: DataFrame, models: Mapping[int, Trees]) -> DataFrame:
    """Per horizon: the last day of the matrix, the rows with a usable label, and the trees."""
    trees = [(h, len(m.weights)) for h, m in sorted(models.items())]
    counts = matrix.agg(F.max("trade_date").alias("cutoff"), *[
        F.count(f"label_{h}").alias(str(h)) for h, _ in trees])
    return counts.select("cutoff", F.explode(F.array(*[
        F.struct(F.lit(h).alias("horizon"), F.col(str(h)).alias("usable_rows"),
                 F.lit(n).alias("trees")) for h, n in trees])).alias("m")).select(
        "m.horizon", "cutoff", "m.usable_rows", "m.trees")


def score_panel(features: DataFrame, models: Mapping[int, Trees]) -> DataFrame:
    """Mean of the per-horizon predictions for every feature row.

    Rows are scored where they lie, some thousands at once and tree by tree. A row without one of
    the features has no score.
    """
    known = F.lit(True)
    for name in FEATURE_NAMES:
        known = known & F.col(name).isNotNull()
    thresholds = [sorted({n[3] for m in models.values() for n in m.nodes if n[2] == name})
                  for name in FEATURE_NAMES]
    forests = [_forest(m, thresholds) for _, m in sorted(models.items())]

    @F.arrow_udf("double")
    def mean(*columns: pa.Array) -> pa.Array:
        places = np.stack([np.searchsorted(cuts, x.to_numpy(zero_copy_only=False)) for cuts, x in zip(
            thresholds, columns, strict=True)])
        places = places.astype(np.uint8 if places.max(initial=0) < 256 else np.int64)
        total = sum(_predicted(places, trees) for trees in forests)
        return pa.array(total / len(forests), pa.float64())

    return features.withColumn("score", F.when(known, mean(*[
        F.col(c).cast("double") for c in FEATURE_NAMES])))


def _forest(model: Trees, thresholds: Sequence[Sequence[float]]) -> list[Tree]:
    """The trees by node, with the place of a threshold among those of its feature as the cut and
    leaves that hold their weight."""
    size = 1 << max(n[1].bit_length() for n in model.nodes)
    forest = [Tree(np.full(size, -1, np.int16), np.zeros(size, np.int64), np.zeros(size),
                   np.zeros(size)) for _ in model.weights]
    for number, at, feature, threshold, prediction in model.nodes:
        tree = forest[number]
        if feature is None:
            tree.value[at] = prediction * model.weights[number]
        else:
            tree.feature[at] = FEATURE_NAMES.index(feature)
            tree.cut[at] = bisect_left(thresholds[tree.feature[at]], threshold)
    return forest


def _predicted(places: np.ndarray, forest: Sequence[Tree]) -> np.ndarray:
    """Sum of the trees for every row, from the thresholds below each of its features."""
    total = np.zeros(places.shape[1])
    for tree in forest:
        total += tree.value[nodes_of(places, tree, len(tree.feature).bit_length() - 2)]
    return total


def model_nodes(models: Mapping[int, Trees], like: DataFrame) -> DataFrame:
    """Every node of every model as a row."""
    rows = [(h, *n) for h, m in sorted(models.items()) for n in m.nodes]
    return like.sparkSession.createDataFrame(
        rows, "horizon int, tree int, node int, feature string, threshold double, "
              "prediction double")


def model_importances(models: Mapping[int, Trees], like: DataFrame) -> DataFrame:
    """Split importance of each feature per horizon: nine numbers per model."""
    rows = [(h, name, w) for h, m in sorted(models.items())
            for name, w in zip(FEATURE_NAMES, m.importances, strict=True)]
    return like.sparkSession.createDataFrame(rows, "horizon int, name string, weight double")


def validation_pairs(scored: DataFrame, index: DataFrame,
                     horizon: int = VALIDATION_HORIZON) -> DataFrame:
    """Scores and realised labels of the validation sessions whose labels end before the
    test part starts, by the calendar and by the symbol's own dates.

    ``scored`` carries the score and the label columns of the horizon.
    """
    split = session_splits(index)
    everywhere = Window.partitionBy(F.lit(0))
    in_test = F.col("part") == "test"
    days = split.select(
        "trade_date", "part", F.col("idx"),
        F.min(F.when(in_test, F.col("trade_date"))).over(everywhere).alias("_test"),
        F.min(F.when(in_test, F.col("idx"))).over(everywhere).alias("_test_idx"),
    ).where((F.col("part") == "validation") & (F.col("idx") + horizon < F.col("_test_idx")))
    return (scored.join(small(days.select("trade_date", "_test")), "trade_date")
            .where(F.col(f"label_end_{horizon}") < F.col("_test"))
            .select("symbol", "trade_date", "score", F.col(f"label_{horizon}").alias("label"),
                    F.col(f"label_end_{horizon}").alias("label_end")))


def leak_checks(matrix: DataFrame, pairs: DataFrame, split: DataFrame, panel: DataFrame,
                replayed: DataFrame, horizons: Sequence[int] = DEFAULT_HORIZONS,
                universe_disclosed: bool = True) -> DataFrame:
    """Six checks as rows (check_id, status, violations) on the tables a model was made from.

    ``matrix`` is the training matrix with labels, ``pairs`` the validation pairs with their
    ``label_end``, ``split`` the one row of the walk-forward split, ``panel`` the feature panel up
    to the end of validation and ``replayed`` the same from data cut there. Every violation is
    counted in these tables; the disclosure is declared.
    """
    bounds = small_row(split)
    escaped = F.lit(False)
    for h in horizons:
        escaped = escaped | F.coalesce(
            F.col(f"label_end_{h}") > F.col("train_end"), F.lit(False))
    ordered = (F.col("train_end") < F.col("validation_start")) & (
        F.col("validation_start") <= F.col("validation_end")) & (
        F.col("validation_end") < F.col("test_start"))

    def counted(table: DataFrame, **checks: Column) -> DataFrame:
        return table.agg(*[F.count_if(bad).alias(name) for name, bad in checks.items()]).unpivot(
            [], list(checks), "check_id", "violations")

    declared = 0 if universe_disclosed else 1
    rows = counted(split, temporal_split_monotonic=~F.coalesce(ordered, F.lit(False)))
    rows = rows.union(counted(
        matrix.join(bounds), label_window_inside_train=escaped,
        training_rows_time_ordered=F.col("trade_date") > F.col("train_end")))
    rows = rows.union(counted(pairs.join(bounds), validation_labels_outside_test=F.col(
        "label_end") >= F.col("test_start")))
    rows = rows.union(panel_difference(panel, replayed).agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("violations")).select(
        F.lit("feature_pit_truncation_invariant").alias("check_id"), "violations"))
    rows = rows.union(split.agg(F.lit(declared).cast("bigint").alias("violations")).select(
        F.lit("universe_fixed_audit_set_disclosed").alias("check_id"), "violations"))
    return rows.select("check_id", F.when(F.col("violations") == 0, "pass").otherwise("fail")
                       .alias("status"), F.col("violations").cast("bigint").alias("violations"))


def small_row(split: DataFrame) -> DataFrame:
    """Broadcast hint for the one row of a split; several rows are an error."""
    names = ("train_end", "validation_start", "validation_end", "test_start")
    row = F.when(F.count("*") == 1, F.first(F.struct(*names))).otherwise(
        F.raise_error(F.lit("a split is one row")).cast(split.select(F.struct(*names)).schema[
            0].dataType))
    return F.broadcast(split.agg(row.alias("s")).select("s.*"))


def audit_leaks(bars: DataFrame, horizons: Sequence[int] = DEFAULT_HORIZONS,
                universe_disclosed: bool = True) -> DataFrame:
    """``leak_checks`` on the matrix, pairs, split and panels that the library makes of ``bars``."""
    index = calendar_index(sessions(bars))
    split = walk_forward_split(index)
    found = split.first()
    matrix = training_matrix(bars, index, found.train_end, horizons)
    scored = panel_with_labels(bars, (VALIDATION_HORIZON,)).withColumn("score", F.col("ret_20d"))
    panel = feature_panel(bars).where(F.col("trade_date") <= F.lit(found.validation_end))
    return leak_checks(matrix, validation_pairs(scored, index), split, panel,
                       feature_panel(bars, as_of=found.validation_end), horizons,
                       universe_disclosed)
