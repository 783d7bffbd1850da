"""Approximate nearest neighbours: inverted lists scanned by adaptive numbers of dimensions."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


from .tables import stored


def valid_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id`` and ``v`` (little-endian doubles) of the vectors that take part.

    Null ids, and vectors that are null, all zero, or hold a null or non-finite component, take no
    part; nor do vectors of another length than the most frequent one (the longer, if tied).
    """
    rows = vectors.select(vectors[id_col].cast("long").alias("id"),
                          vectors[vector_col].cast("array<double>").alias("x"))
    rows = rows.where(F.col("id").isNotNull() & F.col("x").isNotNull() & (F.size("x") > 0))
    lengths = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n"))
    top = lengths.orderBy(F.desc("n"), F.desc("d")).first()
    rows = rows.where(F.size("x") == (top["d"] if top else 0))

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch["x"]
            values = lists.flatten().to_numpy(zero_copy_only=False)
            matrix = values.astype("<f8").reshape(len(lists), -1) + 0.0  # a null reads as NaN
            good = np.isfinite(matrix).all(axis=1) & (matrix != 0).any(axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch["id"].filter(pa.array(good)),
                 pa.array([row.tobytes() for row in matrix[good]], pa.binary())],
                names=["id", "v"])

    return rows.mapInArrow(clean, "id long, v binary")


@dataclass
class Index:
    """Centres of the lists in the rotated space, one dimension wider than the vectors.

    A vector x becomes (x, sqrt(norm**2 - x.x)) and a query q (q, 0), rotated: the nearest by
    distance are then those of the largest inner product.
    """

    rotation: np.ndarray
    norm2: float
    centres: np.ndarray

    def rotated(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        more = np.zeros(len(x)) if query else np.sqrt(
            np.maximum(self.norm2 - (x * x).sum(axis=1), 0))
        return (np.column_stack([x, more]) @ self.rotation).astype(np.float32)

    def nearest(self, y: np.ndarray, count: int) -> np.ndarray:
        far = (self.centres ** 2).sum(axis=1)[None] - 2 * y @ self.centres.T
        count = min(count, len(self.centres))
        got = np.argpartition(far, count - 1, axis=1)[:, :count]
        return np.take_along_axis(got, np.argsort(
            np.take_along_axis(far, got, axis=1), axis=1, kind="stable"), axis=1)

    @classmethod
    def fit(cls, sample: np.ndarray, norm2: float, lists: int, rounds: int = 12) -> Index:
        """k-means of a sample, from sample points spread over the sample's order."""
        rng = np.random.default_rng(7)
        width = sample.shape[1] + 1
        rotation, _ = np.linalg.qr(rng.standard_normal((width, width)))
        index = cls(rotation, norm2, np.zeros((0, width), np.float32))
        y = index.rotated(sample)
        index.centres = y[np.linspace(0, len(y) - 1, min(lists, len(y))).astype(int)].copy()
        for _ in range(rounds):
            near = np.concatenate([index.nearest(y[a:a + 2048], 1)[:, 0]
                                   for a in range(0, len(y), 2048)])
            for at in np.unique(near):
                index.centres[at] = y[near == at].mean(axis=0)
        return index


def scan(q: np.ndarray, x: np.ndarray, limit: np.ndarray, step: int = 16, eps: float = 2.1):
    """Pairs (query, row) that may be nearer than the squared distance ``limit`` of the query.

    Columns are read in blocks. After d of D rotated columns a pair is abandoned once its partial
    squared distance exceeds limit * d / D * (1 + eps / sqrt(d))**2: the hypothesis that its whole
    distance is within the limit is then rejected at the level that ``eps`` sets.
    """
    width = q.shape[1]
    qi = xi = part = None
    for a in range(0, width, step):
        b = min(a + step, width)
        if qi is None:
            part = ((q[:, a:b] ** 2).sum(axis=1)[:, None] + (x[:, a:b] ** 2).sum(axis=1)[None]
                    - 2 * q[:, a:b] @ x[:, a:b].T)
            qi, xi = np.indices(part.shape).reshape(2, -1)
            part = part.ravel()
        else:
            gap = q[qi, a:b] - x[xi, a:b]
            part = part + np.einsum("ij,ij->i", gap, gap)
        slack = (1 + eps / np.sqrt(b)) ** 2 * b / width if b < width else 1 + 1e-4
        keep = part <= limit[qi] * slack + 1e-5
        qi, xi, part = qi[keep], xi[keep], part[keep]
    return qi, xi


def search(vectors: DataFrame, queries: DataFrame, *, k: int = 20, id_col: str = "vec_id",
           vector_col: str = "embedding", sample: int = 20_000, most_lists: int = 4096,
           probe_share: float = 0.6, block_rows: int = 2048) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the ``k`` largest inner products found of
    each row of ``queries`` with the rows of ``vectors`` of another id.

    Equal vectors form one class, known by its ``k + 1`` smallest ids, so a very common vector is
    searched and compared once. The index has about sqrt(n) lists (``most_lists`` at most), whose
    centres come from the ``sample`` classes of lowest id hash; every class is indexed. A query
    scans its nearest list, which gives its limit, then the rest of the nearest ``probe_share`` of
    all lists under that limit; vectors without clusters need a large share for a given recall. A
    list is cut into blocks of ``block_rows`` rows by id hash, each scanned in its own group. Scores are double inner products of the original vectors; ties go to the smaller id.

    Rows of ``queries`` or ``vectors`` that take no part (see ``valid_vectors``) give no results;
    repeated rows count once. Fewer candidates than ``k`` give fewer ranks; empty tables none.
    Other columns are not read.
    """
    spark = vectors.sparkSession
    rows = stored(valid_vectors(vectors, id_col, vector_col), "vectors")
    by_vector = Window.partitionBy("v").orderBy("id")
    classes = stored(
        rows.distinct().withColumn("at", F.row_number().over(by_vector)).where(
            F.col("at") <= k + 1).groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids"))
        .select(F.col("ids")[0].alias("cid"), "ids", "v"), "vector-classes")
    asked = stored(valid_vectors(queries, id_col, vector_col).distinct().join(
        classes.select("cid", "v"), "v").select(F.col("id").alias("query_id"), "cid"), "queries")

    def norm2(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.frombuffer(b"".join(batch["v"].to_pylist()), "<f8").reshape(len(batch), -1)
            yield pa.RecordBatch.from_arrays([pa.array([float((x * x).sum(axis=1).max(
                initial=0))]), pa.array([len(batch)])], names=["m", "n"])

    facts = classes.select("v").mapInArrow(norm2, "m double, n long").agg(
        F.max("m").alias("m"), F.sum("n").alias("n")).first()
    result = "query_id long, rank int, vec_id long, score double"
    if not facts["n"]:
        return spark.createDataFrame([], result)
    picked = classes.orderBy(F.xxhash64("cid"), "cid").limit(sample).select("v").collect()
    points = np.frombuffer(b"".join(bytes(r["v"]) for r in picked), "<f8").reshape(len(picked), -1)
    lists = int(min(max(round(facts["n"] ** 0.5), 1), most_lists))
    index = Index.fit(points, facts["m"], lists)
    probes = max(1, math.ceil(lists * probe_share))
    held = spark.sparkContext.broadcast(index)  # most_lists centres at most

    def assign(count: int, query: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = np.frombuffer(b"".join(batch["v"].to_pylist()), "<f8").reshape(
                    len(batch), -1)
                near = held.value.nearest(held.value.rotated(x, query), count)
                width = near.shape[1]
                at = pa.array(np.repeat(np.arange(len(batch)), width))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(near.ravel().astype(np.int32)),
                     pa.array(np.tile(np.arange(width, dtype=np.int32), len(batch))),
                     batch["cid"].take(at), batch["v"].take(at)],
                    names=["list", "turn", "cid", "v"])
        return run

    shape = "list int, turn int, cid long, v binary"
    placed = stored(classes.select("cid", "v").mapInArrow(assign(1, False), shape), "lists")
    sizes = F.broadcast(placed.groupBy("list").agg(  # one row per list
        F.ceil(F.count("*") / block_rows).cast("int").alias("blocks")))
    data = placed.join(sizes, "list").select(
        "list", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int").alias("block"),
        F.lit(False).alias("asks"), "cid", "v", F.lit(None).cast("double").alias("limit"))
    probing = stored(asked.select("cid").distinct().join(classes.select("cid", "v"), "cid")
                     .mapInArrow(assign(probes, True), shape), "probes")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def scanned(probed: DataFrame) -> DataFrame:
        """Up to k + 1 classes (qid, cid, score) of each probe in each block of its list."""
        asks = probed.join(sizes, "list").select(
            "list", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
            F.lit(True).alias("asks"), "cid", "v", "limit")
        both = data.union(asks).repartition(parts, "list", "block").sortWithinPartitions(
            "list", "block", "asks")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            place, ids, block, turned = None, [], [], None
            for batch in batches:
                where = list(zip(batch["list"].to_pylist(), batch["block"].to_pylist(),
                                 batch["asks"].to_pylist(), strict=True))
                cuts = [i for i in range(len(where)) if i == 0 or where[i] != where[i - 1]]
                for a, b in zip(cuts, [*cuts[1:], len(where)], strict=True):
                    part = batch.slice(a, b - a)
                    x = np.frombuffer(b"".join(part["v"].to_pylist()), "<f8").reshape(b - a, -1)
                    cid = part["cid"].to_numpy()
                    if place != where[a][:2]:
                        place, ids, block, turned = where[a][:2], [], [], None
                    if not where[a][2]:
                        ids.append(cid)
                        block.append(x)
                        continue
                    if turned is None and ids:
                        ids, block = [np.concatenate(ids)], [np.concatenate(block)]
                        turned = held.value.rotated(block[0])
                    limits = part["limit"].to_numpy(zero_copy_only=False)
                    for lo in range(0, b - a, 128):
                        if turned is not None:
                            yield best(cid[lo:lo + 128], x[lo:lo + 128], limits[lo:lo + 128],
                                       ids[0], block[0], turned)

        def best(qid, q, least, cid, x, turned) -> pa.RecordBatch:
            limit = np.where(np.isnan(least), np.inf,
                             (q * q).sum(axis=1) + held.value.norm2 - 2 * least)
            qi, xi = scan(held.value.rotated(q, True), turned, limit)
            score = np.einsum("ij,ij->i", q[qi], x[xi])
            order = np.lexsort((cid[xi], -score, qi))
            qi, xi, score = qi[order], xi[order], score[order]
            begins = np.searchsorted(qi, qi, side="left")
            top = np.arange(len(qi)) - begins <= k
            return pa.RecordBatch.from_arrays(
                [pa.array(qid[qi[top]]), pa.array(cid[xi[top]]), pa.array(score[top])],
                names=["qid", "cid", "score"])

        return both.mapInArrow(run, "qid long, cid long, score double")

    order = Window.partitionBy("qid").orderBy(F.desc("score"), "cid")

    def leaders(found: DataFrame) -> DataFrame:
        return found.withColumn("at", F.row_number().over(order)).where(F.col("at") <= k + 1)

    first = stored(leaders(scanned(probing.where("turn = 0").withColumn(
        "limit", F.lit(None).cast("double")))).drop("at"), "nearest-list")
    limits = first.groupBy(F.col("qid").alias("lid")).agg(F.when(
        F.count("*") > k, F.min("score")).alias("limit"))
    later = probing.where("turn > 0").join(limits, F.col("cid") == F.col("lid"), "left").drop("lid")
    found = leaders(first.union(scanned(later))).select("qid", "cid", "score")
    members = found.join(classes.select("cid", "ids"), "cid").select(
        "qid", "score", F.explode("ids").alias("vec_id"))
    members = members.withColumn("at", F.row_number().over(Window.partitionBy("qid").orderBy(
        F.desc("score"), "vec_id"))).where(F.col("at") <= k + 1)
    answers = asked.join(members, F.col("cid") == F.col("qid")).where("query_id <> vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return answers.withColumn("rank", rank).where(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
