"""Near-duplicate documents by fast similarity sketches, banding and exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .graph import components
from .tables import stored
from .words import distinct, mix, shingles, slices, utf8, word_hashes

_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
GROUPS = 64  # counts of a document's shingles by hash, for the bound of the last step


def sets_of(data: np.ndarray, offsets: np.ndarray, width: int):
    """Distinct shingle hashes row by row, ascending, and where each row's begin."""
    values, begins = shingles(*word_hashes(data, offsets), width)
    rows = [distinct(values[a:b]) for a, b in zip(begins[:-1], begins[1:], strict=True)]
    sizes = np.array([len(r) for r in rows], np.int64)
    return (np.concatenate(rows) if rows else np.zeros(0, np.uint64),
            np.concatenate([[0], np.cumsum(sizes)]))


def sketches(values: np.ndarray, begins: np.ndarray, size: int) -> np.ndarray:
    """The fast similarity sketch of each row's set: ``size`` coordinates.

    Round i below ``size`` throws every element into a hashed bin, with i before its value, so a
    bin keeps the least value of the first round that reached it. A row is done after the round
    that fills its last bin. Rounds from ``size`` on put all elements into one fixed bin each, so
    every coordinate of a set with any element is filled. Rows of empty sets stay unfilled.
    """
    rows = len(begins) - 1
    out = np.full((rows, size), _NONE)
    counts = np.diff(begins)
    active = np.flatnonzero(counts)
    row = np.repeat(np.arange(len(active)), counts[active])
    elements = values
    for i in range(2 * size):
        if not len(active):
            break
        thrown = mix(elements, 100 + i)
        if i < size:
            bins = (thrown % np.uint64(size)).astype(np.int64)
        else:
            bins = np.full(len(thrown), i - size)
        best = np.full(len(active) * size, _NONE)
        np.minimum.at(best, row * size + bins, thrown >> np.uint64(10))
        best = best.reshape(len(active), size)
        now = out[active]
        take = (now == _NONE) & (best != _NONE)
        now[take] = best[take] + np.uint64(i << 54)
        out[active] = now
        left = (now == _NONE).any(axis=1)
        if not left.all():
            keep = left[row]
            elements = elements[keep]
            row = (np.cumsum(left) - 1)[row[keep]]
            active = active[left]
    return out


def signatures(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """``doc_id``, ``n_shingles``, a 128-bit hash of the set (``s1``, ``s2``) and band ``keys``."""
    schema = T.StructType([
        T.StructField("doc_id", docs.schema["doc_id"].dataType),
        T.StructField("n_shingles", T.LongType()), T.StructField("s1", T.LongType()),
        T.StructField("s2", T.LongType()), T.StructField("keys", T.ArrayType(T.LongType())),
    ])
    lanes = mix(np.arange(rows, dtype=np.uint64), 5) | np.uint64(1)
    names = np.arange(bands, dtype=np.uint64)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch["text"])
            for a, b in slices(offsets):
                values, begins = sets_of(data[offsets[a]:offsets[b]],
                                         offsets[a:b + 1] - offsets[a], width)
                sketch = sketches(values, begins, bands * rows).reshape(b - a, bands, rows)
                keys = mix((sketch * lanes).sum(axis=2, dtype=np.uint64) + mix(names, 6), 7)
                counts = np.diff(begins)
                keys = keys[counts > 0].astype(np.int64).ravel()
                at = np.concatenate([[0], np.cumsum(np.where(counts > 0, bands, 0))])
                halves = []
                for seed in (8, 9):
                    total = np.concatenate([np.zeros(1, np.uint64),
                                            np.cumsum(mix(values, seed))])
                    halves.append((total[begins[1:]] - total[begins[:-1]]).astype(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].slice(a, b - a), pa.array(counts), *map(pa.array, halves),
                     pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(keys))],
                    names=schema.fieldNames())

    return docs.mapInArrow(sign, schema)


def verify(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs ``a``, ``b`` whose full sets meet ``100 * common >= percent * union``.

    Each text of ``a`` travels once per pair; that of ``b`` once per 256 of its pairs, so a text
    with very many pairs is compared in many tasks.
    """
    many = pairs.groupBy("b").agg(F.count("*").alias("n"))
    pairs = pairs.join(many, "b").select(
        "a", "b", F.pmod(F.xxhash64("a"), F.ceil(F.col("n") / 256)).alias("part"))
    right = pairs.select("b", "part").distinct().join(
        texts, F.col("b") == F.col("doc_id")).select(
        "b", "part", F.lit(None).cast(texts.schema["doc_id"].dataType).alias("a"), "text")
    left = pairs.join(texts, F.col("a") == F.col("doc_id")).select("b", "part", "a", "text")
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    mixed = left.union(right).repartition(parts, "b", "part").sortWithinPartitions(
        "b", "part", F.col("a").asc_nulls_first())
    kind = texts.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("a", kind), T.StructField("b", kind)])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = base = None
        for batch in batches:
            data, offsets = utf8(batch["text"])
            a_ids, b_ids = batch["a"].to_pylist(), batch["b"].to_pylist()
            parts_of = batch["part"].to_pylist()
            found = ([], [])
            for lo, hi in slices(offsets):
                values, begins = sets_of(data[offsets[lo]:offsets[hi]],
                                         offsets[lo:hi + 1] - offsets[lo], width)
                for i in range(lo, hi):
                    own = values[begins[i - lo]:begins[i - lo + 1]]
                    if a_ids[i] is None:
                        group, base = (b_ids[i], parts_of[i]), own.copy()
                        continue
                    assert group == (b_ids[i], parts_of[i])
                    at = np.searchsorted(base, own)
                    common = int((base[np.minimum(at, len(base) - 1)] == own).sum())
                    if 100 * common >= percent * (len(base) + len(own) - common):
                        found[0].append(a_ids[i])
                        found[1].append(b_ids[i])
            yield pa.RecordBatch.from_arrays(
                [pa.array(found[0], batch.schema.field("a").type),
                 pa.array(found[1], batch.schema.field("b").type)], names=["a", "b"])

    return mixed.mapInArrow(compare, schema)


def shared_shingles(docs: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """``doc_id`` and ``shared``: by hash group, how many of its shingles others of ``docs`` hold.

    Two documents have at most the sum of the groups' lesser counts in common.
    """
    ids = T.StructType([texts.schema["doc_id"]])
    wanted = texts.join(docs, "doc_id", "left_semi").select("doc_id", "text")

    def sets(batch: pa.RecordBatch):
        data, offsets = utf8(batch["text"])
        for a, b in slices(offsets):
            yield a, b, *sets_of(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], width)

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, values, begins in sets(batch):
                at = pa.array(np.repeat(np.arange(a, b), np.diff(begins)))
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].take(at), pa.array(values.astype(np.int64))],
                    names=["doc_id", "h"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, values, begins in sets(batch):
                rows = np.repeat(np.arange(b - a), np.diff(begins))
                group = (values % np.uint64(GROUPS)).astype(np.int64)
                held = np.bincount(rows * GROUPS + group, minlength=(b - a) * GROUPS)
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].slice(a, b - a), pa.ListArray.from_arrays(
                        pa.array(np.arange(0, len(held) + 1, GROUPS), pa.int32()),
                        pa.array(held.astype(np.int32)))], names=["doc_id", "held"])

    once = wanted.mapInArrow(expand, T.StructType([*ids, T.StructField("h", T.LongType())]))
    once = once.groupBy("h").agg(F.count("*").alias("n"), F.min("doc_id").alias("doc_id"))
    own = once.where("n = 1").groupBy(F.col("doc_id").alias("own_id")).agg(
        F.collect_list(F.pmod(F.col("h"), F.lit(GROUPS)).cast("int")).alias("own"))
    held = wanted.mapInArrow(count, T.StructType([
        *ids, T.StructField("held", T.ArrayType(T.IntegerType()))]))
    shared = F.transform("held", lambda n, i: n - F.size(F.filter(
        F.coalesce("own", F.array().cast("array<int>")), lambda g: g == i)))
    return held.join(own, F.col("doc_id") == F.col("own_id"), "left").select(
        "doc_id", shared.alias("shared"))


def possible_pairs(entries: DataFrame, percent: int, block_rows: int = 2048) -> DataFrame:
    """Pairs ``a``, ``b`` of one bucket and different components that the counts of ``shared`` do
    not put below the threshold.

    ``entries`` has key, rep, n, c (its component) and ``shared``. A bucket is dealt into blocks of
    about ``block_rows`` documents by hash, and pairs of blocks are compared each in a group of its
    own: 256 by 256 documents at once, as arrays. Rows are made only for what passes.
    """
    sizes = entries.groupBy("key").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks"))
    rows = entries.join(sizes, "key").withColumn(
        "own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias(
        "j"), "own", "rep", "n", "c", "shared")
    kind = entries.schema["rep"].dataType
    schema = T.StructType([T.StructField("a", kind), T.StructField("b", kind)])

    def compare(group: pa.Table) -> pa.Table:
        rep = group["rep"].combine_chunks()
        own, n = group["own"].to_numpy(), group["n"].to_numpy()
        c = group["c"].combine_chunks().dictionary_encode().indices.to_numpy()
        held = group["shared"].combine_chunks().flatten().to_numpy().astype(np.int32)
        held = held.reshape(len(rep), GROUPS)
        first, second = group["i"][0].as_py(), group["j"][0].as_py()
        left, right = np.flatnonzero(own == first), np.flatnonzero(own == second)
        found = ([], [])
        for lo in range(0, len(left), 256):
            x = left[lo:lo + 256]
            for to in range(lo if first == second else 0, len(right), 256):
                y = right[to:to + 256]
                may = c[x][:, None] != c[y][None]
                if first == second:
                    may &= x[:, None] < y[None]
                low = np.minimum(n[x][:, None], n[y][None])
                may &= 100 * low >= percent * np.maximum(n[x][:, None], n[y][None])
                xi, yi = np.nonzero(may)
                for k in range(0, len(xi), 1 << 16):
                    p, q = x[xi[k:k + (1 << 16)]], y[yi[k:k + (1 << 16)]]
                    common = np.minimum(held[p], held[q]).sum(axis=1, dtype=np.int64)
                    keep = 100 * common >= percent * (n[p] + n[q] - common)
                    found[0].append(p[keep])
                    found[1].append(q[keep])
        p, q = (np.concatenate([np.zeros(0, np.int64), *f]) for f in found)
        return pa.table([rep.take(pa.array(p)), rep.take(pa.array(q))], names=["a", "b"])

    pairs = rows.groupBy("key", "i", "j").applyInArrow(compare, schema)
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def near_duplicates(docs: DataFrame, *, width: int = 5, percent: int = 80, bands: int = 32,
                    rows: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` and ``kept`` for every row of ``docs``.

    Two documents are linked if their sets of ``width``-word shingles satisfy
    ``100 * common >= percent * union``; a component's id is its smallest document id.

    Equal sets form classes first, by one aggregate. The smallest document of each class is
    sketched into ``bands`` keys of ``rows`` coordinates; a pair at 0.8 shares no key with
    probability (1 - 0.8**rows)**bands, 3e-6 by default. Candidates that share a key are confirmed
    on their full sets, in three steps that never list the pairs of a bucket already known to
    hang together: every document against one hub, then against the hubs of all its buckets, a
    bucket's hub being the document that shares most keys and so is most central, then the pairs
    of different components in the buckets that still hold several. Of these a pair is left out
    if a bound puts it below the threshold: shingles that only one document holds are not common,
    and by groups of the others' hashes no more than the lesser count is. It loses no link, and
    only pairs that pass become rows (``possible_pairs``).

    Texts of any length are read whole; of different texts under one id the smallest is compared.
    Null or empty texts have no shingle and stay alone. Repeated rows (same id and text) come out
    as often as they go in; a null id is kept and linked with nothing. Other columns are not read.
    An empty table gives no rows.
    """
    docs = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    signed = stored(signatures(docs, width, bands, rows), "signatures")
    usable = signed.where("n_shingles > 0 and doc_id is not null")
    classes = stored(usable.groupBy("s1", "s2").agg(F.min("doc_id").alias("rep")), "classes")
    reps = usable.join(classes, ["s1", "s2"]).where("doc_id = rep").select(
        "rep", F.col("n_shingles").alias("n"), F.explode("keys").alias("key"))
    shared = reps.groupBy("key").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where(
        "low < high").select("key")
    entries = stored(reps.join(shared, "key"), "entries")
    known = entries.join(entries.groupBy("rep").agg(F.count("*").alias("keys")), "rep")
    hubs = known.groupBy("key").agg(
        F.max(F.struct("keys", F.xxhash64("rep").alias("o"), "rep", "n")).alias("hub"))

    def close(x: str, y: str):
        return F.least(x, y) * 100 >= F.greatest(x, y) * percent

    stars = stored(entries.join(hubs, "key").select(
        F.col("rep").alias("a"), "n", F.col("hub.rep").alias("b"), F.col("hub.n").alias("hub_n"),
        F.col("hub.keys").alias("keys"), F.col("hub.o").alias("o")).where("a <> b").where(
        close("n", "hub_n")).select("a", "b", "keys", "o").distinct(), "stars")
    members = entries.select("rep").distinct()
    texts = stored(docs.join(members, docs["doc_id"] == members["rep"], "left_semi")
                   .groupBy("doc_id").agg(F.min("text").alias("text")), "texts")
    first = stored(stars.groupBy("a").agg(F.max(F.struct("keys", "o", "b")).alias("s"))
                   .select("a", F.col("s.b").alias("b")), "first")
    stars = stars.select("a", "b")
    links = stored(verify(first, texts, width, percent), "verified")

    def labelled(df: DataFrame, column: str, labels: DataFrame, name: str) -> DataFrame:
        names = labels.select(F.col("node").alias(column), F.col("component").alias(name))
        return df.join(names, column, "left").withColumn(name, F.coalesce(name, column))

    labels = components(links)
    more = labelled(labelled(stars, "a", labels, "ca"), "b", labels, "cb").where("ca <> cb")
    more = stored(more.select("a", "b").join(first, ["a", "b"], "left_anti"), "more")
    links = links.union(stored(verify(more, texts, width, percent), "verified"))
    labels = components(links)
    split = labelled(entries.select("key", "rep", "n"), "rep", labels, "c")
    mixed = split.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where(
        "lo < hi").select("key")
    split = stored(split.join(mixed, "key", "left_semi"), "mixed")
    shared = stored(shared_shingles(split.select(F.col("rep").alias("doc_id")).distinct(), texts,
                                    width), "shared").withColumnRenamed("doc_id", "rep")
    total = F.aggregate("shared", F.lit(0), lambda s, n: s + n)
    split = split.join(shared, "rep").where(total * 100 >= F.col("n") * percent)
    rest = possible_pairs(split, percent).distinct().join(
        stars.union(stars.select("b", "a")), ["a", "b"], "left_anti")
    links = links.union(stored(verify(stored(rest, "rest"), texts, width, percent), "verified"))
    labels = components(links)

    found = labelled(classes, "rep", labels, "component").select("s1", "s2", "component")
    return signed.join(found, ["s1", "s2"], "left").select(
        "doc_id", "n_shingles",
        F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(),
               F.coalesce("component", "doc_id"))
        .otherwise(F.col("doc_id")).alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
