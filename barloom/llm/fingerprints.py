"""Document fingerprints by one-permutation MinHash with optimal densification and packed bits."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .words import mix, shingles, slices, utf8, word_hashes

_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


class Fingerprinter:
    """Fingerprints of ``bins`` values of ``bits`` (1, 2, 4 or 8) low-order bits each.

    Each shingle hash falls into one bin, by its high bits, and a bin keeps its least hash. Bin i,
    if empty, takes the value of the first non-empty bin in its own fixed sequence of hashed bins.
    A text without words has the fingerprint of all zeros.
    """

    def __init__(self, bins: int = 512, bits: int = 4, width: int = 5):
        if bins & (bins - 1) or bits not in (1, 2, 4, 8):
            raise ValueError("bins must be a power of two and bits 1, 2, 4 or 8")
        self.bins, self.bits, self.width = bins, bits, width
        self._first: np.ndarray | None = None

    def _probe(self, bin_ids: np.ndarray, attempt: int) -> np.ndarray:
        return (mix((bin_ids + self.bins * attempt).astype(np.uint64), 11)
                % np.uint64(self.bins)).astype(np.int64)

    def _turns(self) -> np.ndarray:
        """At [i, j], the first attempt at which bin i probes bin j."""
        if self._first is None:
            first = np.full((self.bins, self.bins), -1, np.int32)
            every, attempt = np.arange(self.bins), 0
            while (first < 0).any():
                to = self._probe(every, attempt)
                new = first[every, to] < 0
                first[every[new], to[new]] = attempt
                attempt += 1
            self._first = first
        return self._first

    def _densify(self, table: np.ndarray) -> None:
        full = table != _NONE
        count = full.sum(axis=1)
        for row in np.flatnonzero((count > 0) & (count <= 32)):
            have = np.flatnonzero(full[row])
            need = np.flatnonzero(~full[row])
            table[row, need] = table[row, have[np.argmin(self._turns()[need][:, have], axis=1)]]
        rows, bins = np.nonzero(~full & (count > 32)[:, None])
        attempt = 0
        while len(rows):
            to = self._probe(bins, attempt)
            ok = full[rows, to]
            table[rows[ok], bins[ok]] = table[rows[ok], to[ok]]
            rows, bins = rows[~ok], bins[~ok]
            attempt += 1

    def of(self, texts: pa.Array) -> np.ndarray:
        """The low-order bits of every bin, one row per text."""
        data, offsets = utf8(texts)
        out = np.zeros((len(texts), self.bins), np.uint8)
        shift = np.uint64(64 - self.bins.bit_length() + 1)
        for a, b in slices(offsets):
            hashes, begins = shingles(*word_hashes(
                data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]), self.width)
            row = np.repeat(np.arange(b - a), np.diff(begins))
            table = np.full((b - a) * self.bins, _NONE)
            np.minimum.at(table, row * self.bins + (hashes >> shift).astype(np.int64), hashes)
            table = table.reshape(b - a, self.bins)
            self._densify(table)
            low = (table & np.uint64((1 << self.bits) - 1)).astype(np.uint8)
            low[np.diff(begins) == 0] = 0
            out[a:b] = low
        return out

    def pack(self, low: np.ndarray) -> list[str]:
        """Lowercase hex of the packed bits."""
        per = 8 // self.bits
        packed = np.zeros((len(low), self.bins // per), np.uint8)
        for i in range(per):
            packed |= low[:, i::per] << np.uint8(self.bits * i)
        return [row.tobytes().hex() for row in packed]

    def unpack(self, fingerprint: str) -> np.ndarray:
        packed = np.frombuffer(bytes.fromhex(fingerprint), np.uint8)
        low = np.zeros(self.bins, np.uint8)
        per = 8 // self.bits
        for i in range(per):
            low[i::per] = (packed >> np.uint8(self.bits * i)) & np.uint8((1 << self.bits) - 1)
        return low

    def likeness(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Estimated Jaccard similarity row by row.

        Unequal values agree in their low bits with probability ``2 ** -bits``; the estimate takes
        that share out. Two texts without words are alike (1), one such text and another are not.
        """
        chance = 2.0 ** -self.bits
        same = np.clip(((x == y).mean(axis=1) - chance) / (1 - chance), 0, 1)
        bare_x, bare_y = ~x.any(axis=1), ~y.any(axis=1)
        return np.where(bare_x | bare_y, (bare_x & bare_y).astype(float), same)


def fingerprint_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                          bins: int = 512, bits: int = 4, width: int = 5) -> DataFrame:
    """``doc_id`` and ``fingerprint`` of every row, without a shuffle.

    Null texts read as empty; a text without words has the fingerprint of all zeros; fewer than
    ``width`` words make one shingle. Repeated rows and null ids are kept. Other columns are not
    read. An empty table gives no rows.
    """
    docs = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    schema = T.StructType([docs.schema["doc_id"], T.StructField("fingerprint", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = Fingerprinter(bins, bits, width)
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(maker.pack(maker.of(batch["text"])), pa.string())],
                names=["doc_id", "fingerprint"])

    return docs.mapInArrow(run, schema)


def in_order(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text``, ``bucket`` and ``lent``: rows in ranges of ascending id, sorted.

    The last row of each bucket is the first row of the next one, lent to it (the first of all to
    the last bucket), so every row has its successor beside it. Buckets are cut by quantiles of
    the ids; the driver sees one id per bucket. Texts are shuffled once. Null ids come last.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    number = F.col("doc_id").cast("double")
    ids = docs.select("doc_id").withColumn("number", number)
    cuts = ids.approxQuantile("number", [i / parts for i in range(1, parts)], 0.2 / parts)
    splits = [float("-inf"), *sorted(set(cuts) or {0.0}), float("inf")]
    bucketizer = Bucketizer(splits=splits, inputCol="number", outputCol="bucket",
                            handleInvalid="keep")

    def dealt(df: DataFrame) -> DataFrame:
        return bucketizer.transform(df).withColumn("bucket", F.coalesce(
            F.col("bucket").cast("int"), F.lit(len(splits))))

    firsts = sorted(dealt(ids).groupBy("bucket").agg(F.min("doc_id").alias("first")).collect(),
                    key=lambda row: row["bucket"])
    lend = [(row["first"], firsts[i - 1]["bucket"]) for i, row in enumerate(firsts)]
    schema = T.StructType([T.StructField("first", docs.schema["doc_id"].dataType),
                           T.StructField("to", T.IntegerType())])
    lent = F.broadcast(spark.createDataFrame(lend, schema))  # one row per bucket
    rows = dealt(docs.withColumn("number", number)).join(
        lent, F.col("doc_id").eqNullSafe(F.col("first")), "left")
    places = F.array(F.struct(F.col("bucket").alias("b"), F.lit(False).alias("lent")),
                     F.struct(F.col("to").alias("b"), F.lit(True).alias("lent")))
    rows = rows.select("doc_id", "text", F.inline(F.filter(places, lambda p: p["b"].isNotNull())))
    return rows.withColumnRenamed("b", "bucket").repartition(parts, "bucket").sortWithinPartitions(
        "bucket", "lent", F.col("doc_id").asc_nulls_last(), "text")


def compare_with_next(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                      bins: int = 512, bits: int = 4, width: int = 5) -> DataFrame:
    """Fingerprints of every text, of the text edited with its successor's beginning, and the
    likeness of the first to the second and to the successor's.

    The edited text has the last floor(n / 2) code points replaced by as many of the next
    document's first (all, if it has fewer); the first document follows the last. Rows of equal id
    are ordered by text. Null texts read as empty. Null ids come last. Repeated rows are kept.
    Other columns are not read. An empty table gives no rows.
    """
    docs = docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col], F.lit(""))
                       .alias("text"))
    schema = T.StructType([
        docs.schema["doc_id"], T.StructField("n_chars", T.LongType()),
        T.StructField("edited_sha256", T.StringType()),
        T.StructField("fingerprint", T.StringType()),
        T.StructField("edited_fingerprint", T.StringType()),
        T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = Fingerprinter(bins, bits, width)
        id_type = None
        held: list[tuple] = []

        def process() -> pa.RecordBatch | None:
            """All rows held but the last, which may need the next batch."""
            texts = [h[1] for h in held]
            own, ids, edited = [], [], []
            for i in range(len(held) - 1):
                if held[i][3]:
                    continue
                text, after = texts[i], texts[i + 1]
                half = len(text) // 2
                own.append(i)
                ids.append(held[i][0])
                edited.append(text[:len(text) - half] + after[:half])
            del held[:-1]
            if not own:
                return None
            whole = maker.of(pa.array(texts, pa.large_string()))
            changed = maker.of(pa.array(edited, pa.large_string()))
            at = np.array(own)
            return pa.RecordBatch.from_arrays([
                pa.array(ids, id_type), pa.array([len(texts[i]) for i in own], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
                pa.array(maker.pack(whole[at])), pa.array(maker.pack(changed)),
                pa.array(maker.likeness(whole[at], changed)),
                pa.array(maker.likeness(whole[at], whole[at + 1])),
            ], names=schema.fieldNames())

        size = 0
        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            columns = [batch[c] for c in ("doc_id", "text", "bucket", "lent")]
            for row in zip(*columns, strict=True):
                held.append(tuple(v.as_py() for v in row))
                size += len(held[-1][1])
                if size > 1 << 21:
                    size = len(held[-1][1])
                    if (done := process()) is not None:
                        yield done
        if held and (done := process()) is not None:
            yield done

    return in_order(docs).mapInArrow(run, schema)
