"""Benchmark decontamination by a broadcast hash set of normalised n-grams."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import stored
from .tokens import LOWER, bounds, hashes
from .words import shingles, slices, utf8

_BITS = 20


class Windows:
    """A hash set of windows: a bit table before sorted hashes, and each window's items."""

    def __init__(self, rows: list):
        self.items: dict[bytes, list[str]] = {}
        lengths, known = set(), set()
        for value, length, window, item in rows:
            known.add(value)
            lengths.add(length)
            held = self.items.setdefault(bytes(window), [])
            if item is not None:
                held.append(item)
        self.lengths = sorted(lengths)
        self.known = np.sort(np.array(list(known), np.int64).astype(np.uint64))
        self.bits = np.zeros(1 << _BITS, bool)
        self.bits[self.known & np.uint64((1 << _BITS) - 1)] = True

    def hits(self, values: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(self.bits[values & np.uint64((1 << _BITS) - 1)])
        place = np.minimum(np.searchsorted(self.known, values[at]), len(self.known) - 1)
        return at[self.known[place] == values[at]]


def item_windows(items: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """Distinct ``value`` (hash), ``length``, ``window`` (words joined by a space) and ``item``."""
    items = items.select(items[id_col].cast("string").alias("item"), items[text_col].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch["text"])
            for a, b in slices(offsets):
                part, at = data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]
                starts, ends, begins = bounds(part, at)
                lower = LOWER[part]
                values, runs = shingles(hashes(lower, starts, ends), begins, width)
                rows = np.repeat(np.arange(b - a), np.diff(runs))
                first = begins[rows] + np.arange(len(values)) - runs[rows]
                length = np.minimum(np.diff(begins), width)[rows]
                windows = [joined(lower, starts, ends, f, n)
                           for f, n in zip(first.tolist(), length.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(values.astype(np.int64)), pa.array(length),
                     pa.array(windows, pa.binary()), batch["item"].take(pa.array(rows + a))],
                    names=["value", "length", "window", "item"])

    return items.mapInArrow(
        run, "value long, length long, window binary, item string").distinct()


def joined(lower: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: int, n: int) -> bytes:
    return b" ".join(lower[starts[i]:ends[i]].tobytes() for i in range(first, first + n))


def scan_windows(docs: DataFrame, items: DataFrame, *, width: int = 10, most: int = 100_000,
                 text_col: str = "text", item_col: str = "item_id",
                 item_text_col: str = "text") -> DataFrame:
    """Each row of ``docs`` as the struct ``doc``, with what it shares with the benchmark.

    A window is ``width`` consecutive words of an item, or all words of a shorter one. ``n_words``
    and ``n_hit`` count a text's words and those inside any occurrence of a window; ``spans`` are
    the stretches of such words, in code points, end exclusive; ``item_ids`` (as sorted text) are
    the items that have a window there.

    Windows are dealt into blocks of about ``most`` (window, item) pairs; one block at a time is
    broadcast as a hash set and every text scanned against it, each hit being compared word by
    word. Benchmarks seldom need a second block; where they do, what was found so far is stored
    between the passes. Nothing is shuffled.

    Null and empty texts, and texts without a word, have no word and no span. Texts of any length
    are read whole. Items without a word have no window; an item without an id marks words and
    spans but is not listed. Repeated items count once, repeated rows of ``docs`` each. Empty
    tables: no rows, or no hits. All columns of ``docs`` are kept in ``doc``, whatever their names.
    """
    spark = docs.sparkSession
    windows = stored(item_windows(items, width, item_col, item_text_col), "windows")
    blocks = max(1, math.ceil(windows.count() / most))
    block = F.pmod(F.xxhash64("value", "item"), F.lit(blocks))
    found = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("doc") if docs.columns else F.struct(),
        docs[text_col].alias("text"), F.lit(0).cast("long").alias("n_words"),
        F.lit(0).cast("long").alias("n_hit"), *[F.array().cast(f"array<{kind}>").alias(name)
                                                for name, kind in _LISTS.items()])
    for i in range(blocks):
        rows = [tuple(r) for r in windows.where(block == i).collect()]
        held = spark.sparkContext.broadcast(Windows(rows))  # about ``most`` pairs
        if i:
            found = stored(found, "scanned")
        found = found.mapInArrow(_scanner(held, found.schema), found.schema)
    pairs = F.transform(F.sequence(F.lit(2), F.size("edges"), F.lit(2)), lambda k: F.struct(
        F.element_at("edges", k - 1).alias("start"), F.element_at("edges", k).alias("end")))
    return found.select(
        "doc", "n_words", "n_hit", F.when(F.size("edges") > 0, pairs).otherwise(
            F.array().cast("array<struct<start:bigint,end:bigint>>")).alias("spans"),
        F.array_sort("item_ids").alias("item_ids"))


#: hit words as first, end, first, end ...; the same in code points; the items.
_LISTS = {"words": "bigint", "edges": "bigint", "item_ids": "string"}


def _scanner(held, schema: T.StructType):
    def scan(batch: pa.RecordBatch, data, offsets, a: int, b: int) -> pa.RecordBatch:
        windows = held.value
        part, at = data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]
        starts, ends, begins = bounds(part, at)
        lower = LOWER[part]
        words = hashes(lower, starts, ends)
        counts, items = np.diff(begins), [set(x) for x in batch["item_ids"].slice(
            a, b - a).to_pylist()]
        change = np.zeros(len(words) + 1, np.int64)
        for row, ranges in enumerate(batch["words"].slice(a, b - a).to_pylist()):
            for first, end in zip(ranges[::2], ranges[1::2], strict=True):
                change[begins[row] + first] += 1
                change[begins[row] + end] -= 1
        for length in windows.lengths:
            values, runs = shingles(words, begins, length)
            hit = windows.hits(values)
            rows = np.searchsorted(runs, hit, side="right") - 1
            for k, row in zip(hit.tolist(), rows.tolist(), strict=True):
                first = int(begins[row] + k - runs[row])
                n = min(length, int(counts[row]))
                ids = windows.items.get(joined(lower, starts, ends, first, n))
                if ids is not None:
                    items[row].update(ids)
                    change[first] += 1
                    change[first + n] -= 1
        inside = np.cumsum(change[:-1]) > 0
        row_of = np.repeat(np.arange(b - a), counts)
        new_row = np.concatenate([[True], row_of[1:] != row_of[:-1]])[:len(inside)]
        before = np.concatenate([[False], inside[:-1]])[:len(inside)]
        opens = np.flatnonzero(inside & (new_row | ~before))
        shuts = np.flatnonzero(inside & np.concatenate([new_row[1:] | ~inside[1:],
                                                        [True]])[:len(inside)])
        points = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80)])
        owner = row_of[opens]
        lists = pa.array(2 * np.searchsorted(owner, np.arange(b - a + 1)), pa.int32())
        spans = np.column_stack([opens - begins[owner], shuts + 1 - begins[owner]]).ravel()
        edges = np.column_stack([points[starts[opens]] - points[at[owner]],
                                 points[ends[shuts]] - points[at[owner]]]).ravel()
        n_hit = np.concatenate([[0], np.cumsum(inside)])[begins]
        return pa.RecordBatch.from_arrays(
            [batch["doc"].slice(a, b - a), batch["text"].slice(a, b - a), pa.array(counts),
             pa.array(np.diff(n_hit).astype(np.int64)),
             pa.ListArray.from_arrays(lists, pa.array(spans.astype(np.int64))),
             pa.ListArray.from_arrays(lists, pa.array(edges.astype(np.int64))),
             pa.array([list(x) for x in items], pa.list_(pa.string()))], names=schema.fieldNames())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch["text"])
            for a, b in slices(offsets):
                yield scan(batch, data, offsets, a, b)

    return run


def decontaminate(docs: DataFrame, items: DataFrame, *, drop: str = "spans",
                  text_col: str = "text", **options) -> DataFrame:
    """``docs`` without what the benchmark holds, with the columns of ``docs``.

    ``drop="documents"`` leaves out every row with a hit; ``drop="spans"`` cuts the hit stretches
    out of the texts (a space stands for each between other text) and leaves out rows of nothing
    but such stretches. See ``scan_windows`` for odd rows, which stay as they are.
    """
    if drop not in ("spans", "documents"):
        raise ValueError("drop is 'spans' or 'documents'")
    found = scan_windows(docs, items, text_col=text_col, **options)
    if drop == "documents":
        return found.where("n_hit = 0").select("doc.*")
    text = F.col("doc")[text_col]
    ends = F.concat(F.array(F.lit(0).cast("long")), F.transform("spans", lambda s: s["end"]))
    starts = F.concat(F.transform("spans", lambda s: s["start"]),
                      F.array(F.length(text).cast("long")))
    pieces = F.zip_with(ends, starts, lambda e, s: F.substring(
        text, (e + 1).cast("int"), (s - e).cast("int")))
    cut = F.when(F.col("n_hit") == 0, text).otherwise(F.array_join(pieces, " "))
    cut = found.withColumn("left", cut).where("n_hit = 0 or left rlike '[^\\\\x00-\\\\x20]'")
    return cut.select(*[F.col("left").alias(c) if c == text_col else F.col("doc")[c].alias(c)
                        for c in docs.columns])
