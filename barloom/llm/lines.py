"""Repeated lines of a corpus, exact and within a few edits, by a segment-partition join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .words import mix

_BASE = 0xD1342543DE82EF95
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        _POWERS[:] = [np.multiply.accumulate(np.concatenate(
            [np.ones(1, np.uint64), np.full(max(n, 1 << 20) - 1, base, np.uint64)]))
            for base in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _POWERS


def segment_keys(lines: list[str], edits: int):
    """(line number, key, own) of every segment and probe of the lines, as three arrays.

    A line of length n has ``edits + 1`` even segments, the last ones longer by one. If two lines
    are within ``edits``, the longer holds a segment of the shorter close to its place: for a
    length less by d and segment i (from 0) at p, from max(p - i, p + d - (edits - i)) to
    min(p + i, p + d + (edits - i)). Keys hash length, segment number and text. ``own`` marks a
    line's own segments, which also serve as its probes at the same place. Of a key the upper 40
    bits are kept: zeros beside the head of a row take no room when it is shuffled, and lines that
    meet by chance are told apart where they are compared.
    """
    lengths = np.array([len(x) for x in lines], np.int64)
    codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
    begins = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    power, inverse = _powers(len(codes) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(
        (codes.astype(np.uint64) + np.uint64(1)) * power[:len(codes)])])
    every = np.arange(len(lines))
    found = ([], [], [])

    def emit(who, start, size, length, segment, own):
        a = begins[who] + start
        text = (total[a + size] - total[a]) * inverse[a]
        key = mix(mix(text, 21) + (length * (edits + 1) + segment).astype(np.uint64), 22)
        found[0].append(who)
        found[1].append(key & ~np.uint64(0xFFFFFF))
        found[2].append(np.full(len(who), own))

    for d in range(edits + 1):
        short = lengths - d
        who = every[short > edits]
        length = short[who]
        base, longer = length // (edits + 1), length % (edits + 1)
        for i in range(edits + 1):
            extra = np.maximum(0, i - (edits + 1 - longer))
            place = base * i + extra
            size = base + (i >= edits + 1 - longer)
            low = max(-i, d - (edits - i))
            high = min(i, d + (edits - i))
            for shift in range(low, high + 1):
                start = place + shift
                fits = (start >= 0) & (start + size <= lengths[who])
                emit(who[fits], start[fits], size[fits], length[fits], i, d == 0 and shift == 0)
    return tuple(np.concatenate(x) if x else np.zeros(0) for x in found)


def within(a: str, b: str, edits: int) -> bool:
    """Whether the edit distance of two lines is at most ``edits``.

    What the lines share at both ends is cut off. A column of the distance matrix over the rest is
    two bit vectors, advanced by one addition; it stops once even a rest without further edits
    would end outside the band of ``edits`` around the diagonal.
    """
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > edits:
        return False
    start, end = 0, len(a)
    while start < end and a[start] == b[start]:
        start += 1
    while end > start and a[end - 1] == b[end - 1 + len(b) - len(a)]:
        end -= 1
    a, b = a[start:end], b[start:end + len(b) - len(a)]
    m = len(a)
    if m == 0:
        return len(b) <= edits
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << m) - 1
    plus, minus, score = full, 0, m
    for j, c in enumerate(b):
        eq = masks.get(c, 0)
        x = eq | minus
        d0 = ((((eq & plus) + plus) ^ plus) | x) & full
        hp = minus | (full & ~(d0 | plus))
        hm = plus & d0
        if hp >> (m - 1) & 1:
            score += 1
        elif hm >> (m - 1) & 1:
            score -= 1
        hp = (hp << 1 | 1) & full
        hm = hm << 1 & full
        plus = hm | (full & ~(d0 | hp))
        minus = hp & d0
        if score - (len(b) - j - 1) > edits:  # each column left takes off one at most
            return False
    return score <= edits


def later_lines(group: list[tuple], edits: int) -> list[int]:
    """Of lines (part, own, h, id, c, at, line) that meet, those close to an earlier one.

    Each edit changes the counts of characters by two at most in all, which rules out most pairs
    before their distance is taken. Pairs of one part are left to the block of that part alone.
    """
    if len(group) < 2:
        return []
    order = sorted(group, key=lambda r: (r[3] is not None, r[3], r[4], r[5]))
    counts = np.zeros((len(order), 32), np.int32)
    for i, row in enumerate(order):
        codes = np.frombuffer(row[6].encode("utf-32-le", "surrogatepass"), np.uint32)
        counts[i] = np.bincount(codes % 32, minlength=32)
    part = np.array([r[0] for r in order])
    own = np.array([r[1] for r in order])
    several = (part != part[0]).any()
    found = []
    for i in range(1, len(order)):
        may = own[:i] | own[i]
        if several:
            may &= part[:i] != part[i]
        at = np.flatnonzero(may)
        at = at[np.abs(counts[at] - counts[i]).sum(axis=1) <= 2 * edits]
        if any(order[j][2] != order[i][2] and within(order[j][6], order[i][6], edits)
               for j in at):
            found.append(order[i][2])
    return found


def line_rows(docs: DataFrame, least: int) -> DataFrame:
    """``id``, ``c`` (content hash), ``at``, ``line``, ``h`` and ``g`` of lines of enough length."""
    rows = docs.select("id", F.xxhash64("text").alias("c"),
                       F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))
    return rows.where(F.length("line") >= least).select(
        "id", "c", "at", "line", F.xxhash64("line").bitwiseAND(-2).alias("h"),
        F.xxhash64(F.lit(1), "line").alias("g"))


def meetings(probes: DataFrame, part_rows: int) -> DataFrame:
    """The rows (key, h, own) of each key that two lines have, with ``parts`` and ``part``.

    ``probes`` has key and h, whose lowest bit is ``own``.

    The rows of a key are counted by a window, whose buffer spills. They are dealt to parts of about
    ``part_rows`` lines; to up to four times larger ones if that makes more than 50 parts.
    """
    key = Window.partitionBy("key")
    own = F.col("h").bitwiseAND(1) == 1
    probes = probes.select("key", F.col("h").bitwiseAND(-2).alias("h"), own.alias("own"))
    size = F.least(F.greatest(F.lit(part_rows), F.ceil(F.col("n") / 50)), F.lit(4 * part_rows))
    rows = probes.select(
        "*", F.count("*").over(key).alias("n"), F.max("own").over(key).alias("any_own"),
        F.min("h").over(key).alias("low"), F.max("h").over(key).alias("high"))
    rows = rows.where(F.col("any_own") & (F.col("low") != F.col("high")))
    rows = rows.select("key", "h", "own", F.ceil(F.col("n") / size).cast("int").alias("parts"))
    return rows.withColumn("part", F.pmod(F.xxhash64("h"), F.col("parts")).cast("int"))


def dealt(met: DataFrame) -> DataFrame:
    """Each row once for every pair ``x`` <= ``y`` of parts that its own part is in."""
    other = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return other.withColumn("x", F.least("part", "other")).withColumn(
        "y", F.greatest("part", "other"))


def repeated_lines(docs: DataFrame, *, edits: int = 2, least: int = 24, id_col: str = "doc_id",
                   text_col: str = "text", part_rows: int = 500) -> DataFrame:
    """The lines to drop: ``id``, ``c`` (hash of the text), ``at`` (line from 0) and ``kind``.

    Of equal lines all but the first go (``exact``), the first being that of the smallest id, then
    place. A line goes as ``near`` if an earlier line differs from it in at most ``edits``
    characters, whether that one goes or not. Lines below ``least`` characters stay. Distinct
    lines are found by one aggregate, so a common line is one line thereafter. The lines that meet
    in a segment are compared where they meet, in pairs of parts of about ``part_rows`` lines if
    they are many; no row is made for a pair that is not close, and no task holds more lines of a
    segment than two parts. Each of n lines that meet is sent once for every part, so the rows sent
    grow as n * n / ``part_rows`` (a fourth of that for the largest n). A line is known by
    63 bits, and two lines that agree in them but not in 64 more are both left as they are.

    Null texts have no lines; repeated rows (same id and text) count as one document; null ids
    come first. An empty table gives no rows. Other columns are not read.
    """
    docs = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = line_rows(docs, least)
    distinct = rows.groupBy("h").agg(F.min(F.struct("id", "c", "at", "line")).alias("m"))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lines = batch["h"].to_numpy(zero_copy_only=False), batch["line"].to_pylist()
            for a in range(0, len(lines), 1500):
                who, key, own = segment_keys(lines[a:a + 1500], edits)
                # The lowest bit of h tells own segments: a row is two numbers.
                h = ids[a + who.astype(np.int64)] & ~np.int64(1) | own.astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.astype(np.int64)), pa.array(h)], names=["key", "h"])

    probes = distinct.select("h", F.col("m.line").alias("line")).mapInArrow(
        keys, "key long, h long")
    met = meetings(probes, part_rows).withColumnRenamed("h", "mh")
    met = dealt(met.join(distinct, F.col("mh") == F.col("h"))).select(
        "key", "x", "y", "part", "own", "h", "m.id", "m.c", "m.at", "m.line")
    names = met.columns
    met = met.repartition(parts, "key", "x", "y").sortWithinPartitions("key", "x", "y")

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, group = None, []
        for batch in batches:
            found = []
            for row in zip(*[batch[c].to_pylist() for c in names], strict=True):
                if row[:3] != place:
                    found += later_lines(group, edits)
                    place, group = row[:3], []
                group.append(row[3:])
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], names=["h"])
        yield pa.RecordBatch.from_arrays(
            [pa.array(later_lines(group, edits), pa.int64())], names=["h"])

    near = met.mapInArrow(confirm, "h long").distinct().withColumn("near", F.lit(True))
    marked = distinct.select("h", F.struct("m.id", "m.c", "m.at", F.xxhash64(
        F.lit(1), "m.line").alias("g")).alias("m")).join(near, "h", "left").withColumnRenamed(
        "h", "fh")
    # Both sides are dealt by h alone: the other hash is no key of the join.
    same = F.col("g").bitwiseXOR(F.col("m.g")) == 0
    found = rows.select("id", "c", "at", "h", "g").join(
        marked, (F.col("h") == F.col("fh")) & same)
    is_first = (F.col("id").eqNullSafe(F.col("m.id")) & (F.col("c") == F.col("m.c"))
                & (F.col("at") == F.col("m.at")))
    kind = F.when(~is_first, F.lit("exact")).when(F.col("near"), F.lit("near"))
    return found.select("id", "c", "at", kind.alias("kind")).where(
        F.col("kind").isNotNull()).distinct()


def dropped_by_document(drops: DataFrame) -> DataFrame:
    """``rid``, ``rc``, ``exact`` and ``near``: the dropped line numbers of each text, ascending."""
    def places(kind: str):
        return F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.col("at"))))

    return drops.groupBy(F.col("id").alias("rid"), F.col("c").alias("rc")).agg(
        places("exact").alias("exact"), places("near").alias("near"))


def deduplicate_lines(docs: DataFrame, *, edits: int = 2, least: int = 24,
                      id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the repeated lines taken out of the text; texts left without any line go.

    A text none of whose lines is dropped stays as it is, also if null or empty. Other columns are
    kept, whatever their names. See ``repeated_lines``.
    """
    by_doc = dropped_by_document(repeated_lines(docs, edits=edits, least=least, id_col=id_col,
                                                text_col=text_col))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"))
    own = F.col("doc")[text_col]
    joined = rows.join(by_doc, F.col("doc")[id_col].eqNullSafe(F.col("rid"))
                       & (F.xxhash64(own) == F.col("rc")), "left")
    gone = F.concat("exact", "near")
    lines = F.filter(F.split(own, "\n", -1), lambda x, i: ~F.array_contains(gone, i))
    joined = joined.select("doc", F.when(F.col("rc").isNotNull(), lines).alias("lines"))
    joined = joined.where(F.col("lines").isNull() | F.exists(
        "lines", lambda x: F.length(F.trim(x)) > 0))
    text = F.coalesce(F.array_join("lines", "\n"), own)
    return joined.select(*[text.alias(c) if c == text_col else F.col("doc")[c].alias(c)
                           for c in docs.columns])
