"""Toxicity of texts after noisy-channel restoration of disguised words."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .words import distinct, slices, utf8

#: What a written character may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b",
        "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "*": "aeiou"}
_LETTERS = 27  # space or other, a to z
_GAPS = " .-_"
_LEET = re.escape("".join(LEET))
_LETTER, _PLAIN = r"[^\W\d_]", r"[^\W_]"  # a letter; a letter or digit
_GAP = f"[{re.escape(_GAPS)}]{{1,2}}"
_UNIT = f"(?:{_LETTER}|[{_LEET}])"
#: Symbols before or after letters, a letter thrice, letters or symbols standing alone.
#: ``suspects`` marks what this matches.
_DISGUISE = re.compile(
    rf"(?<!{_LETTER}){_LETTER}*+(?:[{_LEET}]+{_LETTER}++)+[{_LEET}]*"
    + rf"|(?<!{_LETTER}){_LETTER}++[{_LEET}]+"
    + rf"|{_LETTER}*({_LETTER})\1\1{_LETTER}*"
    + rf"|(?<!{_PLAIN}){_UNIT}(?:{_GAP}{_UNIT}(?!{_PLAIN})){{3,}}")
_HAS_LETTER = re.compile(_LETTER).search

_BYTE = np.zeros(256, np.uint8)  # 1 letter, 2 leet symbol, 3 gap
_BYTE[97:123] = _BYTE[65:91] = 1
_BYTE[128:] = 1
for _c in LEET:
    _BYTE[ord(_c)] = 2
for _c in _GAPS:
    _BYTE[ord(_c)] = 3
_CODE = np.zeros(256, np.int64)
_CODE[97:123] = _CODE[65:91] = np.arange(1, 27)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_KEEP = np.where(_BYTE == 1, _LOWER, 32).astype(np.uint8)


_KNOWN = 64  # longest disguise whose reading is remembered


def trigram_counts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Character trigrams of all texts, as an array [27, 27, 27]; 0 is any non-letter.

    Each task sends at most 27**3 sums, and so does the shuffle to the driver.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_LETTERS ** 3, np.int64)
        for batch in batches:
            data, offsets = utf8(batch["text"])
            for a, b in slices(offsets):
                code = _CODE[data[offsets[a]:offsets[b]]]
                if len(code) > 2:
                    total += np.bincount((code[:-2] * _LETTERS + code[1:-1]) * _LETTERS
                                         + code[2:], minlength=_LETTERS ** 3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["code", "n"])

    rows = docs.select(docs[text_col].alias("text")).mapInArrow(count, "code long, n long")
    out = np.zeros(_LETTERS ** 3)
    for row in rows.groupBy("code").agg(F.sum("n").alias("n")).collect():
        out[row["code"]] = row["n"]
    return out.reshape(_LETTERS, _LETTERS, _LETTERS)


def language_model(counts: np.ndarray) -> np.ndarray:
    """Log-probabilities of a letter after two others, backed off to shorter contexts."""
    one = counts.sum(axis=(0, 1)) + 1
    one = one / one.sum()
    two = counts.sum(axis=0) + 50 * one
    two = two / two.sum(axis=1, keepdims=True)
    three = counts + 50 * two[None]
    return np.log(three / three.sum(axis=2, keepdims=True))


def spelled(chain: tuple | None) -> str:
    parts = []
    while chain is not None:
        chain, letters = chain
        parts.append(letters)
    return "".join(reversed(parts))


@dataclass
class Restorer:
    """Restores disguised words by the likeliest path through a lattice of letters.

    A symbol may stand for its letters, or for a separator that is left out (at no cost if it is an
    exclamation mark at the end); a gap between single letters is left out; a run of three or more
    equal letters stands for one or two. A disguise of any length is read as one lattice. Each reading has a channel cost; the trigram model scores
    the letters.
    """

    model: np.ndarray
    known: dict[str, str] = field(default_factory=dict)
    most: int = 100_000

    def lattice(self, word: str) -> list[list[tuple[str, float]]]:
        steps, i = [], 0
        while i < len(word):
            c, j = word[i], i
            while j < len(word) and word[j] == c:
                j += 1
            if c in LEET:
                none = 0.0 if c == "!" and j == len(word) else -6.0
                for _ in range(i, j):
                    steps.append([(o, -0.5) for o in LEET[c]] + [("", none)])
            elif c in _GAPS:
                steps.append([("", 0.0)])
            elif j - i >= 3:
                steps.append([(c, 0.0), (c + c, -1.0)])
            else:
                steps += [[(c, 0.0)]] * (j - i)
            i = j
        return steps

    def decode(self, word: str) -> str:
        """The best reading of one word; letters outside a to z stay as they are."""
        if (got := self.known.get(word)) is not None:
            return got
        # A path is its score and the chain of its readings, last first: steps cost the same
        # however long the word is.
        paths: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        for options in self.lattice(word):
            reached: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (x, y), (score, chain) in paths.items():
                for letters, cost in options:
                    p, q, total = x, y, score + cost
                    for c in letters:
                        k = ord(c) - 96 if "a" <= c <= "z" else 0
                        total += self.model[p, q, k]
                        p, q = q, k
                    old = reached.get((p, q))
                    if old is None or total > old[0]:
                        reached[p, q] = (total, (chain, letters))
            paths = reached
        best = max((score + self.model[at][0], spelled(chain))
                   for at, (score, chain) in paths.items())[1]
        if len(word) <= _KNOWN:
            if len(self.known) >= self.most:
                self.known.clear()
            self.known[word] = best
        return best

    def restore(self, text: str) -> str:
        return _DISGUISE.sub(lambda m: self.decode(m[0]) if _HAS_LETTER(m[0]) else m[0],
                             text.lower())


def characters(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each character of UTF-8 bytes begins, its lower-case code, and its kind as in _BYTE."""
    starts = np.flatnonzero((data & 0xC0) != 0x80)
    first = data[starts]
    code, kind = _LOWER[first].astype(np.int64), _BYTE[first]
    wide = np.flatnonzero(first >= 128)
    if len(wide):
        at, lead = starts[wide], first[wide]
        padded = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.int64)
        value = np.where(lead < 0xE0, lead & 0x1F, np.where(lead < 0xF0, lead & 0x0F, lead & 0x07))
        value = value.astype(np.int64)
        for i, least in ((1, 0xC0), (2, 0xE0), (3, 0xF0)):
            value = np.where(lead >= least, value << 6 | padded[at + i] & 0x3F, value)
        seen, where = np.unique(value, return_inverse=True)
        lower = [chr(v).lower()[0].replace("ς", "σ") for v in seen]
        code[wide] = np.array([ord(c) for c in lower])[where]
        kind[wide] = np.array([c.isalnum() and not c.isdecimal() for c in lower])[where]
    return starts, code, kind


def suspects(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows that may hold a symbol beside a letter, a letter thrice, or letters standing alone.

    Characters are looked at across the ends of rows, so some rows without a disguise are marked.
    """
    starts, code, kind = characters(data)
    mark = np.zeros(len(kind), bool)
    letter, leet = kind == 1, kind == 2
    mark[:-1] |= (leet[:-1] & letter[1:]) | (letter[:-1] & leet[1:])
    same = (code[1:] == code[:-1]) & letter[1:]
    mark[:-2] |= same[1:] & same[:-1]
    place = np.flatnonzero(kind != 3)
    unit = (letter | leet)[place]
    apart = np.diff(place)  # 1 or 2 gaps between two characters
    link = ((apart == 2) | (apart == 3)) & unit[:-1] & unit[1:]
    mark[place[:-3][link[:-2] & link[1:-1] & link[2:]]] = True
    total = np.concatenate([[0], np.cumsum(mark)])
    rows = total[np.searchsorted(starts, offsets)]
    return rows[1:] > rows[:-1]


def features(data: np.ndarray, offsets: np.ndarray, bits: int = 22):
    """Hashed windows of 5, 7 and 9 bytes of the letters, and each window's row.

    Other bytes read as a space, and a space stands before and after each row.
    """
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets) + 2)
    kept = np.full(len(rows), 32, np.uint8)
    kept[np.arange(len(data)) + 2 * np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
         + 1] = _KEEP[data]
    value = kept.astype(np.uint32)
    found, where = [], []
    total, size = np.zeros(len(kept), np.uint32), 0
    for width in (5, 7, 9):
        if len(kept) < width:
            break
        total = total[:len(kept) - width + 1].copy()
        for i in range(size, width):
            total = total * np.uint32(0x01000193) + value[i:i + len(total)]
        size = width
        mixed = total ^ (total >> np.uint32(15))
        mixed *= np.uint32(0x2C1B3C6D)
        same = rows[:len(total)] == rows[width - 1:]
        found.append((mixed[same] >> np.uint32(32 - bits)).astype(np.int64))
        where.append(rows[:len(total)][same])
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found), np.concatenate(where)


@dataclass
class ToxicityModel:
    """Restorer, chosen windows and their weights."""

    restorer: Restorer
    column: np.ndarray  # window -> feature, or -1
    weights: np.ndarray
    bias: float

    def restored(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, offsets = utf8(texts)
        rows = np.flatnonzero(suspects(data, offsets)) if len(data) else []
        if not len(rows):
            return data, offsets
        out = texts.to_pylist()
        for row in rows:
            out[row] = self.restorer.restore(out[row])
        return utf8(pa.array(out, pa.large_string()))

    def score(self, texts: pa.Array) -> np.ndarray:
        out = np.full(len(texts), self.bias)
        for start, end in slices(utf8(texts)[1]):
            windows, rows = features(*self.restored(texts.slice(start, end - start)))
            found = self.column[windows]
            hit = found >= 0
            pairs = distinct(rows[hit] * len(self.weights) + found[hit])
            np.add.at(out, start + pairs // len(self.weights),
                      self.weights[pairs % len(self.weights)])
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))

    @classmethod
    def fit(cls, restorer: Restorer, texts: list[str], labels: np.ndarray, most: int = 600,
            bits: int = 22) -> ToxicityModel:
        """A logistic regression on the windows whose presence tells most about the label."""
        empty = cls(restorer, np.full(1 << bits, -1, np.int32), np.zeros(1), 0.0)
        share = float(np.clip(labels.mean() if len(labels) else 0.0, 1e-3, 1 - 1e-3))
        empty.bias = math.log(share / (1 - share))
        if not len(labels) or labels.min() == labels.max():
            return empty
        good, bad = np.zeros((2, 1 << bits), np.int32)
        restored = [(at, empty.restored(pa.array(texts[at:at + 256], pa.large_string())))
                    for at in range(0, len(texts), 256)]

        def parts():
            """Distinct windows of each row, a few rows at a time."""
            for at, (data, offsets) in restored:
                for a, b in slices(offsets):
                    windows, rows = features(data[offsets[a]:offsets[b]],
                                             offsets[a:b + 1] - offsets[a], bits)
                    both = distinct((rows << bits) + windows)
                    yield at + a + (both >> bits), both & ((1 << bits) - 1)

        for rows, windows in parts():
            toxic = labels[rows] == 1
            np.add.at(good, windows[toxic], 1)
            np.add.at(bad, windows[~toxic], 1)
        ones, zeros = labels.sum(), (labels == 0).sum()
        seen = np.flatnonzero(good >= 2)
        a, b = good[seen] + 0.5, bad[seen] + 0.5
        c, d = ones - good[seen] + 0.5, zeros - bad[seen] + 0.5
        z = np.log(a * d / (b * c)) / np.sqrt(1 / a + 1 / b + 1 / c + 1 / d)
        order = np.argsort(-z, kind="stable")[:most]
        chosen = seen[order[z[order] > 2.5]]
        if not len(chosen):
            return empty
        empty.column[chosen] = np.arange(len(chosen))
        x = np.zeros((len(texts), len(chosen)), np.float32)
        for rows, windows in parts():
            at = empty.column[windows]
            x[rows[at >= 0], at[at >= 0]] = 1
        w, bias = _logistic(x, labels.astype(np.float32))
        return cls(restorer, empty.column, w, bias)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 12):
    """L2-regularised logistic regression by Newton steps."""
    x = np.concatenate([x, np.ones((len(x), 1), x.dtype)], axis=1)
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + penalty * w
        bend = (x * (p * (1 - p))[:, None].astype(np.float32)).T @ x + np.diag(penalty)
        step = np.linalg.solve(bend + 1e-6 * np.eye(len(w)), slope)
        w -= step * min(1.0, 4 / max(np.abs(step).max(), 1e-9))
    return w[:-1], float(w[-1])


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, sample: int = 12_000,
                 sample_chars: int = 20_000, id_col: str = "doc_id", text_col: str = "text",
                 label_col: str = "toxic") -> ToxicityModel:
    """A model of all documents' characters and a bounded sample of labelled ones.

    The character trigrams are counted over every text. Of ``labels`` the ``sample`` rows of lowest
    id hash are read, as far as their text has at most ``sample_chars`` characters, so at most
    ``sample * sample_chars`` characters reach the driver. Rows without a label are not read.
    """
    restorer = Restorer(language_model(trigram_counts(docs, text_col)))
    picked = labels.where(F.col(label_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).dropDuplicates(
        ["id"]).orderBy(F.xxhash64("id"), "id").limit(sample)
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).where(
        F.col("text").isNotNull() & (F.length("text") <= sample_chars)).join(
        F.broadcast(picked), F.col("doc") == F.col("id"))  # at most ``sample`` rows
    got = sorted((r["doc"], r["text"], r["label"]) for r in rows.select(
        "doc", "text", "label").toLocalIterator())
    return ToxicityModel.fit(restorer, [r[1] for r in got],
                             np.array([r[2] for r in got], np.int64))


def score_toxicity(docs: DataFrame, model: ToxicityModel, *, text_col: str = "text",
                   score_out: str = "score") -> DataFrame:
    """``docs`` in a struct ``doc``, and ``score`` from 0 to 1 of every whole text.

    Null and empty texts have the score of the share of toxic labels. Equal texts score equally;
    an empty table gives no rows; the columns of ``docs`` stay inside ``doc``.
    """
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"),
                       docs[text_col].alias("text"))
    schema = T.StructType([rows.schema["doc"], T.StructField(score_out, T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by its parameters

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch["doc"], pa.array(held.score(batch["text"]))], names=["doc", score_out])

    return rows.mapInArrow(run, schema)
