"""Language identification by cross-parsing texts against suffix automata of labelled text."""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNKNOWN = "und"


def fold(text: str) -> str:
    """Lower-cased letters with one space for each run of anything else, and around all."""
    text = text.lower()
    if text.isascii():
        kept = text.translate(_ASCII)
    else:
        kept = "".join([c if c.isalpha() else " " for c in text])
    return f" {' '.join(kept.split())} "


_ASCII = {i: " " for i in range(128) if not chr(i).isalpha()}


_DIGITS = "0123456789abcdef"
# Texts parsed at a time; with at most so many (text, language) pairs a step of numpy
# costs more than what it computes.
AT_ONCE, FEW = 1000, 64


def sizes_of(text: str, symbols: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per character: its code point, its own symbol (0 if it is spelt), and its symbols' number."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    own = np.zeros(int(codes.max(initial=0)) + 1, np.uint8)
    for char, symbol in symbols.items():
        if ord(char) < len(own):
            own[ord(char)] = symbol
    found = own[codes]
    sizes = np.ones(len(codes), np.uint8)
    rare = np.flatnonzero(found == 0)
    sizes[rare] = np.where(codes[rare] < 1 << 16, 4, 6)
    return codes, found, sizes


def spelt(text: str, symbols: dict[str, int]) -> np.ndarray:
    """A text as symbols: one for each character of ``symbols``, the hex digits (0 to 15) of its
    code point, four or six, for any other."""
    codes, found, sizes = sizes_of(text, symbols)
    rare = np.flatnonzero(found == 0)
    if not len(rare):
        return found
    out, ends = np.repeat(found, sizes), np.cumsum(sizes, dtype=np.int64)
    for digit in range(6):
        at = rare[sizes[rare] > digit]
        out[ends[at] - 1 - digit] = codes[at] >> np.uint32(4 * digit) & np.uint32(15)
    return out


def automaton(text: np.ndarray, width: int) -> np.ndarray:
    """The suffix automaton of a text of symbols as a table [state, symbol] of states, -1 where
    there is none. It has at most twice as many states as symbols."""
    blank = array("i", [-1]) * width
    table = array("i", blank)
    link, length, last = [-1], [0], 0
    for symbol in text.tolist():
        existing = table[last * width + symbol]
        if existing >= 0 and length[existing] == length[last] + 1:
            last = existing
            continue
        cur = len(length)
        table.extend(blank)
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and table[p * width + symbol] < 0:
            table[p * width + symbol] = cur
            p = link[p]
        if p >= 0:
            q = table[p * width + symbol]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                clone = len(length)
                table.extend(table[q * width:(q + 1) * width])
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and table[p * width + symbol] == q:
                    table[p * width + symbol] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return np.frombuffer(table, np.int32).reshape(-1, width)


@dataclass
class LanguageModel:
    """One table of all languages: from a state and a symbol to the next state, with a flag.

    A state is where its row begins, and a row has one column for each symbol of its language and
    one for all others: ``steps[state + columns[language, symbol]]`` is ``2 * next + ended``;
    ``ended`` is 1 where no longer match exists, so that a phrase ends and the next one begins with
    this symbol.
    """

    languages: list[str]
    symbols: dict[str, int]
    steps: np.ndarray
    roots: np.ndarray
    columns: np.ndarray

    factors: np.ndarray

    @classmethod
    def fit(cls, texts: dict[str, list[str]], chars: int, direct: int = 62) -> LanguageModel:
        """``texts``: labelled texts by language, of which ``chars`` folded characters are read.

        The ``direct`` most frequent characters are symbols of their own; every other one, learned
        or not, is spelt by the hex digits of its code point, which are symbols too. So no
        character is lost, and the table's width does not grow with the scripts.

        A language with less text has a smaller automaton, which needs more phrases. Its counts
        are multiplied by what that costs others: phrases of unseen text of the languages with more
        text, parsed by their whole automaton, over those by one of as little text. Where no language has
        text beyond ``chars``, the longest keeps back a tenth for that.
        """
        folded = {lang: "".join(map(fold, parts)) for lang, parts in sorted(texts.items())}
        rest = {lang: text[chars:chars + 10_000] for lang, text in folded.items()}
        folded = {lang: text[:chars] for lang, text in folded.items()}
        if folded and not any(rest.values()):  # the longest keeps a tenth back
            lang = max(folded, key=lambda k: len(folded[k]))
            cut = len(folded[lang]) - len(folded[lang]) // 10
            folded[lang], rest[lang] = folded[lang][:cut], folded[lang][cut:]
        counts = Counter()
        for text in folded.values():
            counts.update(text)
        common = sorted(counts, key=lambda c: (-counts[c], c))[:direct]
        symbols = {c: i + len(_DIGITS) for i, c in enumerate(sorted(common))}
        model = cls._of(folded, symbols)
        for i, text in enumerate(folded.values()):
            known = [k for k in folded if rest[k] and len(folded[k]) > len(text)]
            if known:
                # One language at a time, so that the driver holds one small table beside the model.
                less = sum(cls._of({k: folded[k][:len(text)]}, symbols).phrases([rest[k]])[0, 0]
                           for k in known)
                own = [model.languages.index(k) for k in known]
                whole = model.phrases([rest[k] for k in known])[np.arange(len(known)), own]
                model.factors[i] = whole.sum() / less
        return model

    @classmethod
    def _of(cls, folded: dict[str, str], symbols: dict[str, int]) -> LanguageModel:
        coded = [spelt(text, symbols) for text in folded.values()]
        columns = np.empty((len(coded), len(_DIGITS) + len(symbols)), np.uint8)
        widths = []
        for own, text in zip(columns, coded, strict=True):
            present = np.unique(text)
            own[:] = len(present)
            own[present] = np.arange(len(present))
            widths.append(len(present) + 1)
        # The tables are laid into one array of the most states there can be; what stays unused is
        # never touched and takes no memory.
        steps = np.empty(sum(w * (2 * len(t) + 2) for w, t in zip(widths, coded)), np.int32)
        roots, base = [], 0
        for symbol, text, width in zip(columns, coded, widths, strict=True):
            table = automaton(symbol[text], width)
            dead = len(table)  # follows a symbol the text lacks
            end = base + (dead + 1) * width
            missing, own = table < 0, steps[base:end].reshape(-1, width)
            own[dead] = np.where(table[0] >= 0, table[0], dead)
            own[:dead] = np.where(missing, own[dead], table)
            missing[0] = False  # no phrase ends before the first symbol
            own *= width
            own += base
            own *= 2
            own[:dead] += missing
            own[dead] += 1
            roots.append(base)
            base = end
        return cls(list(folded), symbols, steps[:base], np.array(roots, np.int64), columns,
                   np.ones(len(folded)))

    def phrases(self, texts: list[str]) -> np.ndarray:
        """Phrases that each text needs against each language, of folded texts.

        All texts advance together, one symbol at a time, longest first; the last few go on alone.
        """
        # Longest first; a text takes as many symbols as its characters are spelt with.
        sizes = [int(sizes_of(t, self.symbols)[2].sum(dtype=np.int64)) for t in texts]
        order = np.argsort(-np.array(sizes, np.int64), kind="stable")
        lengths = np.array(sizes, np.int64)[order]
        codes = spelt("".join(texts[i] for i in order), self.symbols)
        begins = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        longest = int(lengths.max(initial=0))
        alive = np.searchsorted(-lengths, -np.arange(longest), side="left")
        count = len(self.languages)
        states = np.tile(self.roots.astype(np.int32), (len(texts), 1))
        ended = np.zeros((len(texts), count), np.int32)
        columns, at = self.columns.T.copy(), 0
        while at < longest and alive[at] * count > FEW:
            n = alive[at]
            step = self.steps[states[:n] + columns[codes[begins[:n] + at]]]
            ended[:n] += step & 1
            np.right_shift(step, 1, out=states[:n])
            at += 1
        steps = memoryview(self.steps)
        for i in range(alive[at] if at < longest else 0):
            left = codes[begins[i] + at:begins[i] + lengths[i]]
            for k in range(count):
                state, more = int(states[i, k]), 0
                for column in self.columns[k][left].tobytes():
                    step = steps[state + column]
                    more += step & 1
                    state = step >> 1
                ended[i, k] += more
        out = np.zeros((len(texts), count), np.int64)
        out[order] = ended + (lengths > 0)[:, None]
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The language that needs the fewest phrases, and 1 less its share of the runner-up's.

        Ties go to the first language by name; a text without a letter is ``und`` with score 0.
        """
        folded = [fold(t) if t else " " for t in texts]
        known = np.array([bool(t.strip()) for t in folded])
        names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        at = np.flatnonzero(known)
        if len(at) and self.languages:
            phrases = self.phrases([folded[i] for i in at]) * self.factors
            best = phrases.argmin(axis=1)
            least = phrases[np.arange(len(at)), best]
            second = (np.sort(phrases, axis=1)[:, 1] if phrases.shape[1] > 1
                      else np.full(len(at), np.inf))
            scores[at] = np.where(second > 0, 1 - least / second, 0.0)
            for i, b in zip(at, best, strict=True):
                names[i] = self.languages[b]
        return names, scores


def fit_languages(labelled: DataFrame, *, lang_col: str = "lang", text_col: str = "text",
                  id_col: str = "doc_id", sample: int = 60, chars: int = 60_000,
                  sample_chars: int = 8_000) -> LanguageModel:
    """A model of a bounded sample of labelled rows; no rows give a model that knows no language.

    Of each language the ``sample`` rows of lowest id hash are read, whole texts of at most
    ``sample_chars`` characters first (a longer one is cut to that), and of those ``chars`` folded
    characters in all: at most ``sample * sample_chars`` characters a language reach the driver.
    Rows without a language or text are not read.
    """
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(lang_col).alias("lang"), F.xxhash64(id_col).alias("h"),
                       (F.length(text_col) > sample_chars).alias("long"),
                       F.substring(text_col, 1, sample_chars).alias("text"))
    order = Window.partitionBy("lang").orderBy("long", "h", "text")
    rows = rows.withColumn("at", F.row_number().over(order)).where(F.col("at") <= sample)
    texts: dict[str, list[str]] = {}
    for row in rows.orderBy("lang", "at").collect():
        texts.setdefault(row["lang"], []).append(row["text"])
    return LanguageModel.fit(texts, chars)


def identify_languages(docs: DataFrame, model: LanguageModel, *, text_col: str = "text",
                       lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """``docs`` with the predicted language and its score in front (columns in a struct ``doc``).

    Whole texts are parsed. A null text, or one without a letter, is ``und`` with score 0. Repeated
    rows get equal results; an empty table gives no rows; the columns of ``docs`` stay inside
    ``doc``, so their names cannot clash.
    """
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"))
    schema = T.StructType([rows.schema["doc"], T.StructField(lang_out, T.StringType()),
                           T.StructField(score_out, T.DoubleType())])
    text_at = next(i for same in (str, str.lower) for i, c in enumerate(docs.columns)
                   if same(c) == same(text_col))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for batch in batches:
            for a in range(0, batch.num_rows, AT_ONCE):
                part = batch["doc"].slice(a, AT_ONCE)
                # The text goes to Python once, inside its row; no list of a whole batch is held.
                names, scores = held.predict(pc.struct_field(part, text_at).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part, pa.array(names, pa.string()), pa.array(scores)],
                    names=["doc", lang_out, score_out])

    return rows.mapInArrow(run, schema)


def fold_of(id_col: Column) -> Column:
    """The fold of a document: crc32 of its id as text, modulo 4."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")), F.lit(0)) % 4
