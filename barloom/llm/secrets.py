"""Secret scans through a trigram index, with built-in functions only.

Each rule's regular expression gives a Boolean query of trigrams that every match must contain.
The index holds one posting (trigram, document) for each trigram that any rule asks for; a rule's
candidates are the documents whose postings satisfy its query. Rules without a mandatory trigram
scan all documents.
"""

from __future__ import annotations

import re._constants as op
import re._parser as parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A query is True (no trigram is mandatory), a trigram, or ("and" | "or", queries).
Query = bool | str | tuple


@dataclass(frozen=True)
class Rule:
    """A kind of secret: a pattern, and the least length of one of its groups."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: The kinds whose spans are contractual.
BASE_RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
         r"""([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    # A run of at least 32 is the same as a whole run, kept if it has 32.
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),
)
#: Public token formats.
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
)


def _all_of(parts: list[Query]) -> Query:
    parts = list(dict.fromkeys(p for p in parts if p is not True))
    return True if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))


def _any_of(parts: list[Query]) -> Query:
    parts = list(dict.fromkeys(parts))
    if not parts or True in parts:
        return True
    held = [set(p[1]) if isinstance(p, tuple) and p[0] == "and" else {p} for p in parts]
    parts = [p for p, h in zip(parts, held, strict=True) if not any(g < h for g in held)]
    return parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _of_strings(strings: set[str]) -> Query:
    """What a text must contain to hold one of the strings."""
    return _any_of([_all_of([s[i:i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])


def trigram_query(pattern: str, most: int = 64) -> Query:
    """The Boolean query of lower-case trigrams that every match of ``pattern`` satisfies.

    Runs of elements with few alternatives are kept as exact strings; an element with more ends
    the run, whose strings then give their trigrams.
    """
    def exact(tree) -> set[str] | None:
        found = {""}
        for kind, value in tree:
            strings = one(kind, value)
            if strings is None or len(found) * len(strings) > most:
                return None
            found = {a + b for a in found for b in strings}
        return found

    def one(kind, value) -> set[str] | None:
        if kind is op.LITERAL:
            return {chr(value).lower()}
        if kind is op.AT:
            return {""}
        if kind is op.IN and all(k is op.LITERAL for k, _ in value):
            return {chr(v).lower() for _, v in value}
        if kind is op.SUBPATTERN:
            return exact(value[3])
        if kind is op.BRANCH:
            parts = [exact(branch) for branch in value[1]]
            return None if None in parts else set().union(*parts)
        if kind is op.MAX_REPEAT and value[1] is not op.MAXREPEAT and value[1] <= 4:
            part = exact(value[2])
            if part is None:
                return None
            return {s for n in range(value[0], value[1] + 1) for s in
                    (p * n for p in part)} if len(part) == 1 or value[1] == 1 else None
        return None

    def walk(tree) -> Query:
        found, run = [], {""}
        for kind, value in tree:
            strings = one(kind, value)
            if strings is not None and len(run) * len(strings) <= most:
                run = {a + b for a in run for b in strings}
                continue
            found.append(_of_strings(run))
            run = {""} if strings is None else strings
            if strings is None and kind is op.SUBPATTERN:
                found.append(walk(value[3]))
            elif strings is None and kind is op.BRANCH:
                found.append(_any_of([walk(branch) for branch in value[1]]))
            elif strings is None and kind is op.MAX_REPEAT and value[0] > 0:
                found.append(walk(value[2]))
        return _all_of([*found, _of_strings(run)])

    return walk(parser.parse(pattern))


def trigrams_of(query: Query) -> set[str]:
    if isinstance(query, tuple):
        return set().union(*map(trigrams_of, query[1]))
    return set() if query is True else {query}


def build_index(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """Postings: ``trigram`` and the document's ``key`` (id and content hash), each pair once a row.

    A posting is made for each of ``trigrams`` that the lower-cased text contains.
    """
    held = F.transform(F.array(F.lower("text")), lambda low: F.filter(
        F.array(*map(F.lit, trigrams)), lambda t: F.contains(low, t)))[0]
    return docs.select("id", F.xxhash64("text").alias("content"), F.explode(held).alias("trigram"))


def candidates(index: DataFrame, queries: dict[str, Query]) -> DataFrame:
    """Documents whose postings satisfy a rule's query, with the ``rules`` they are candidates of.

    Postings of a document meet by a map-side aggregate into one flag per trigram.
    """
    wanted = sorted(set().union(*map(trigrams_of, queries.values())))
    name = {t: f"t{i}" for i, t in enumerate(wanted)}

    def holds(query: Query) -> Column:
        if not isinstance(query, tuple):
            return F.col(name[query])
        parts = [holds(q) for q in query[1]]
        out = parts[0]
        for part in parts[1:]:
            out = out & part if query[0] == "and" else out | part
        return out

    flags = index.groupBy("id", "content").agg(*[
        F.max(F.col("trigram") == t).alias(name[t]) for t in wanted])
    rules = F.array_compact(F.array(*[
        F.when(holds(q), F.lit(kind)) for kind, q in queries.items()]))
    return flags.select("id", "content", rules.alias("rules")).where(F.size("rules") > 0)


def matches(text: Column, rule: Rule) -> Column:
    """Spans (start, end, kind) of a rule's matches, leftmost first and without overlap.

    The pieces between matches and the matches themselves add up to the text, so running sums of
    their lengths are the positions, in code points.
    """
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    group = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    parts = F.split(text, rule.pattern, -1)
    steps = F.zip_with(parts, whole, lambda p, m: F.struct(
        F.length(p).alias("gap"), F.coalesce(F.length(m), F.lit(0)).alias("size")))
    if rule.group:
        steps = F.zip_with(steps, group, lambda s, g: F.struct(
            s["gap"].alias("gap"), s["size"].alias("size"),
            F.coalesce(F.length(g), F.lit(0)).alias("judged")))
    judged = "judged" if rule.group else "size"
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,e:int>>").alias("out"))

    def add(state: Column, step: Column) -> Column:
        begin = state["at"] + step["gap"]
        end = begin + step["size"]
        span = F.array(F.struct(begin.alias("s"), end.alias("e")))
        return F.struct(end.alias("at"), F.when(
            (step["size"] > 0) & (step[judged] >= rule.least), F.concat(state["out"], span))
            .otherwise(state["out"]).alias("out"))

    spans = F.aggregate(steps, start, add, lambda s: s["out"])
    return F.when(F.size(whole) > 0, spans).otherwise(
        F.array().cast("array<struct<s:int,e:int>>"))


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES, *,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``spans``: an array of (start, end, kind, at), ordered by start, then rule.

    ``start`` and ``end`` are code points, ``end`` exclusive; ``at`` is the rule's position. Null
    texts read as empty; repeated rows and null ids are kept; other columns are not read; an empty
    table gives no rows.
    """
    docs = docs.select(docs[id_col].alias("id"),
                       F.coalesce(docs[text_col], F.lit("")).alias("text"))
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    indexed = {k: q for k, q in queries.items() if q is not True}
    index = build_index(docs, sorted(set().union(*map(trigrams_of, indexed.values()))))
    found = candidates(index, indexed)
    docs = docs.withColumn("content", F.xxhash64("text"))
    docs = docs.join(found.withColumnRenamed("id", "cid").withColumnRenamed(
        "content", "ccontent"), F.col("id").eqNullSafe(F.col("cid"))
        & (F.col("content") == F.col("ccontent")), "left")

    def spans_of(at: int, rule: Rule) -> Column:
        got = matches(F.col("text"), rule)
        if rule.kind in indexed:
            got = F.when(F.array_contains("rules", rule.kind), got).otherwise(
                F.array().cast("array<struct<s:int,e:int>>"))
        return F.transform(got, lambda s: F.struct(
            s["s"].alias("start"), F.lit(at).alias("at"), s["e"].alias("end"),
            F.lit(rule.kind).alias("kind")))

    spans = [spans_of(at, rule) for at, rule in enumerate(rules)]
    return docs.select(F.col("id").alias("doc_id"),
                       F.array_sort(F.concat(*spans)).alias("spans"))
