"""Queries that apply the operators to their whole tables, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ann import search
from .decontaminate import scan_windows
from .fingerprints import compare_with_next
from .importance import resample
from .language import fit_languages, fold_of, identify_languages
from .lines import dropped_by_document, repeated_lines
from .mixing import mix_sources
from .negatives import mine_negatives
from .packing import pack_documents
from .secrets import BASE_RULES, find_secrets
from .sketch import near_duplicates
from .tables import fresh_path, table
from .toxicity import fit_toxicity, score_toxicity
from .warc import assemble_transactions, read_records, warc_field, write_captures

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_cost_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack_documents(table(spark, sf_dir, "documents"), TOKENIZER, ranks=RANKS)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"),
                         "doc_tokens", "sequence_id", "offset", "cost")


@query
def op5_fast_similarity_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=80)


@query
def op2_one_permutation_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_next(table(spark, sf_dir, "documents"))


@query
def op10_entropy_balanced_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    mixed = mix_sources(docs)
    return mixed.select("doc_id", *[F.col("mix_" + c).alias(c) for c in (
        "size", "source_size", "target", "taken", "copies")])


@query
def op6_trigram_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    kinds = [r.kind for r in BASE_RULES]
    base = F.filter("spans", lambda s: s["kind"].isin(kinds))

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(
            ":", s["kind"], s["start"], s["end"])), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id", *[count(k).alias("n_" + k) for k in kinds],
        F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


@query
def op8_cross_parsing_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit_languages(docs.where(fold_of(F.col("doc_id")) != 2))
    found = identify_languages(docs.select("doc_id", "text"), model)
    return found.select("doc.doc_id", (fold_of(F.col("doc.doc_id")) == 2).alias("held_out"),
                        "lang_pred", "score")


@query
def op7_deobfuscated_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(fold_of(F.col("doc_id")) != 2)
    found = score_toxicity(docs, fit_toxicity(docs, labels))
    return found.select("doc.doc_id", (fold_of(F.col("doc.doc_id")) == 2).alias("held_out"),
                        "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query
def op9_segment_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its lines, and the numbers of those that go as exact or near repeats."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    by_doc = dropped_by_document(repeated_lines(docs))
    docs = docs.select("doc_id", F.xxhash64("text").alias("c"), F.when(
        F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n", -1))).alias("n_lines"))
    found = docs.join(by_doc, F.col("doc_id").eqNullSafe(F.col("rid"))
                      & (F.col("c") == F.col("rc")), "left")
    sizes = {k: F.coalesce(F.size(k), F.lit(0)).cast("long") for k in ("exact", "near")}
    return found.select(
        "doc_id", F.col("n_lines").cast("long").alias("n_lines"),
        sizes["exact"].alias("n_exact"), sizes["near"].alias("n_near"),
        *[F.coalesce(F.array_join(F.col(k).cast("array<string>"), ","), F.lit("")).alias(
            k + "_lines") for k in ("exact", "near")])


ORACLES["op3_transaction_assembly"] = """
with p as (select page_id, coalesce(html, '') h from pages),
d as (select page_id, h, min(page_id) over (partition by h) f, sha1(h) x from p),
b as (select page_id, f, octet_length(encode(h)) n,
             [('0x' || substr(x, 5 * i + 1, 5))::int for i in range(8)] g from d)
select page_id, n::bigint payload_bytes,
       array_to_string([array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           (q // s) % 32 + 1, 1) for s in [32768, 1024, 32, 1]], '') for q in g], '')
       payload_digest,
       case when page_id = f then 'response' else 'revisit' end record_type,
       case when page_id <> f then f end refers_to
from b
"""


@query
def op3_transaction_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    path = fresh_path(spark, "warc")
    write_captures(pages, path)
    captures = assemble_transactions(read_records(spark, path))
    facts = captures.select("main", F.col("metadata")[0]["block"].alias("facts"))
    kind = pages.schema["page_id"].dataType
    declared = F.regexp_replace("main.declared_digest", "^sha1:", "")
    refers = F.regexp_extract("main.refers_to", "^<urn:capture:(.*):[^:]*:main>$", 1)
    return facts.select(
        warc_field(F.col("facts"), "page-id").cast(kind).alias("page_id"),
        F.coalesce("main.payload_bytes", warc_field(F.col("facts"), "payload-length").cast("long"))
        .alias("payload_bytes"),
        F.coalesce("main.payload_digest", declared).alias("payload_digest"),
        F.col("main.type").alias("record_type"),
        F.when(F.col("main.type") == "revisit", refers).cast(kind).alias("refers_to"))


@query
def op4_adaptive_dimension_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(vectors, vectors.where(F.col("vec_id") % 20 == 0))


_WORDS = r"""regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

ORACLES["op11_segment_importance_resampling"] = f"""
with d as (select row_number() over () r, doc_id, coalesce({_WORDS}, []) w from documents),
b as (select coalesce({_WORDS}, []) w from benchmark),
v as (select distinct unnest(w) x from (select w from d union all select w from b)),
crc as (select list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
            lambda c, k: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end)) t),
k as (select x, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(
            range(octet_length(encode(x))),
            lambda i: ('0x' || substr(hex(encode(x)), (2 * i + 1)::int, 2))::bigint)),
            lambda c, o: xor(t[(xor(c, o) & 255) + 1], c // 256)), 4294967295) % 10000 g
      from v, crc),
dw as (select r, g from (select r, unnest(w) x from d) join k using (x)),
s as (select g, count(*) s from dw group by g),
t as (select g, count(*) t from (select unnest(w) x from b) join k using (x) group by g),
gain as (select g, floor(1000 * ln((coalesce(t, 0) + 1)
                 * ((select coalesce(sum(s), 0) from s) + 10000)::double
                 / ((coalesce(s, 0) + 1)
                 * ((select coalesce(sum(t), 0) from t) + 10000)::double)))::bigint q
         from s left join t using (g)),
doc as (select r, any_value(doc_id) doc_id, count(g)::bigint n_features,
               coalesce(sum(q), 0)::bigint weight
        from d left join dw using (r) left join gain using (g) group by r),
scored as (select *, weight + floor(-1000 * ln(-ln((('0x' || substr(sha256(
               '2024:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint + 0.5::double)
               / 4294967296)))::bigint score from doc),
ranked as (select *, row_number() over (partition by n_features >= 20
               order by score desc, doc_id) k,
               count(*) over (partition by n_features >= 20) n from scored)
select doc_id, n_features, weight, score,
       case when n_features >= 20 and k <= 10 * n // 100 then k end as rank
from ranked
"""


@query
def op11_segment_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


ORACLES["op12_ngram_decontamination"] = f"""
with d as (select row_number() over () r, doc_id, coalesce({_WORDS}, []) w from documents),
i as (select item_id, {_WORDS} w from benchmark),
n as (select item_id, least(len(w), 10) n, w from i where len(w) > 0),
iw as (select distinct item_id, n, array_to_string(w[p:p + n - 1], ' ') x
       from (select *, unnest(range(1, len(w) - n + 2)) p from n)),
dw as (select r, p, n, array_to_string(w[p:p + n - 1], ' ') x
       from (select r, w, n, unnest(range(1, len(w) - n + 2)) p
             from d, (select distinct n from iw))),
h as (select r, p, n, item_id from dw join iw using (n, x)),
hit as (select r, count(distinct q) n_hit
        from (select r, unnest(range(p, p + n)) q from (select distinct r, p, n from h))
        group by r),
it as (select r, count(*) n_items, sha256(string_agg(x, ',' order by x)) z
       from (select distinct r, item_id::varchar x from h where item_id is not null) group by r)
select doc_id, len(w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit,
       coalesce(n_items, 0)::bigint n_items, coalesce(z, sha256('')) items_sha256,
       coalesce(n_hit, 0) > 0 contaminated
from d left join hit using (r) left join it using (r)
"""


@query
def op12_ngram_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_windows(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc.doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))


ORACLES["op13_secondary_sort_negatives"] = """
with v as (select row_number() over () r, vec_id,
                  case when vec_id % 7 = 0 then (label + 1) % 10 else label end l,
                  list_transform(embedding, lambda x: floor(256 * x::double)) e
           from embeddings
           where vec_id is not null and label is not null and embedding is not null
             and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.r ar, b.r br, a.vec_id anchor_id, b.vec_id id, a.l = b.l same,
             list_dot_product(a.e, b.e)::bigint s
      from v a, v b where a.vec_id % 100 = 0 and a.r <> b.r and len(a.e) = len(b.e)),
p as (select *, row_number() over (partition by ar order by s desc, id, br) k
      from s where same),
n as (select p.anchor_id, p.id positive_id, n.id negative_id, p.s positive_score,
             n.s negative_score,
             row_number() over (partition by p.ar, p.br order by n.s desc, n.id, n.br) as rank
      from p join s n on p.ar = n.ar and p.k <= 5 and not n.same
             and 80 * p.s <= 100 * n.s and 100 * n.s <= 100 * p.s)
select anchor_id, positive_id, rank::int as rank, negative_id, positive_score, negative_score
from n where rank <= 5
"""


@query
def op13_secondary_sort_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_negatives(table(spark, sf_dir, "embeddings"), label=moved)
