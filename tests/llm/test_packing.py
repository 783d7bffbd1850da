"""Packing: every id in exactly one piece, little padding, balanced cost."""

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from barloom.llm.packing import Tokens, balance, pack_documents

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def rebuilt(rows):
    docs = {}
    for r in rows:
        docs.setdefault(r["doc_id"], []).append(r)
    out = {}
    for doc, pieces in docs.items():
        pieces.sort(key=lambda r: r["start"])
        at = 0
        for p in pieces:
            assert p["start"] == at
            at += p["length"]
        assert at == pieces[0]["doc_tokens"]
        out[doc] = np.frombuffer(b"".join(p["ids"] for p in pieces), "<u4").tolist()
    return out


def test_every_id_is_in_one_piece(spark):
    texts = {1: "plain words here", 2: "", 3: None, 4: "long " * 3000, 5: "<|endoftext|> x",
             6: "  two  spaces\n\nand lines \t", 7: "Ünïcödé ñandú " * 40, None: "no id"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = pack_documents(df, TOKENIZER, ranks=RANKS, capacity=64).collect()
    plain = Tokens(TOKENIZER)
    for doc, ids in rebuilt(rows).items():
        assert ids == plain.slow(texts[doc] or "") + [0]
    ends = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert ends.get(r["sequence_id"], 0) == r["offset"]
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(ends.values()) <= 64


def test_one_block_pads_less_than_one_sequence(spark):
    df = spark.range(400).select(F.col("id").alias("doc_id"), F.expr(
        "repeat('word ', cast(id % 37 as int))").alias("text")).coalesce(1)
    rows = pack_documents(df, TOKENIZER, ranks=RANKS, capacity=128).collect()
    used = sum(r["length"] for r in rows)
    assert 128 * len({r["sequence_id"] for r in rows}) - used < 128


def test_repeated_rows_clashing_columns_and_empty_table(spark):
    df = spark.createDataFrame([(1, "same", 5, 6)] * 3,
                               "doc_id long, text string, length int, sequence_id int")
    rows = pack_documents(df, TOKENIZER).collect()
    assert len(rows) == 3 and {r["doc_id"] for r in rows} == {1}
    assert pack_documents(df.limit(0), TOKENIZER).count() == 0


def test_costs_are_balanced():
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 100, 500)
    pieces = balance(lengths, 100, 1.0, 0.01)
    cost = {}
    for _, _, size, to, _ in pieces:
        cost[to] = cost.get(to, 0) + size + 0.01 * size * size
    assert sum(p[2] for p in pieces) == lengths.sum()
    assert max(cost.values()) <= 2.2 * np.mean(list(cost.values()))


def test_other_vocabulary_is_refused():
    with pytest.raises(ValueError):
        Tokens(TOKENIZER, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))("some words")
