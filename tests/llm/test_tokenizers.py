"""Token counts and SentencePiece coding against the public libraries, and the defined edge cases."""

import hashlib

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessera.llm import bpe
from tessera.llm.sentencepiece_codec import chunk_table, encode
from tessera.llm.token_counts import count_tokens, counter

WORDS, PIECES = P.path("word_bpe_49k.json"), P.path("piece_bpe_32k.model")
ODD = [
    "", " ", "  a", "a ", "a▁b ▁▁", "\x00a\x85 b\x1c\x1dc", "é😀\n\n  x", "<s></s><unk> <0x0A>", "ΑΣ ΣΑΣ ς", "İstanbul ŒUVRE ﬁn ẞ", "I'll don't 'S 'RE x's",
    "<|endoftext|>a<|startoftext|><|endoftext|> <|ENDOFTEXT|>", "é ̈́ Ω", "123 ٣٤ ⅷ ½", "a\tb\r\nc\x0bd", "x" * 5000, "ab " * 3000, "　  ​﻿", "中文字符 テスト", "Â\U0003d000b \u0558c\U00010d50\U00010d41\ua7ce9", "𐐀𐐁 Ⅳ ǅ",
]
text = st.text(st.one_of(st.characters(exclude_categories=("Cs",)), st.sampled_from(" ▁<|>'sStT\ńΣσ")), max_size=60)


@pytest.fixture(scope="module")
def libraries():
    return Tokenizer.from_file(WORDS), sentencepiece.SentencePieceProcessor(model_file=PIECES)


def check(x, libraries):
    assert counter(WORDS).count(x) == len(libraries[0].encode(x, add_special_tokens=False).ids), repr(x)
    ids = libraries[1].encode(x, add_bos=True, add_eos=True)
    coded, decoded = chunk_table(PIECES).code(x)
    assert np.frombuffer(coded, "<u4").tolist() == ids, repr(x)
    assert decoded == libraries[1].decode(ids), repr(x)


@pytest.mark.parametrize("x", ODD, ids=range(len(ODD)))
def test_odd_texts(x, libraries):
    check(x, libraries)


@settings(max_examples=300, deadline=None)
@given(text)
def test_any_text(libraries, x):
    check(x, libraries)


def test_merge_counts_and_order():
    ranks = {("a", "b"): 1, ("b", "c"): 0, ("a", "bc"): 2}
    symbols = list("abcab")
    assert bpe.merge(symbols, ranks.get) == 3
    assert [s for s in symbols if s] == ["abc", "ab"]


def test_tables(spark, sf_dir, libraries):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = encode(count_tokens(docs, WORDS).withColumnRenamed("n_tokens", "n_words"), PIECES).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r.n_words == len(libraries[0].encode(r.text, add_special_tokens=False).ids)
        ids = libraries[1].encode(r.text, add_bos=True, add_eos=True)
        assert (r.n_tokens, hashlib.sha256(bytes(r.ids)).digest(), r.decoded) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).digest(), libraries[1].decode(ids))


def test_edges(spark):
    rows = [(1, None, "x"), (1, "a b", "y"), (1, "a b", None), (None, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    assert [r.n_tokens for r in count_tokens(docs, WORDS).orderBy("text", "ids").collect()] == [0, 0, 2, 2]
    out = encode(docs, PIECES)
    assert out.columns == ["doc_id", "text", "n_tokens", "ids", "decoded"]
    assert sorted((r.n_tokens, r.decoded) for r in out.collect()) == [(2, ""), (2, ""), (4, "a b"), (4, "a b")]
    assert encode(docs.limit(0), PIECES).count() == 0 == count_tokens(docs.limit(0), WORDS).count()


def test_clashing_names_long_words_and_small_tables(spark, libraries, monkeypatch):
    """Columns of any name stay, results come back in slices, and tables that begin anew change nothing."""
    rows = [(i, f"text {i} " + "x" * (i % 900) + " é\n\n▁ " * (i % 3), 1, 2) for i in range(1300)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", "a.b", "_coded"]).coalesce(1)
    out = encode(docs, PIECES)
    assert out.columns == ["doc_id", "text", "a.b", "_coded", "n_tokens", "ids", "decoded"]
    for r in out.collect():
        ids = libraries[1].encode(r.text, add_bos=True, add_eos=True)
        assert (np.frombuffer(r.ids, "<u4").tolist(), r.decoded) == (ids, libraries[1].decode(ids))
    from tessera.llm import sentencepiece_codec, token_counts

    monkeypatch.setattr(sentencepiece_codec, "TABLE_BYTES", 3000)
    monkeypatch.setattr(token_counts, "TABLE_BYTES", 3000)
    table, words = sentencepiece_codec.ChunkTable(PIECES), token_counts.WordCounter(WORDS)
    for _, x, *_ in rows[::7] + rows[::5]:
        ids = libraries[1].encode(x, add_bos=True, add_eos=True)
        coded, decoded = table.code(x)
        assert (np.frombuffer(coded, "<u4").tolist(), decoded) == (ids, libraries[1].decode(ids))
        assert words.count(x) == len(libraries[0].encode(x, add_special_tokens=False).ids)
        assert table.bytes < 40_000 and words.bytes < 40_000


def test_chunks_merged_as_a_matrix(libraries):
    """Chunks of one length merged together have the ids that each has alone; letters without a piece and few or long chunks go alone."""
    import random

    from tessera.llm.sentencepiece_codec import ChunkTable

    draw, table = random.Random(5), ChunkTable(PIECES)
    chunks = {"".join(draw.choices("▁etaoinshrdluéaab中", k=draw.choice([1, 2, 3, 5, 8, 8, 13, 39, 60]))) for _ in range(3000)}
    got = {c: (packed, other) for c, packed, other in table.segmented(chunks)}
    assert got.keys() == chunks and sum(not other for _, other in got.values()) > 1000
    for c, (packed, _) in got.items():
        assert np.frombuffer(packed, "<u4").tolist() == table.segment(c), c
