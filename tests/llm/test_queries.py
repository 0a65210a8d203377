"""Queries against the tokenizer libraries and a plain learner, row by row."""

import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import sentencepiece
import tokenizers
from pyspark.sql import functions as F

from tessera.llm import ftrl
from tessera.llm.queries import op3_toxicity, op6_token_counts, op10_sentencepiece
from tessera.llm.words import ALNUM_SPLIT, split_words


def texts_of(spark, sf_dir):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}


def test_token_counts(spark, sf_dir):
    library = tokenizers.Tokenizer.from_file(P.path("word_bpe_49k.json"))
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in op6_token_counts(spark, sf_dir).collect()}
    want = {}
    for i, t in texts_of(spark, sf_dir).items():
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want[i] = (len((t or "").encode()), n, n > 2048)
    assert got == want


def test_sentencepiece(spark, sf_dir):
    library = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in op10_sentencepiece(spark, sf_dir).collect()}
    want = {}
    for i, t in texts_of(spark, sf_dir).items():
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        want[i] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())
    assert got == want


def test_toxicity_against_a_plain_learner(spark, sf_dir):
    """FTRL with one number at a time and weights in a dictionary gives the scores of the query."""
    texts = texts_of(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic", F.xxhash64("doc_id").alias("order")).collect()

    def features(text):
        raw = np.frombuffer((text or "").encode(), np.uint8)
        return ftrl.features(split_words(raw, np.array([0, len(raw)]), ALNUM_SPLIT))[1].tolist() + ["bias"]

    known = [(r.order, r.toxic, features(texts[r.doc_id])) for r in labels if r.toxic is not None and r.doc_id in texts and zlib.crc32(str(r.doc_id).encode()) % 5]
    assert 0 < len(known) <= ftrl.SHARD_ROWS
    z, n = {}, {}

    def weight(k):
        if abs(z.get(k, 0.0)) <= ftrl.L1:
            return 0.0
        return (np.sign(z[k]) * ftrl.L1 - z[k]) / ((ftrl.BETA + n[k] ** 0.5) / ftrl.ALPHA + ftrl.L2)

    for _ in range(ftrl.EPOCHS):
        for _, label, some in sorted(known, key=lambda r: (r[0], r[1], len(r[2]))):
            held = {k: weight(k) for k in some}
            g = 1 / (1 + np.exp(-np.clip(sum(held.values()), -35, 35))) - label
            for k, w in held.items():
                before = n.get(k, 0.0)
                n[k] = before + g * g
                z[k] = z.get(k, 0.0) + g - (n[k] ** 0.5 - before**0.5) / ftrl.ALPHA * w
    for r in op3_toxicity(spark, sf_dir).collect():
        want = 1 / (1 + np.exp(-np.clip(sum(weight(k) for k in features(texts[r.doc_id])), -35, 35)))
        assert abs(r.score - want) < 1e-6 and r.predicted == (r.score >= 0.5) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
