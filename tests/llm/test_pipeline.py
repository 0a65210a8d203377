"""The pipeline against a plain version of each stage's decision, and on odd rows."""

import hashlib
import random

import numpy as np
import public_tokenizers as P
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_parity_join import slow
from tests.llm.test_pii import plain
from tests.llm.test_winnowing import slow_mark


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_stages_on_a_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_duplicates", "decontamination", "personal_data", "tokens"]
    steps = [docs]
    for _, stage in corpus_pipeline.STAGES:
        steps.append(corpus_pipeline.stored(stage(spark, steps[-1], sf_dir), "test"))
    assert all(s.columns == docs.columns for s in steps[:-1])
    tables = [{r.doc_id: r for r in s.collect()} for s in steps]
    assert set(tables[1]) <= set(tables[0]) and len(tables[1]) >= 0.8 * len(tables[0])
    want = {d for d, _, c in slow([(i, r.text) for i, r in tables[1].items()]) if d == c}
    assert set(tables[2]) == want
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert set(tables[3]) == {i for i, r in tables[2].items() if not slow_mark(r.text, items)[1]}
    library = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    for i, r in tables[4].items():
        before = tables[3][i].text
        spans = plain(before)
        assert (r.text == before) == (not spans) or "[" in r.text
        assert not plain(r.text) and r.n_chars == len(r.text)
        ids = library.encode(r.text, add_bos=True, add_eos=True)
        t = tables[5][i]
        assert (t.n_tokens, t.ids_sha256, t.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())
    assert set(tables[5]) == set(tables[3])


def test_near_duplicates_of_odd_rows(spark, sf_dir):
    rng = random.Random(1)
    base = [f"w{rng.randrange(999)}" for _ in range(60)]
    text = " ".join(base)
    rows = [(3, text, "en", "a", 1), (3, text, "en", "b", 1), (1, text + " x", "en", "a", 1), (None, text, None, None, None), (None, text, None, None, None), (None, None, None, None, None), (9, None, "en", "a", 0), (9, None, "en", "a", 0), (8, "", "en", "a", 0), (7, "other words here entirely", "en", "a", 1)]
    rows += [(7, text + " y", "en", "a", 1), (None, "a group of its own without any number at all", None, None, None), (None, "a group of its own without any number at ALL", None, None, None)]
    out = corpus_pipeline.near_duplicates(spark, documents(spark, rows), sf_dir)
    assert sorted(((r.doc_id, r.text and r.text.replace("ALL", "all")) for r in out.collect()), key=str) == sorted([(1, text + " x"), (None, None), (9, None), (8, ""), (7, "other words here entirely"), (None, "a group of its own without any number at all")], key=str)


def test_odd_and_empty_tables(spark, sf_dir):
    rows = [(1, None, None, None, None), (None, "", None, None, None), (2, "x " * 50_000, "en", "a", 5)]
    for docs in (documents(spark, rows), documents(spark, rows).limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.stored(stage(spark, docs, sf_dir), "test")
        assert docs.where(F.col("n_tokens") < 2).count() == 0


def test_texts_go_to_python_in_small_batches(spark, sf_dir):
    """A batch of 10,000 texts would be tens of MB in the executor and in its worker; a setting of the session's own stays."""
    import pyarrow as pa

    from tessera.llm.tables import BATCH_BYTES, BATCH_SETTING

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"])

    wide = spark.range(0, 6000, 1, 1).selectExpr("id", "repeat('abcdefgh', 400) AS text")
    stages = dict(corpus_pipeline.STAGES)
    try:
        for name in ("decontamination", "tokens"):
            spark.conf.unset(BATCH_SETTING)
            stages[name](spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir)
            assert max(r.n for r in wide.mapInArrow(sizes, "n long").collect()) < 1.2 * BATCH_BYTES
        spark.conf.set(BATCH_SETTING, "1m")
        stages["tokens"](spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir)
        assert spark.conf.get(BATCH_SETTING) == "1m"
    finally:
        spark.conf.unset(BATCH_SETTING)
