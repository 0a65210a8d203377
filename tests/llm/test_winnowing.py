"""Winnowing, decontamination and fingerprints against brute force."""

import hashlib
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import decontaminate, fingerprints, winnow
from tessera.llm.words import ALNUM_SPLIT, SPACE_SPLIT, bytes_of, hash_word, split_words

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def slow_kept(hashes, window):
    out = set()
    window = min(window, len(hashes))
    for i in range(len(hashes) - window + 1 if len(hashes) else 0):
        part = [int(h) >> 32 for h in hashes[i : i + window]]
        out.add(i + max(k for k, h in enumerate(part) if h == min(part)))
    return sorted(out)


@pytest.mark.parametrize("n", [0, 1, 2, 5, 6, 7, 40])
def test_kept_is_rightmost_minimum(n):
    rng = np.random.default_rng(n)
    for window in (1, 2, 5, 6, 8):
        hashes = rng.integers(0, 4, n).astype(np.uint64) << np.uint64(32)
        assert winnow.kept(hashes, window).tolist() == slow_kept(hashes, window)


def test_words_of_rows():
    import pyarrow as pa

    texts = ["Ab c", None, "", "\x00d\x1fE  é", "x", " y ", "z"]
    for table, pattern in ((SPACE_SPLIT, re.compile(r"[^\x20\x09-\x0D]+")), (ALNUM_SPLIT, ALNUM)):
        words = split_words(*bytes_of(pa.array(texts)), table)
        want = [pattern.findall((t or "").translate(LOW)) for t in texts]
        assert np.diff(words.first).tolist() == [len(w) for w in want]
        assert words.hash.tolist() == [hash_word(w, table) for ws in want for w in ws]


def slow_mark(text, items):
    words = ALNUM.findall((text or "").translate(LOW))
    hit, found = set(), set()
    for item_id, item in items:
        w = ALNUM.findall((item or "").translate(LOW))
        n = min(10, len(w))
        for s in range(len(w) - n + 1 if w else 0):
            for p in range(len(words) - n + 1):
                if words[p : p + n] == w[s : s + n]:
                    hit |= set(range(p, p + n))
                    found.add(item_id)
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("block_bytes", [1 << 20, 600])
def test_mark(spark, block_bytes):
    rng = random.Random(1)
    word = lambda: rng.choice(["a", "b", "cc", "É", "9"])
    items = [(i, " ".join(word() for _ in range(rng.choice([0, 1, 4, 9, 10, 11, 30])))) for i in range(40)] + [(3, None), (None, "a b"), (5, "A. a-b")]
    items = [x for x in items if x[1] is None or len(x[1].split()) not in (1,)]
    texts = [None, "", "...", "a"] + [" ".join(word() for _ in range(rng.choice([3, 9, 10, 40, 200]))) for _ in range(60)]
    texts += [t + " . " + items[k % 20][1].upper() + "!x" for k, t in enumerate(texts[4:20])] + texts[-3:]
    docs = spark.createDataFrame([(i, t, "own") for i, t in enumerate(texts)], "doc_id long, text string, items string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, sorted(r["items"])) for r in decontaminate.mark(docs, bench, block_bytes=block_bytes).collect()}
    known = [x for x in items if None not in x]
    assert got == {i: slow_mark(t, known) for i, t in enumerate(texts)}


def test_repeated_words_take_linear_time():
    """One word over and over in a text and in items, as many items as share a window, short ones too."""
    ids = list(range(300))
    texts = ["la " * 1000] * 200 + ["la " * (k % 12) for k in range(100)]
    index = decontaminate.ItemIndex(ids, texts)
    began = time.process_time()
    got = decontaminate._marked(pa.array(["la " * 20_000, "la " * 9, "x " + "la " * 10 + "y", None]), index).to_pylist()
    assert time.process_time() - began < 1
    assert [r["spans"] for r in got] == [[{"start": 0, "end": 20_000}], [{"start": 0, "end": 9}], [{"start": 1, "end": 11}], []]
    known = [(i, t) for i, t in zip(ids, texts, strict=True)]
    assert (got[1]["n_words"], sum(s["end"] - s["start"] for s in got[1]["spans"]), got[1]["items"]) == slow_mark("la " * 9, known)
    assert got[0]["items"] == [i for i, t in known if t]


def test_hot_item_is_joined_in_parts(spark):
    """A passage in most of the texts, by the join of fingerprints: equal to the index."""
    passage = " ".join(f"p{k}" for k in range(14))
    docs = spark.createDataFrame([(i, f"{i} a b c {passage} d {i}" if i % 3 else f"only {i}") for i in range(90)], "doc_id long, text string")
    items = spark.createDataFrame([(1, passage), (2, passage), (3, "p3 p4"), (4, "nothing like it")], "item_id long, text string")
    rows = [sorted((r.doc_id, r.n_hit, r["items"], r.spans) for r in decontaminate.mark(docs, items, block_bytes=b).collect()) for b in (0, 1 << 20)]
    assert rows[0] == rows[1] and sum(bool(r[1]) for r in rows[0]) == 60


def test_mark_empty(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = docs.select(F.col("doc_id").alias("item_id"), "text").limit(0)
    assert [(r.n_hit, r["items"], r.spans) for r in decontaminate.mark(docs, none).collect()] == [(0, [], [])]
    assert decontaminate.mark(docs.limit(0), none).count() == 0


def slow_compare(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    out = []
    for k, (i, text) in enumerate(rows):
        text, after = text or "", rows[(k + 1) % len(rows)][1] or ""
        q = len(text) // 4
        edited = text[: len(text) - q] + after[:q]
        a, b, c = (set(fingerprints.fingerprint(fingerprints.points_of(t))[0].tolist()) for t in (text, edited, after))
        out.append((i, len(text), edited, round(len(a & b) / len(a | b), 9), round(len(a & c) / len(a | c), 9)))
    return sorted(out, key=str)


def test_compare(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(0, 400), "".join(rng.choice("ab é😀") for _ in range(rng.choice([0, 1, 3, 30, 300])))) for _ in range(300)] + [(None, None), (None, "x"), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    import unittest.mock

    keep = fingerprints.with_next
    with unittest.mock.patch.object(fingerprints, "with_next", lambda d: keep(d, 20)):
        got = fingerprints.compare(docs).collect()
    assert sorted(((r.doc_id, r.n_chars, r.edited, round(r.near_edited, 9), round(r.near_next, 9)) for r in got), key=str) == slow_compare(rows)
    by_text = {}
    assert all(by_text.setdefault(r.fingerprint, r.n_chars) == r.n_chars for r in got if r.n_chars < 24)
    assert fingerprints.compare(docs.limit(0)).count() == 0
    one = fingerprints.compare(docs.where("doc_id is null and text is null")).collect()
    assert [(r.n_chars, r.near_next) for r in one] == [(0, 1.0)]


def test_short_texts_keep_their_likeness(spark):
    """Three quarters of a text of 20 to 99 code points are a run of 15 or more, which gives a common hash."""
    rng = random.Random(3)
    text = lambda n: "".join(chr(rng.randrange(97, 123)) for _ in range(n))
    rows = [(i, text(20 + i % 80)) for i in range(800)]
    got = fingerprints.compare(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert len(got) == 800 and all(r.near_edited > 0 for r in got)
    assert 0.4 < sum(r.near_edited for r in got) / 800 < 0.75
    for _ in range(300):  # any shared run of 15, wherever it is
        run, a, b = text(15), text(rng.randrange(60)), text(rng.randrange(60))
        assert fingerprints.likeness(*(fingerprints.fingerprint(fingerprints.points_of(x))[0] for x in (a + run, run + b))) > 0


def test_oracle_op5(spark, sf_dir):
    import duckdb

    from tessera.llm.queries import OP5_SQL, op5_decontaminate

    db = duckdb.connect()
    for t in ("documents", "benchmark"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    want = db.sql(f"SELECT doc_id, n_words, n_hit, n_items, items_sha256, contaminated FROM ({OP5_SQL})").fetchall()
    got = [tuple(r) for r in op5_decontaminate(spark, sf_dir).collect()]
    assert sorted(got) == sorted(want)
    assert hashlib.sha256(b"").hexdigest() in {r[4] for r in got}


def test_mark_by_join_of_hot_and_long_texts(spark):
    """A benchmark over the bound, a passage in most documents, a text of 1 MB and columns with clashing names."""
    rng = random.Random(9)
    text = lambda n: " ".join(f"w{rng.randrange(400)}" for _ in range(n))
    items = [(i, text(rng.choice([3, 12, 25]))) for i in range(30)]
    texts = [text(30) + " " + items[1][1] + " " + text(5) for _ in range(40)] + [None, "", text(150_000) + " " + items[2][1], items[3][1]] * 2
    docs = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in enumerate(texts)], ["doc_id", "text", "a.b", "_block0", "digest"]).repartition(4)
    bench = spark.createDataFrame(items, "item_id long, text string")
    near, far = (decontaminate.mark(docs, bench, block_bytes=b) for b in (1 << 20, 100))
    assert near.columns == far.columns == ["doc_id", "text", "a.b", "_block0", "digest", "n_words", "items", "spans", "n_hit"]
    results = [sorted((r.doc_id, r.n_words, r.n_hit, sorted(r["items"]), [tuple(s) for s in r.spans]) for r in x.collect()) for x in (near, far)]
    assert results[0] == results[1] and sum(bool(r[3]) for r in results[0]) >= 44


def test_query_of_op7_against_a_plain_version(spark, sf_dir):
    """The whole query row by row: code points, digests of the edited texts, printed fingerprints and likenesses."""
    from tessera.llm.queries import op7_fingerprints

    rows = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())

    def mixed(x):
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ x >> shift) * factor % 2**64
        return x ^ x >> 31

    def plain(text):
        k = min(8, len(text))
        base, grams = 0x9E3779B97F4A7C15, []
        for i in range(len(text) - k + 1):
            grams.append(mixed((sum((ord(c) + 1) * pow(base, j, 2**64) for j, c in enumerate(text[i : i + k])) + k) % 2**64))
        at = slow_kept(grams, 8)
        return ",".join(f"{grams[p] >> 32:08x}.{p - q:x}" for p, q in zip(at, [0, *at], strict=False)), {grams[p] >> 32 for p in at}

    got = {r.doc_id: r for r in op7_fingerprints(spark, sf_dir).collect()}
    assert sorted(got) == [i for i, _ in rows]
    for k, (i, text) in list(enumerate(rows))[::6]:
        after = rows[(k + 1) % len(rows)][1]
        q = len(text) // 4
        edited = text[: len(text) - q] + after[:q]
        (a, x), (b, y), (_, z) = plain(text), plain(edited), plain(after)
        r = got[i]
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(text), hashlib.sha256(edited.encode()).hexdigest(), a, b)
        assert abs(r.near_edited - len(x & y) / len(x | y)) < 1e-12 and abs(r.near_next - len(x & z) / len(x | z)) < 1e-12


def test_one_id_and_no_id_are_cut(spark):
    """Rows of one id and of none are dealt over ranges by their texts."""
    docs = spark.range(3000).select(F.when(F.col("id") % 2 == 0, F.lit(5)).cast("long").alias("doc_id"), F.concat(F.lit("t"), F.col("id") * 7919 % 3000).alias("text"))
    placed = fingerprints.with_next(docs, 100)
    sizes = [r["count"] for r in placed.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) > 15 and max(sizes) < 500
    assert sorted((r.doc_id or 0, r.n_chars) for r in fingerprints.compare(docs).collect()) == sorted((r.doc_id or 0, len(r.text)) for r in docs.collect())


def test_very_long_text_has_a_fingerprint(spark):
    docs = spark.createDataFrame([(1, "ab é" * 500_000), (2, "ab é" * 10)], "doc_id long, text string")
    got = {r.doc_id: r for r in fingerprints.compare(docs).collect()}
    assert got[1].n_chars == 2_000_000 and got[1].near_next > 0
