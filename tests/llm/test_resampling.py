"""Weights, noise and draws against a plain version with regular expressions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from tessera.llm import resampling as R
from tessera.llm.queries import op12_importance_resampling

SCHEMA = "doc_id long, text string"


def words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def runs(text, n):
    w = words(text)
    return [" ".join(w[s : s + k]) for k in range(1, n + 1) for s in range(len(w) - k + 1)]


def plain(docs, target, n, buckets, seed, least, percent):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(bucket(f) for x in texts for f in runs(x, n)) for texts in ([x for _, x in docs], target))
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in range(buckets)]
    rows = []
    for i, x in docs:
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(f)] for f in runs(x, n))
        rows.append((i, len(words(x)), len(runs(x, n)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    fit = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is not None, r[0] or 0, r[2], r[3]))
    k = len(fit) * percent // 100
    return sorted([(*r, p + 1 if p < k else None) for p, r in enumerate(fit)] + [(*r, None) for r in rows if r[1] < least], key=str)


def rows_of(df):
    return sorted(((r.doc_id, r.n_words, r.n_features, r.weight, r.score, r.rank) for r in df.collect()), key=str)


def table(seed=0):
    rng = random.Random(seed)
    pool = ["Straße", "ÉTÉ", "été", "a", "B", "b2", "don't", "x_y", "naïve", "中文", "ſ", "İ", "the", " ", "é"]
    rows = [(i, rng.choice([" ", "\n", "\x0b", "-"]).join(rng.choice(pool) for _ in range(rng.randrange(60)))) for i in range(60)]
    return rows + [(7, rows[3][1])] * 40 + [(None, rows[5][1])] * 5 + [(90, None), (91, ""), (92, " .,; "), (93, "word" * 20_000), (94, "w v " * 50_000)]


@pytest.mark.parametrize("n", [1, 2, 3])
def test_against_a_plain_version(spark, n):
    docs, target = table(), ["the naïve été", None, "", "B b2 the the", "中文 x-y"]
    got = R.resample(spark.createDataFrame(docs, SCHEMA).repartition(4), spark.createDataFrame([(x,) for x in target], "text string"), n, 500, 11, 5, 30)
    assert rows_of(got) == plain(docs, target, n, 500, 11, 5, 30)


def test_query_against_a_plain_version(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    target = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    want = [(r[0], *r[2:]) for r in plain(docs, target, 1, 10_000, 2024, 20, 10)]
    got = [(r.doc_id, r.n_features, r.weight, r.score, r.rank) for r in op12_importance_resampling(spark, sf_dir).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("size", [1, 7, 64])
def test_pieces_cut_no_word(size):
    for _, text in table(3):
        if len(text or "") < 5000:
            assert [w.decode() for some in R.pieces(text, size) for w in some] == words(text)


def test_runs_go_across_pieces(monkeypatch):
    text = "one two three four five six"
    want = Counter(zlib.crc32(f.encode()) % 997 for f in runs(text, 3))
    monkeypatch.setattr(R.pieces, "__defaults__", (5,))
    assert R.features(text, 3, 997) == (6, want)


def test_odd_tables(spark):
    empty, none = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "text string")
    assert R.resample(empty, none).collect() == []
    clash = spark.createDataFrame([(1, "a b", 5, 6)], SCHEMA + ", rank long, weight long")
    assert rows_of(R.resample(clash, none, min_words=1, percent=100)) == plain([(1, "a b")], [], 1, 10_000, 2024, 1, 100)
