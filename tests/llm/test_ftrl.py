"""Toxicity: held-out accuracy, the FTRL update against plain arithmetic, and edge cases."""

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tessera.llm import ftrl
from tessera.llm.queries import op3_toxicity
from tessera.llm.words import ALNUM_SPLIT, bytes_of, split_words


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.1"
    rows = op3_toxicity(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").where("held_out").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    toxic, clean = [r for r in rows if r.toxic == 1], [r for r in rows if r.toxic == 0]
    assert sum(r.predicted for r in toxic) >= 0.75 * len(toxic)
    assert sum(r.predicted for r in clean) <= 0.006 * len(clean)
    better = sum((a.score > b.score) + (a.score == b.score) / 2 for a in toxic for b in clean)
    assert better >= 0.97 * len(toxic) * len(clean)


def test_update_is_ftrl():
    learner = ftrl.Learner(alpha=0.5, beta=1.0, l1=0.1, l2=0.2)
    z, n = {}, {}
    for at, y in (([3, 7], 1), ([3], 0), ([7, 9], 1), ([3, 9], 1)):
        w = {}
        for i in at:
            zi, ni = z.get(i, 0.0), n.get(i, 0.0)
            w[i] = 0.0 if abs(zi) <= 0.1 else -(zi - math.copysign(0.1, zi)) / ((1.0 + math.sqrt(ni)) / 0.5 + 0.2)
        g = 1 / (1 + math.exp(-sum(w.values()))) - y
        for i in at:
            sigma = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / 0.5
            z[i] = z.get(i, 0.0) + g - sigma * w[i]
            n[i] = n.get(i, 0.0) + g * g
        learner.learn(np.array(at), y)
    assert all(math.isclose(learner.z[i], z[i]) and math.isclose(learner.n[i], n[i]) for i in z)


def test_features_stay_in_their_row():
    texts = ["a b c", "b c", "", None, "a a a"]
    row, at = ftrl.features(split_words(*bytes_of(pa.array(texts)), ALNUM_SPLIT))
    assert np.bincount(row, minlength=5).tolist() == [3 + 2 + 1, 2 + 1, 0, 0, 1 + 1 + 1]
    alone, _ = ftrl.features(split_words(*bytes_of(pa.array(["b c"])), ALNUM_SPLIT)), None
    assert at[row == 1].tolist() == alone[1].tolist()


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 9), (1, "", 8), (2, "bad word", 7), (None, "x", 6), (2, "bad word", 7)], "doc_id long, text string, score long")
    none = docs.select("doc_id", F.lit(1).alias("toxic")).limit(0)
    rows = ftrl.score(docs, ftrl.train(docs, none)).collect()
    assert {r.score for r in rows} == {0.5} and len(rows) == 5
    labels = spark.createDataFrame([(1, 0), (2, 1), (2, 1), (2, None), (None, 1)], "doc_id long, toxic int")
    assert ftrl.score(docs, ftrl.train(docs, labels)).where("score is null").count() == 0
    assert ftrl.score(docs.limit(0), ftrl.train(docs.limit(0), labels)).count() == 0
