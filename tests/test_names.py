"""Look-alike names against a plain version over all pairs; confusions of the three kinds on small tables."""

import random
import re

from tessera.plans.names import confused, lookalike_pairs


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for k, y in enumerate(b, 1):
            row.append(min(old[k] + 1, row[-1] + 1, old[k - 1] + (x != y)))
    return row[-1]


def alike(a, b):
    same = re.sub(r"\d", "", a) == re.sub(r"\d", "", b)
    return min(len(a), len(b)) >= 4 and a not in b and b not in a and not same and edits(a, b) <= (1 if max(len(a), len(b)) < 8 else 2)


def test_lookalike_pairs(spark):
    rng = random.Random(7)
    names = {"".join(rng.choice("ab1") for _ in range(rng.randrange(11))) for _ in range(500)} | {f"customer {k:03d}" for k in range(40)} | {f"costumer {k:03d}" for k in range(5)} | {"basel", "basil", "lund", "lune", "1234", "12345678"}
    rows = [("x", n) for n in sorted(names)] * 2 + [("y", "basel"), ("y", None)]
    got = sorted(map(tuple, lookalike_pairs(spark.createDataFrame(rows, "kind string, name string")).collect()))
    assert got == [("x", a, b) for a in sorted(names) for b in sorted(names) if a < b and alike(a, b)] and len(got) > 100


def test_confusions(spark):
    topics = [("m1", "k", "basel", 3), ("m2", "k", "basil", 3), ("m3", "k", "bisel", 2), ("m4", "k", "bysel", 3), ("m5", "z", "basel", 2), ("s1", "q", "mercury", 2), ("s2", "r", "mercury", 2), ("o", "q", "other", 9)]
    topics += [(f"c{k}", str(k), "common", 5) for k in range(9)]
    rejects = [("m1", "o", 1), ("o", "m1", 1), ("m1", "o", 2), ("o", "o", 3), ("m1", "m2", 4)]
    vectors = [("m1", [1.0, 0.0]), ("m1", [1.0, 1.0]), ("m2", [2.0, 1.0]), ("m4", [-1.0, 0.0]), ("m3", [2.0, 1.0])]
    frames = spark.createDataFrame(topics, "topic string, kind string, name string, n long"), spark.createDataFrame(rejects, "topic string, other string, question long"), spark.createDataFrame(vectors, "topic string, vector array<double>")
    got = {(r.topic, r.other): (r.place, r.score, r.rejects, r.same_name, r.lookalike) for r in confused(*frames).collect()}
    want = {("m1", "m2"): (1, 1.1931, 1, False, True), ("m1", "o"): (2, 1.0986, 2, False, False), ("m1", "m5"): (3, 1.0, 0, True, False)}
    assert {k: v for k, v in got.items() if k[0] == "m1"} == want
    assert got["s1", "s2"] == (1, 1.0, 0, True, False) and got["m2", "m1"] == (1, 1.1931, 1, False, True)
    assert not any("m3" in k or "m4" in k or k[0].startswith("c") for k in got)  # too few questions, unlike vectors, too many owners
    none = [f.limit(0) for f in frames]
    assert confused(*none).count() == 0
