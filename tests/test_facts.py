"""Clusters by vectors and terms against a plain average linkage of all pairs; labels and one-fact pairs against loops."""

import random
from collections import Counter

import numpy as np
import pytest

from tessera.operators import facts as A
from tessera.plans.facts import fact_clusters, fact_labels, fact_rows

ROWS = "topic long, id long, vector array<double>, terms array<string>"


def plain(rows, threshold, bonus):
    """Sets of ids per topic: the two clusters of the least mean distance merge while that is under the threshold."""
    out = set()
    for topic in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == topic]
        v = np.array([r[2] for r in mine])
        terms = [{t for t in r[3] or [] if t is not None} for r in mine]
        like = np.minimum(1.0, v @ v.T + bonus * np.array([[len(a & b) for b in terms] for a in terms]))
        total, n, groups = 1 - like, np.ones(len(mine)), [[r[1]] for r in mine]
        for i in range(len(mine)):
            for j in range(len(mine)):
                if mine[i][2] == mine[j][2] and terms[i] == terms[j]:
                    total[i, j] = 0.0
        np.fill_diagonal(total, np.inf)
        while len(groups) > 1:
            mean = total / np.outer(n, n)
            i, j = sorted(np.unravel_index(np.argmin(mean), mean.shape))
            if not mean[i, j] < threshold:
                break
            total[i] += total[j]
            total[:, i] = total[i]
            total[i, i] = np.inf
            n[i] += n[j]
            groups[i] += groups[j]
            total, n = np.delete(np.delete(total, j, 0), j, 1), np.delete(n, j)
            del groups[j]
        out |= {(topic, frozenset(g)) for g in groups}
    return out


def sets_of(df):
    got = {}
    for r in df.collect():
        got.setdefault((r.topic, r.cluster), set()).add(r.id)
    assert all(sorted(c for t, c in got if t == topic) == list(range(sum(t == topic for t, _ in got))) for topic in {t for t, _ in got})
    return {(t, frozenset(v)) for (t, _), v in got.items()}


def table(n, seed, topics=2, dims=6):
    rng = np.random.default_rng(seed)
    pick = random.Random(seed)
    base = rng.normal(size=(8, dims))
    rows = []
    for k in range(n):
        v = base[k % 8] + rng.normal(size=dims) * 0.45
        rows.append((k % topics, k, (v / np.linalg.norm(v)).tolist(), pick.choice([None, [], *[[f"t{pick.randrange(9)}" for _ in range(pick.randrange(4))]] * 6])))
    return rows + [(0, n + k, rows[0][2], rows[0][3]) for k in range(5)] + [(9, 2 * n, rows[1][2], [None, "x"])]


def test_likeness_is_one_at_most():
    """Among rows at the bound the order of merging is open, as with any ties, so the tables for clusters have few of them."""
    v = np.array([[1.0, 0.0], [0.8, 0.6], [0.0, 1.0]])
    ts = [np.array([1, 2]), np.array([2, 1, 3]), np.array([], int)]
    assert np.allclose(A.likeness(v, ts, v[:2], A.rows_with(ts[:2]), 0.2), [[1, 1], [1, 1], [0, 0.6]]) and np.allclose(A.likeness(v, ts, v, A.rows_with(ts), 0.05)[0], [1, 0.9, 0])


@pytest.mark.parametrize(("local", "block"), [(4096, 4096), (8, 40), (8, 4096)])
def test_clusters(spark, monkeypatch, local, block):
    """In one task, and in rounds over several blocks."""
    monkeypatch.setattr(A, "LOCAL", local)
    monkeypatch.setattr(A, "BLOCK", block)
    rows = table(230, 4)
    got = sets_of(A.clusters(spark.createDataFrame(rows, ROWS).repartition(3), 0.5, 0.04))
    assert got == plain(rows, 0.5, 0.04) and len(got) < 120


def test_more_rows_than_a_block(spark):
    """Beyond 4,096 rows of a topic with the real bounds: rounds over blocks give what one table of distances gives."""
    rng = np.random.default_rng(1)
    v = rng.normal(size=(700, 1, 8)) + rng.normal(size=(700, 6, 8)) * 0.1
    v = (v / np.linalg.norm(v, axis=2, keepdims=True)).reshape(-1, 8)
    rows = [(1, k, x.tolist(), [f"t{k // 12 % 50}"]) for k, x in enumerate(v)]
    assert len(rows) > A.LOCAL == A.BLOCK
    ts = [np.array([k // 12 % 50]) for k in range(len(rows))]
    roots = A.chained(1 - A.likeness(v, ts, v, A.rows_with(ts), 0.001), np.ones(len(v)), 0.08)
    want = {}
    for k, r in enumerate(roots.tolist()):
        want.setdefault(r, set()).add(k)
    got = sets_of(A.clusters(spark.createDataFrame(rows, ROWS).repartition(4), 0.08, 0.001))
    assert got == {(1, frozenset(x)) for x in want.values()}


def plain_described(members, own, sizes):
    terms = {(m[0], m[1], m[2]): sorted({t for t in m[4] or [] if t is not None}) for m in members}
    spread = Counter(t for _, t in {(m[0], t) for m in members for t in terms[m[:3]]})
    ok = lambda topic, t: spread[t] <= A.VAGUE and any((topic, w) not in own for w in t.lower().split() if w)
    out, cores, anchors = {}, {}, {}
    for key in {m[:2] for m in members}:
        mine = [m for m in members if m[:2] == key]
        counts = Counter(t for m in mine for t in terms[m[:3]] if ok(key[0], t))
        label = min(counts, key=lambda t: (-counts[t], t)) if counts else None
        core = [m for m in mine if label is None or label in terms[m[:3]]]
        held = Counter(t for m in core for t in terms[m[:3]] if ok(key[0], t))
        anchors[key] = sorted(t for t, k in held.items() if label is not None and t != label and len(core) >= 2 and 2 * k >= len(core))
        cores[key] = (label, core, held)
        sources = len({m[3] for m in core if m[3] is not None})
        out[key] = (len(mine), label, counts[label] if label else None, sources, sources >= (2 if sizes.get(key[0], 0) >= 6 else 1), tuple(anchors[key]))
    pairs = {}
    for a in cores:
        for b in cores:
            if a[0] == b[0] and a[1] < b[1]:
                by_label = any(cores[x][0] is not None and 2 * cores[y][2][cores[x][0]] >= len(cores[y][1]) for x, y in ((a, b), (b, a)))
                users = lambda t: sum(t in anchors[k] for k in anchors if k[0] == a[0])  # noqa: E731, B023
                if by_label or any(users(t) == 2 for t in set(anchors[a]) & set(anchors[b])):
                    pairs[a[0], a[1], b[1]] = "label" if by_label else "anchor"
    return out, pairs


def test_labels_and_one_fact(spark):
    rng = random.Random(2)
    members = [(rng.randrange(3), rng.randrange(9), k, rng.choice(["s1", "s2", None]), rng.choice([None, *[[f"{rng.choice('abcdefg')} w" for _ in range(rng.randrange(4))]] * 5])) for k in range(150)]
    members += [(5, 1, 900 + k, f"s{k % 2}", ["only here", "shared one"]) for k in range(3)] + [(5, 2, 910 + k, "s", ["another", "shared one"]) for k in range(2)] + [(5, 3, 920, "s", ["own name"])]
    members += [(100 + k, 0, 1000 + k, "s", ["everywhere"]) for k in range(60)]
    own = {(5, "own"), (5, "name"), (0, "w")}
    sizes = {0: 6, 1: 5, 5: 9}
    labels, same = A.described(
        spark.createDataFrame(members, "topic long, cluster long, id long, source string, terms array<string>"), spark.createDataFrame(sorted(own), "topic long, word string"), spark.createDataFrame(list(sizes.items()), "topic long, n long"),
    )
    got = {(r.topic, r.cluster): (r.n, r.label, r.support, r.sources, r.eligible, tuple(r.anchors)) for r in labels.collect()}
    want, pairs = plain_described(members, own, sizes)
    assert got == want
    assert {(r.topic, r.a, r.b): r.why for r in same.collect()} == pairs and pairs[5, 1, 2] == "anchor"
    assert got[5, 3][1] is None and got[100, 0][1] is None and got[5, 1][4] and not got[5, 2][4]


def test_queries(spark, sf_dir):
    rows = [tuple(r) for r in fact_rows(spark, sf_dir).select("topic", "id", "vector", "terms").collect()]
    assert sets_of(fact_clusters(spark, sf_dir)) == plain(rows, 0.7, 0.2)
    got = fact_labels(spark, sf_dir).collect()
    assert sum(r.n for r in got) == len(rows) and any(r.label for r in got)


def test_empty(spark):
    assert A.clusters(spark.createDataFrame([], ROWS)).count() == 0


@pytest.mark.parametrize(("times", "least", "most"), [(32, 1, 6), (1, 7, 200)])
def test_large_topics_go_in_one_task(spark, monkeypatch, times, least, most):
    """More rows than a table of pairs holds, a hundred of them at the bound of one: few tables are stored where a task holds the rows, and a round for each merge of
    rows at the bound isn't needed where it doesn't."""
    monkeypatch.setattr(A, "LOCAL", 100)
    monkeypatch.setattr(A, "BLOCK", 100)
    monkeypatch.setattr(A, "TIMES", times)
    rng = np.random.default_rng(3)
    v = np.concatenate([rng.normal(size=(120, 8)), rng.normal(size=8) + rng.normal(size=(100, 8)) * 0.01])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = [(1, k, x.tolist(), [f"t{k}"] if k < 120 else ["alike", f"u{k}"]) for k, x in enumerate(v)]
    calls = []
    monkeypatch.setattr(A, "stored", lambda df, real=A.stored: calls.append(1) or real(df))
    got = sets_of(A.clusters(spark.createDataFrame(rows, ROWS).repartition(4), 0.3, 0.2))
    ts = [np.array([k if k < 120 else 120]) for k in range(220)]
    roots = A.chained(1 - A.likeness(v, ts, v, A.rows_with(ts), 0.2), np.ones(220), 0.3)
    want = {}
    for k, r in enumerate(roots.tolist()):
        want.setdefault(r, set()).add(k)
    assert got == {(1, frozenset(x)) for x in want.values()} and max(map(len, want.values())) >= 100
    assert least <= len(calls) <= most


def test_added_likeness_is_the_table(monkeypatch):
    """Pairs that share terms, and equal vectors longer than one by rounding, looked at in small parts; longer vectors are no matter for it."""
    rng = np.random.default_rng(5)
    for seed in range(12):
        n = int(rng.integers(2, 90))
        v = rng.normal(size=(n, 5))
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        v = v.astype(np.float32).astype(float)
        v[0] *= 1 + 1e-7
        v[n // 2 :: 5] = v[0]
        ts = [np.unique(rng.integers(0, 12, rng.integers(0, 4))) for _ in range(n)]
        w = rng.integers(1, 4, n).astype(float)
        monkeypatch.setattr(A, "PAIRS", [1, 7, 1 << 20][seed % 3])
        of = rng.integers(-1, 9, n)
        of[0] = 8
        got, asked = np.zeros((4, 9)), np.array([1, 3, 7, 8])
        for i, k, total in A.added(v, w, ts, 0.1)(asked, of):
            np.add.at(got, (i, k), total)
        extra = (A.likeness(v, ts, v, A.rows_with(ts), 0.1) - v @ v.T) * np.outer(w, w)
        want = [[extra[np.ix_(of == a, of == b)].sum() if a != b else 0.0 for b in range(9)] for a in asked]
        assert np.allclose(got, want, atol=1e-13, rtol=0)


def test_long_vectors(spark):
    """Vectors longer than one: the bound holds for all pairs."""
    rng = np.random.default_rng(6)
    v = rng.normal(size=(60, 16))
    rows = [(1, k, x.tolist(), None) for k, x in enumerate(1.2 * v / np.linalg.norm(v, axis=1, keepdims=True))] + [(1, 60 + k, (0.9 * v[k] / np.linalg.norm(v[k])).tolist(), None) for k in range(20)]
    assert sets_of(A.clusters(spark.createDataFrame(rows, ROWS), 0.9, 0.1)) == plain(rows, 0.9, 0.1)
