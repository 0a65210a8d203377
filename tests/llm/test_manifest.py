"""Manifests against a plain tree of lists, for several arities, group sizes and block sizes."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tessera.llm import manifest as M
from tessera.llm.queries import op13_merkle_manifest

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def plain_leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(nodes, arity):
    """The top, and each node's steps (left, right) up to it."""
    steps, at, level = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(level) > 1:
        for k, p in enumerate(at):
            run = p - p % arity
            steps[k].append(("".join(level[run:p]), "".join(level[p + 1 : run + arity])))
        level, at = [sha("".join(level[r : r + arity])) for r in range(0, len(level), arity)], [p // arity for p in at]
    return level[0], steps


def plain(rows, arity=2):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, plain_leaf(r), r))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    built = [(g, sorted(groups[g], key=lambda x: x[:3])) for g in names]
    tops = [tree([x[2] for x in rows], arity) for _, rows in built]
    root, over = tree([t[0] for t in tops], arity)
    return sorted(((x[3][0], x[2], top, root, tuple(path + upper)) for (_, rows), (top, paths), upper in zip(built, tops, over) for x, path in zip(rows, paths)), key=str)


def rows_of(df):
    return sorted(((r.doc_id, r.leaf, r.subroot, r.root, tuple((s.left, s.right) for s in r.path)) for r in df.collect()), key=str)


def build(spark, rows, arity=2, parts=5):
    return M.build(spark.createDataFrame(rows, SCHEMA).repartition(parts), ("doc_id", "source", "lang", "n_chars", "text"), keep=("doc_id",), arity=arity)


def table(n, seed=0):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["s", None, "é"]), rng.choice(["en", "en", "en", "de", None, "ß", ""]), rng.choice([i, None]), rng.choice(["t", "", None, "x" * 50]) and f"text {i}") for i in range(n)]
    return rows + [(4, "s", "lone", 1, "x"), (None, None, None, None, None), (None, None, "en", None, None)] + [(7, "s", "en", 2, "copy")] * (n // 3)


@pytest.mark.parametrize(("arity", "block"), [(2, 4096), (2, 4), (2, 8), (3, 9), (5, 4096), (16, 16)])
def test_against_a_plain_tree(spark, monkeypatch, arity, block):
    monkeypatch.setattr(M, "BLOCK", block)
    rows = table(150, arity)
    got = build(spark, rows, arity)
    assert rows_of(got) == plain(rows, arity)
    assert got.where(M.fold(F.col("leaf"), F.col("path")) != F.col("root")).isEmpty()


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 8, 9])
def test_small_groups_and_large_ones_apart(spark, monkeypatch, n):
    monkeypatch.setattr(M, "LARGE_GROUP", 2)
    monkeypatch.setattr(M, "BLOCK", 4)
    rows = [(i, "s", "a", 1, f"{i}") for i in range(n)] + [(i, "s", "b", 1, f"{i}") for i in range(2)]
    assert rows_of(build(spark, rows)) == plain(rows)


def test_many_groups(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK", 4)
    rows = [(i, "s", f"l{i % 37}", 1, "x") for i in range(90)]
    assert rows_of(build(spark, rows)) == plain(rows)


def test_odd_tables(spark):
    assert build(spark, []).collect() == []
    lone = [(1, None, "en", 1, "x" * 2_000_000)]
    assert rows_of(build(spark, lone)) == plain(lone)
    clash = spark.createDataFrame([(1, "en", 5, 6, 7), (2, "en", 5, 6, 7)], "doc_id long, lang string, g long, path long, `a.b` long")
    out = M.build(clash, ("doc_id", "g"), keep=("doc_id", "g", "a.b"))
    assert sorted((r.doc_id, r.g, r["a.b"], r.leaf) for r in out.collect()) == [(i, 5, 7, sha(f"1:{i}1:5")) for i in (1, 2)]


def test_query(spark, sf_dir):
    """Only altered rows fail; digests of proofs and folded roots are those of the plain tree."""
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    known = {d[0]: d for d in docs}
    want = []
    for i, digest, top, root, path in plain(docs):
        d = known[i]
        bad = zlib.crc32(str(i).encode()) % 7 == 0
        folded = plain_leaf((*d[:3], d[3] + 1, d[4])) if bad and d[3] is not None else digest
        for left, right in path:
            folded = sha(left + folded + right)
        want.append((i, digest, top, root, sha("".join(a + b for a, b in path)), folded, folded == root))
    got = [(r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in op13_merkle_manifest(spark, sf_dir).collect()]
    assert sorted(got) == sorted(want) and 0 < sum(not r[-1] for r in got) < len(got) / 4
