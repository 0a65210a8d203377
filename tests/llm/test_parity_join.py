"""The join against brute force over all pairs, and the bounds that the sketches rest on."""

import random
import re

import numpy as np
import pytest

from tessera.llm import parity_join
from tessera.llm.components import components
from tessera.llm.parity_join import blocks, first_blocks, halved, levels, link, narrow_sketch, shingle_sets

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def slow(rows):
    sets = [shingles(t) for _, t in rows]
    at = list(range(len(rows)))

    def find(i):
        while at[i] != i:
            i = at[i]
        return i

    for i in range(len(rows)):
        for k in range(i):
            both = len(sets[i] & sets[k])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[k]) - both):
                at[find(i)] = find(k)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


def corpus(seed, groups, copies, common=0):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(3000)}"
    shared = [word() for _ in range(60)]
    out = []
    for _ in range(groups):
        base = [word() for _ in range(rng.choice([1, 3, 4, 5, 6, 8, 9, 14, 20, 22, 70, 80, 300]))]
        for _ in range(rng.randrange(1, copies)):
            text = list(base)
            for _ in range(int(len(text) * rng.choice([0, 0.005, 0.01, 0.02, 0.03, 0.05]))):
                text[rng.randrange(len(text))] = word()
            if rng.random() < 0.3:
                text = text[: rng.randrange(1, len(text) + 1)] if rng.random() < 0.3 else text + [word() for _ in range(len(text) // 9)]
            if common and rng.random() < 0.5:
                text += shared
            out.append(" ".join(text))
    return list(enumerate(out))


def run(spark, rows):
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, id string")
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in link(docs.repartition(3)).collect()), key=str)


def test_small_groups(spark):
    rows = corpus(1, 60, 6)
    rows += [(-5, None), (900, ""), (None, " \n"), (None, rows[0][1]), (7, rows[3][1]), (8, rows[8][1]), (901, "A b  C"), (902, "a B c"), (903, "x" * 200_000)]
    assert run(spark, rows) == slow(rows)


@pytest.mark.parametrize("hot", [4096, 8])
def test_large_groups(spark, hot, monkeypatch):
    monkeypatch.setattr(parity_join, "HOT", hot)
    monkeypatch.setattr(parity_join, "CELL", 16)
    rng = random.Random(3)
    base = [f"v{rng.randrange(500)}" for _ in range(120)]
    rows = corpus(2, 20, 5, common=1)
    for i in range(150):
        text = list(base)
        for _ in range(rng.choice([1, 2, 3, 4])):
            text[rng.randrange(len(text))] = f"u{rng.randrange(500)}"
        rows.append((1000 + i, " ".join(text)))
    rows += [(5000 + i, rows[-1][1]) for i in range(40)]
    long = [f"z{rng.randrange(9000)}" for _ in range(1150)]
    for i in range(14):  # sets about the size at which sketches double
        text = long[: 1000 + 12 * i]
        for _ in range(4):
            text[rng.randrange(len(text))] = f"y{rng.randrange(500)}"
        rows.append((7000 + i, " ".join(text)))
    assert run(spark, rows) == slow(rows)


def test_hot_copies_and_few_near_ones(spark, monkeypatch):
    """More than HOT copies deal their buckets over two parts of few nodes each, whose ends still meet."""
    import pyarrow as pa

    monkeypatch.setattr(parity_join, "HOT", 8)
    rng = random.Random(6)
    rows, mixed = [], set()
    for near in (1, 2, 3, 4):
        for parity in (0, 1) * 3:
            base = [f"g{len(rows)}x{k}" for k in range(60)]
            texts = [" ".join(base)]
            even = parity_join.node(next(shingle_sets(pa.array(texts))))[0] % 2
            while len(texts) <= near:
                other = list(base)
                other[rng.randrange(60)] = f"n{rng.randrange(10**9)}"
                if (parity_join.node(next(shingle_sets(pa.array([" ".join(other)]))))[0] + even) % 2 == parity:
                    texts.append(" ".join(other))
            mixed.add((even, parity))
            rows += [(len(rows) + k, t) for k, t in enumerate([texts[0]] * 10 + texts[1:])]
    assert len(mixed) == 4
    assert run(spark, rows) == slow(rows)


def test_sets_that_share_a_number(spark):
    """With ids of 5 bits nearly all sets share theirs with others, and still no two are taken for one."""
    rows = corpus(8, 40, 5) + [(-5, None), (900, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in link(docs, id_bits=5).collect()), key=str)
    assert got == slow(rows)


def test_counts_in_few_bytes():
    for top in (0, 255, 256, 70_000, 2**40):
        counts = np.array([0, 3, top, 1], np.int64)
        raw = parity_join._packed(counts)
        assert parity_join._unpacked(raw, 4).tolist() == [0, 3, min(top, 2**32 - 1), 1]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert link(docs).count() == 0


def test_bounds():
    """Blocks that differ are no more than elements that differ; first blocks of near sets meet; the sketch is a lower bound."""
    rng = np.random.default_rng(4)
    counts = rng.integers(0, 50, parity_join.SLOTS)
    for _ in range(400):
        n = int(rng.choice([4, 5, 7, 15, 16, 17, 19, 20, 63, 64, 70, 79, 80, 300, 1000, 1100, 5000]))
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
        drop, add = rng.integers(0, n // 5 + 1), rng.integers(0, n // 4 + 1)
        b = np.unique(np.r_[rng.permutation(a)[drop:], rng.integers(0, 1 << 63, add, dtype=np.uint64) * np.uint64(2)])
        both = len(np.intersect1d(a, b))
        apart = len(a) + len(b) - 2 * both
        x, y = sorted((narrow_sketch(a), narrow_sketch(b)), key=len)
        while len(y) > len(x):
            y = halved(y)
        assert np.bitwise_count(x ^ y).sum() <= apart
        for level in set(levels(len(a))) & set(levels(len(b))):
            assert len(np.setdiff1d(blocks(a, level), blocks(b, level))) <= apart
        if 100 * both >= 80 * (len(a) + len(b) - both) and apart:
            common = set(levels(len(a))) & set(levels(len(b)))
            assert any(set(first_blocks(a, v, counts)[0].tolist()) & set(first_blocks(b, v, counts)[0].tolist()) for v in common)


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 440)]
    got = {r.id: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    near = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    for node in near:
        seen, todo = set(), [node]
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += near[x]
        assert got.pop(node) == min(seen)
    assert not got


def test_short_texts_are_one_shingle():
    import pyarrow as pa

    a, b, c, d = shingle_sets(pa.array(["a b c", "A  b\tc", "a b", None]))
    assert a.tolist() == b.tolist() != c.tolist() and len(a) == 1 and len(d) == 0


def test_oracle_op1(spark, sf_dir):
    import duckdb

    from tessera.llm.queries import OP1_SQL, op1_jaccard_join

    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf_dir}/documents.parquet')")
    want = db.sql(f"SELECT doc_id, n_shingles, component_id FROM ({OP1_SQL})").fetchall()
    got = [tuple(r) for r in op1_jaccard_join(spark, sf_dir).collect()]
    assert sorted(got) == sorted(want)
    assert any(r[0] != r[2] for r in got)


def test_sets_of_very_many_copies(spark, monkeypatch):
    """Their component is sent to all tasks; rows without words meet none."""
    monkeypatch.setattr(parity_join, "HOT_COPIES", 3)
    base = " ".join(f"w{k}" for k in range(40))
    rows = [(i, base) for i in range(10, 30)] + [(5, base + " x"), (40, None), (41, ""), (42, "a b")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in parity_join.link(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == {d: (n, c) for d, n, c in slow(rows)}


def test_bucket_rows_are_two_numbers():
    """Bucket rows are 16 bytes, whatever the set; ids and sizes come back from them, sizes beyond MOST_N as MOST_N; and
    counts of few take few bytes."""
    top = 1 << (parity_join.ID_BITS - 1)
    rows = [(np.array([7 << 16, (9 << 16) + 5], np.uint64), np.array([0, 3]), 12, -top), (np.array([7 << 16], np.uint64), np.array([0]), 10**6, top - 1)]
    batch = parity_join._rows(rows)
    assert [str(t) for t in batch.schema.types] == ["int64", "int64"]
    assert batch.column("bucket").to_pylist() == [7 << 16, (9 << 16) + 3, 7 << 16]
    assert [m >> parity_join.ID_BITS for m in batch.column("member").to_pylist()] == [12, 12, parity_join.MOST_N]
    import pyarrow as pa

    together = [pa.array([7 << 16, 7 << 16]), pa.array(sorted(batch.column("member").to_pylist())[::2])]
    out = list(parity_join._near_pairs([pa.RecordBatch.from_arrays(together, ["bucket", "member"])]))
    assert all(i in (-top, top - 1) for b in out for i in b.column("x").to_pylist() + b.column("y").to_pylist())
    assert len(parity_join._packed(np.repeat(np.array([0, 1], np.int64), [60_000, 40]))) < 10_000
