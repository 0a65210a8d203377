"""Search and look-alike words against plain versions, on tables made for their rare cases."""

import math
import random
import re
from collections import Counter

import pytest

from tessera.plans import knowledge


def slow_bm25(docs, items):
    split = lambda t: re.findall("[a-z]+", t.lower())
    counts = {d: Counter(split(t)) for d, t in docs}
    size = {d: sum(c.values()) for d, c in counts.items()}
    mean, n = sum(size.values()) / len(docs), len(docs)
    df = Counter(w for c in counts.values() for w in c)
    out = []
    for item, text in items:
        scores = []
        for d, c in counts.items():
            own = [w for w in set(split(text)) if w in c]
            if own:
                scores.append((-round(sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * size[d] / mean)) for w in own), 6), d))
        out += [(item, d, -s, k + 1) for k, (s, d) in enumerate(sorted(scores)[:10])]
    return out


@pytest.mark.parametrize("most", [50_000, 0])
def test_bm25_of_frequent_words(spark, tmp_path, monkeypatch, most):
    """A third of all documents are copies that hold an item's words; another item has a word of all documents only."""
    monkeypatch.setattr(knowledge, "BROADCAST_WORDS", most)
    rng = random.Random(1)
    texts = [" ".join(rng.choice("abcdefghij") * rng.choice([1, 2, 3]) for _ in range(rng.randrange(3, 30))) + " the" for _ in range(60)]
    docs = list(enumerate(texts + ["hot passage of the copies"] * 30))
    items = [(0, "hot passage"), (1, "The"), (2, "a bb ccc the hot"), (3, "absent"), (4, "")]
    spark.createDataFrame(docs, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = sorted((tuple(r) for r in knowledge.bm25_search(spark, str(tmp_path)).select("item_id", "doc_id", "score", "rank").collect()), key=lambda r: (r[0], r[3]))
    want = slow_bm25(docs, items)
    assert [(r[0], r[1], r[3]) for r in got] == [(r[0], r[1], r[3]) for r in want]
    assert [r[2] for r in got] == pytest.approx([r[2] for r in want], abs=2e-6)
    assert {r[0] for r in got} == {0, 1, 2}


def edits(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for k, y in enumerate(b, 1):
            row.append(min(last[k] + 1, row[-1] + 1, last[k - 1] + (x != y)))
        last = row
    return last[-1]


def test_lookalikes_two_edits_apart(spark, tmp_path):
    rng = random.Random(2)
    found = {"austria", "australia", "monet", "manet", "mona", "abc", "abd", "aaaaaaaaa", "aaaabaaba"}
    for n in (4, 5, 6, 7, 8, 9, 12) * 6:
        base = "".join(rng.choice("abcd") for _ in range(n))
        found.add(base)
        for _ in range(6):
            w = base
            for _ in range(rng.choice([1, 2, 2, 3])):
                i = rng.randrange(len(w))
                w = rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("abcd") + w[i:], w[:i] + rng.choice("abcd") + w[i + 1 :]])
            found.add(w)
    ws = sorted(w for w in found if len(w) >= 4)
    want = {(a, b) for i, a in enumerate(ws) for b in ws[i + 1 :] if a not in b and b not in a and edits(a, b) <= (1 if max(len(a), len(b)) < 8 else 2)}
    lengths = {tuple(sorted((len(a), len(b)))) for a, b in want if edits(a, b) == 2}
    assert {(7, 8), (8, 8), (8, 9)} <= lengths and lengths & {(6, 8), (7, 9)}
    pages = [(k, f"<html><title>{w}</title></html>") for k, w in enumerate(sorted(found))]
    spark.createDataFrame(pages, "page_id long, html string").repartition(3).write.parquet(str(tmp_path / "pages.parquet"))
    assert {(r.a, r.b) for r in knowledge.lookalike_words(spark, str(tmp_path)).collect()} == want
