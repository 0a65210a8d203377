"""Edits of clues against a plain version, one edit after another; chains, cycles, groups at exactly half."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators.cleanup import Checked, cleaned, excluded, names_topic, settled, words
from tessera.operators.places import numbered, running

MERGES = "topic string, id long, seq long, into long"


def plain_merges(edges, drops):
    """Merges in order, each followed as far as those still standing lead."""
    into = {i: t for i, _, t in sorted(edges, key=lambda e: e[1])}
    for i, _, _ in sorted(edges, key=lambda e: e[1]):
        at, met = into[i], {i}
        while at in into and at not in met:
            met.add(at)
            at = into[at]
        if at in met or at in drops:
            del into[i]
        else:
            into[i] = at
    return into


@pytest.mark.parametrize("seed", range(4))
def test_merges_as_one_after_another(spark, seed):
    """Random graphs of 60 topics at once: trees, cycles with tails, dropped ends, any order."""
    r = random.Random(seed)
    edges, drops, want = [], [], {}
    for topic in map(str, range(60)):
        n = r.randint(2, 14)
        ids = list(range(n))
        gone = {i for i in ids if r.random() < 0.15}
        own = [i for i in ids if i not in gone and r.random() < 0.85]
        seqs = r.sample(range(100), len(own))
        mine = [(i, s, r.choice([j for j in ids if j != i])) for i, s in zip(own, seqs)]
        edges += [(topic, *e) for e in mine]
        drops += [(topic, i) for i in gone]
        want |= {(topic, i): h for i, h in plain_merges(mine, gone).items()}
    got = settled(spark.createDataFrame(edges, MERGES), spark.createDataFrame(drops, "topic string, id long")).collect()
    assert len(got) == len(edges)
    assert {(g.topic, g.id): g.home for g in got if g.home is not None} == want


def test_long_chain_and_long_cycle(spark):
    """3,000 merges in a row take twelve rounds; in a cycle of as many the earliest is undone and all others lead to it."""
    n = 3_000
    edges = [("a", k, n - k, k + 1) for k in range(n)] + [("b", k, (k * 7) % n, (k + 1) % n) for k in range(n)]
    got = settled(spark.createDataFrame(edges, MERGES), spark.createDataFrame([], "topic string, id long"))
    assert {(g.topic, g.home): g.n for g in got.groupBy("topic", "home").agg(F.count("*").alias("n")).collect()} == {("a", n): n, ("b", 0): n - 1, ("b", None): 1}


def small(spark, edits, uses=(), sources=(), clues=((1, "Copper Lantern"), (2, "lantern"), (3, "brass bells"), (4, "bell"))):
    given = lambda rows, schema: spark.createDataFrame(list(rows), schema)
    c = given([("t", i, label, i) for i, label in clues], "topic string, id long, label string, rank long")
    u = given([("t", *x) for x in uses], "topic string, id long, spelling string, question long")
    s = given([("t", *x) for x in sources], "topic string, id long, text string")
    e = given([("t", k, *x) for k, x in enumerate(edits)], "topic string, seq long, id long, action string, into long, label string, remove array<string>")
    return c, u, Checked(c, u, s, e)


def test_notes_and_labels(spark):
    edits = [
        (9, "drop", None, None, None), (None, "drop", None, None, None), (1, "merge", 1, None, None), (2, "merge", 77, None, None), (3, "rename", None, None, None), (3, "rename", None, " ", None),
        (3, "rename", None, "word " * 28, None), (1, "rename", None, "Coppper Lanterns", None), (2, "rename", None, "the glowing lantern", None), (4, "rename", None, "belt", None), (3, "rename", None, "brass & bells", None),
    ]
    _, _, got = small(spark, edits, sources=[(2, "A glowing light"), (4, None)])
    assert {(r.seq, r.note) for r in got.notes.collect()} == {
        (0, "unknown id"), (1, "unknown id"), (2, "merge into unknown"), (3, "merge into unknown"), (4, "label empty or too long"), (5, "label empty or too long"), (6, "label empty or too long"),
        (9, "label with words of its own"),
    }
    assert {r.id: r.renamed for r in got.renames.collect()} == {1: "Coppper Lanterns", 2: "the glowing lantern", 3: "brass & bells"}


def test_recount(spark):
    uses = [(1, "Copper Lantern", 1), (1, "Copper Lantern", 1), (1, "lamp", 2), (2, "lantern", 1), (2, "lantern", 3), (3, "bells", 4), (4, "bell", 4), (4, "bell", 5), (4, None, 6), (4, "bell", None), (None, "x", 7)]
    edits = [(1, "merge", 2, None, ["lamp", "no such"]), (3, "keep", None, None, ["bells"]), (4, "merge", 3, None, None)]
    c, u, checked = small(spark, edits, uses)
    groups = spark.createDataFrame([("t", g, f"answer {g}", "c", q) for q, g in ((1, 1), (2, 1), (3, 2), (4, 1), (5, 1))], "topic string, answer_group long, answer string, category string, question long")
    none = spark.createDataFrame([], "topic string, answer_group long, note string")
    rows = lambda off: [(r.id, r.label, r.n_questions, r.n_clues, r.n_spellings, r["rank"]) for r in cleaned(c, u, checked, groups, off).orderBy("rank").collect()]
    assert rows(none) == [(2, "lantern", 2, 2, 2, 1), (3, "brass bells", 2, 2, 2, 2)]
    assert rows(spark.createDataFrame([("t", 1, None), ("t", 2, "stays")], none.schema)) == [(2, "lantern", 1, 2, 1, 1)]


SIZES = [(1, "north gate", 4), (2, "south gate", 3), (3, "east gate", 3), (4, "west gate", 2)]


@pytest.mark.parametrize(
    "title, listed, gone",
    [
        ("Old Tower", [2, 3], {2, 3}),  # exactly half of twelve goes
        ("Old Tower", [1, 2], {2}),  # seven don't; the largest stays
        ("Old Tower", [2, 3, 4], {3, 4}),  # of equals the one listed first stays
        ("North Gates", [2, 3, 4], {2, 3, 4}),  # the group that names the topic is left
        ("North Gate (tower)", [1, 2], {2}),  # and is never taken in its own subject
        ("Old Tower", [2, 2, 3], {2, 3}),
        (None, [4], {4}),
    ],
)
def test_off_topic(spark, title, listed, gone):
    groups = spark.createDataFrame([("t", g, a, "c", 100 * g + k) for g, a, n in SIZES for k in range(n)], "topic string, answer_group long, answer string, category string, question long")
    topics = spark.createDataFrame([("t", title, "c")], "topic string, title string, category string")
    off = spark.createDataFrame([("t", k, g) for k, g in enumerate([*listed, 50])], "topic string, seq long, answer_group long")
    got = {r.answer_group: r.note for r in excluded(groups, topics, off).collect()}
    assert {g for g, note in got.items() if note is None} == gone
    assert set(got) == {*listed, 50} and got[50] == "unknown group"


def test_words_and_names(spark):
    rows = spark.createDataFrame([("The Émile-Zola's of x", "Emile"), ("Ballad of the Two Mills by Verne", "Two Mills (Verne)"), ("two mills and a wide river bank", "Two Mill"), ("", ""), (None, "x"), ("x", None)], "a string, t string")
    got = rows.select(words(F.col("a")).alias("w"), names_topic(F.col("a"), F.col("t")).alias("n")).collect()
    assert sorted(got[0].w) == ["emile-zola's", "x"] and [r.n for r in got] == [False, True, False, False, False, False]
    assert rows.select(F.size(words(F.repeat(F.lit("a-"), 500_000))).alias("n")).first().n == 1


def test_places_in_a_hot_group(spark):
    """A group of nine tenths of the rows is cut into ranges; places and sums as in a window over it."""
    rows = spark.range(20_000).select(F.when(F.col("id") % 10 == 0, F.col("id") % 7).otherwise(99).cast("string").alias("g"), (F.col("id") * 7919 % 20_011).alias("o"))
    got = running(numbered(rows.repartition(8), "g", [F.col("o").desc()], "place"), "g", [F.col("place")], F.col("o"), "upto").collect()
    by = {}
    for r in sorted(got, key=lambda r: (r.g, -r.o)):
        n, s = by.get(r.g, (0, 0))
        by[r.g] = (n + 1, s + r.o)
        assert (r.place, r.upto) == by[r.g]
    assert len(got) == 20_000
