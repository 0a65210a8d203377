"""Names in texts against a plain matcher with owners in lists, each rule by a case of its own, odd rows."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.functions.keys import tokenized
from tessera.operators import names as N
from tessera.plans.mentions import name_mentions, named_texts, part_names

NAME = "key string, owner string, category string, proper boolean, weak boolean, single boolean, title boolean, own boolean, usable boolean"
TEXT = "id long, text string, category string, exclude string"


def name(key, owner, category="C", **changes):
    flags = {"proper": True, "weak": False, "single": " " not in key, "title": False, "own": True, "usable": True} | changes
    return (key, owner, category, *flags.values())


def plain_choice(owners, category):
    if len(owners) == 1:
        return owners[0] if owners[0]["usable"] else None
    local = [o for o in owners if o["category"] == category]
    if len(local) > 1 and any(o["own"] for o in local):
        local = [o for o in local if o["own"]]
    if owners[0]["single"]:
        if len(local) == 1 and local[0]["own"] and local[0]["usable"]:
            return local[0]
        pool = [o for o in owners if o["usable"] and not o["weak"]]
    elif local:
        pool = local if len(local) == 1 and local[0]["usable"] else []
    else:
        pool = [o for o in owners if o["title"] and o["usable"] and not o["weak"]]
    return pool[0] if len(pool) == 1 else None


def plain_find(text, names, name_like, category, exclude):
    """Hits (key, owner, start, end), walking over the tokens."""
    by_key = {}
    for r in names:
        by_key.setdefault(r[0], []).append(dict(zip(("owner", "category", "proper", "weak", "single", "title", "own", "usable"), r[1:], strict=True)))
    tokens, hits, i = tokenized(text or ""), [], 0
    capital = lambda k: 0 <= k < len(tokens) and tokens[k][3] and tokens[k][0] not in N.STOP_WORDS
    while i < len(tokens):
        step = 1
        for n in range(min(N.MOST_WORDS, len(tokens) - i), 0, -1):
            span = tokens[i : i + n]
            owners = [o for o in by_key.get(" ".join(t[0] for t in span), []) if o["owner"] != exclude]
            got = plain_choice(owners, category) if owners else None
            if not got or got["weak"] and got["category"] != category:
                continue
            if got["proper"]:
                if not all(t[3] or t[0] in N.STOP_WORDS for t in span) or capital(i + n):
                    continue
                if capital(i - 1) and (i - 1 > 0 or tokens[0][0] in name_like):
                    continue
            hits.append((" ".join(t[0] for t in span), got["owner"], span[0][1], span[-1][2]))
            step = n
            break
        i += step
    return hits


CASES = [
    ([name("river cup finals", "cup"), name("cup finals", "other")], "They met at the River Cup Finals.", "C", None, ["cup"]),
    ([name("my garden", "film")], "He said in my garden it rains.", "C", None, []),
    ([name("my garden", "film")], "He saw My Garden twice.", "C", None, ["film"]),
    ([name("orlov", "painter")], "Sent off by Dr. Orlov.", "C", None, []),
    ([name("orlov", "painter")], "Sent off by Orlov.", "C", None, ["painter"]),
    ([name("orlov", "painter")], "Anna Orlov came.", "C", None, []),
    ([name("orlov", "painter")], "Yesterday Orlov came.", "C", None, ["painter"]),
    ([name("sybilla", "tv", "Z", weak=True)], "A note to Sybilla.", "C", None, []),
    ([name("sybilla", "tv", "Z", weak=True)], "A note to Sybilla.", "Z", None, ["tv"]),
    ([name("long ferry", "film", "Z", title=True), name("long ferry", "book", "C")], "It is in Long Ferry again.", "C", None, ["book"]),
    ([name("long ferry", "film", "Z", title=True), name("long ferry", "book", "C")], "It is in Long Ferry again.", "Q", None, ["film"]),
    ([name("long ferry", "film", "Z", title=True), name("long ferry", "book", "C")], "It is in Long Ferry again.", "C", "book", ["film"]),
    ([name("tide cycle", "tides", proper=False, title=True), name("tide cycle", "sea", proper=False, own=False)], "It feeds the tide cycle.", "C", None, ["tides"]),
    ([name("meridia", "ship", weak=True, own=False), name("meridia", "school", "S", weak=True)], "She taught at Meridia.", "C", None, []),
    ([name("order", "local", weak=True), name("order", "knights", "H", weak=True, own=False)], "He joins the Order.", "C", None, ["local"]),
    ([name("unap", "body", "E", title=True), name("unap", "game", "P", weak=True, own=False)], "Run by UNAP.", "C", None, ["body"]),
    ([name("rare name", "x", usable=False)], "A Rare Name it is.", "C", None, []),
    ([name("red mill farm", "x", usable=False), name("red mill", "mill", proper=False)], "The red mill farm.", "C", None, ["mill"]),
    ([name("salt and bread", "dish", proper=False)], "Salt & bread, salt and bread", "C", None, ["dish", "dish"]),
]


@pytest.mark.parametrize("broadcast", [0, 1 << 20])
def test_cases(spark, monkeypatch, broadcast):
    monkeypatch.setattr(N, "BROADCAST_BYTES", broadcast)
    like = spark.createDataFrame([("anna",)], "word string")
    names, texts = [], []
    for k, (own, text, category, exclude, _) in enumerate(CASES):  # each case has words of its own
        tag = lambda t: " ".join(f"{w}{'abcdefghijklmnopqrstu'[k]}" if w.strip(".&,").isalpha() and w.lower().strip(".,") not in N.STOP_WORDS | {"anna", "dr"} else w for w in t.replace(".", " .").replace(",", " ,").split())  # noqa: E731, B023
        names += [(tag(r[0]), *r[1:]) for r in own]
        texts.append((k, tag(text), category, exclude))
    got = {}
    for r in N.find(spark.createDataFrame(texts + [(90, None, "C", None), (91, "", None, None)], TEXT), spark.createDataFrame(names, NAME), like).orderBy("start").collect():
        got.setdefault(r.id, []).append((r.key, r.owner, r.start, r.end))
    for (_, text, *_, want), (k, tagged, category, exclude) in zip(CASES, texts, strict=True):
        hits = plain_find(tagged, names, {"anna"}, category, exclude)
        assert got.get(k, []) == hits and [h[1] for h in hits] == want, text


def test_any(spark):
    rng = random.Random(3)
    words = ["Red", "red", "Mill", "mill", "the", "of", "Orlov", "cup", "Cup", "A", "Źdź", "&", "7"]
    keys = sorted({" ".join(t[0] for t in tokenized(" ".join(rng.choice(words) for _ in range(rng.randrange(1, 5))))) for _ in range(60)})
    flag = lambda: rng.random() < 0.6
    names = [name(k, f"o{j}", rng.choice(["C", "D", None]), proper=flag(), weak=flag(), title=flag(), own=flag(), usable=flag()) for k in keys for j in range(rng.choice([1, 1, 2, 3, 5]))]
    texts = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(40))), rng.choice(["C", "D", None]), rng.choice([None, None, "o0", "o1"])) for i in range(400)]
    got = {}
    for r in N.find(spark.createDataFrame(texts, TEXT), spark.createDataFrame(names, NAME), spark.createDataFrame([("red",)], "word string")).orderBy("start").collect():
        got.setdefault(r.id, []).append((r.key, r.owner, r.start, r.end))
    want = {i: h for i, t, c, x in texts if (h := plain_find(t, names, {"red"}, c, x))}
    assert got == want and sum(map(len, got.values())) > 300


def test_reject_targets(spark):
    names = [name("the grey ship", "x"), name("grey ship", "book", "C", title=True), name("grey ship", "ship", "D"), name("orlov", "painter"), name("anna berg", "berg")]
    rows = [(1, "The Grey Ship", "C", "book"), (2, "grey ship", "C", None), (3, "the painter Orlov", "C", None), (4, "a very long story by Orlov", "C", None), (5, "Anna Berg or Orlov", "C", "berg"), (6, None, None, None)]
    got = sorted(tuple(r) for r in N.reject_targets(spark.createDataFrame(rows, TEXT), spark.createDataFrame(names, NAME), spark.createDataFrame([], "word string")).collect())
    assert got == [(1, "ship"), (2, "book"), (3, "painter")]


def test_dictionary(spark):
    rows = [
        ("t1", "C", "The Red Mill", "title", 2.0), ("t1", "C", "red mill", "accept", 0.5), ("t2", "D", "Red Mill", "accept", 0.5), ("t3", "D", "UNAP", "title", 2.0), ("t4", "D", "Orlov", "main", 1.0), ("t5", None, "tide cycle", "accept", 1.5), ("t6", "D", "1234", "title", 1.0), ("t7", "D", "end of", "title", 1.0), ("t8", None, None, "title", 1.0),
    ]
    share = spark.createDataFrame([("unap", 1.0), ("orlov", 0.2)], "word string, share double")
    got = {(r.key, r.owner): (r.category, r.proper, r.weak, r.single, r.title, r.own, r.usable) for r in N.dictionary(spark.createDataFrame(rows, "owner string, category string, alias string, source string, weight double"), share).collect()}
    assert got == {
        ("red mill", "t1"): ("C", True, False, False, True, True, True), ("red mill", "t2"): ("D", True, False, False, False, False, False), ("unap", "t3"): ("D", True, False, True, True, True, True), ("tide cycle", "t5"): (None, False, True, False, False, False, True),
    }


def test_generic_names_go(spark):
    names = spark.createDataFrame([name("tide", "a", proper=False), name("Orlov", "b")], NAME)
    found = spark.createDataFrame([(i, k, o, 0, 1) for i in range(6) for k, o in (("tide", "a"), ("Orlov", "b"))], "id long, key string, owner string, start int, end int")
    topics = spark.createDataFrame([(i, f"t{i % 5}") for i in range(6)], "id long, topic string")
    assert {r.key for r in N.without_generic(found, names, topics, 4).collect()} == {"Orlov"} and N.without_generic(found, names, topics, 5).count() == 12


def test_query_against_a_plain_matcher(spark, sf_dir):
    names = [tuple(r) for r in part_names(spark, sf_dir).select(*[c.split()[0] for c in NAME.split(", ")]).collect()]
    texts = named_texts(spark, sf_dir).collect()
    want = {}
    for r in texts:
        for key, owner, *_ in plain_find(r.text, names, {"red"}, r.category, None):
            n, ids = want.get((key, owner), (0, set()))
            want[key, owner] = (n + 1, ids | {r.id})
    got = {(r.key, r.owner): (r.n_mentions, r.n_texts) for r in name_mentions(spark, sf_dir).collect()}
    assert got == {k: (n, len(ids)) for k, (n, ids) in want.items()} and len(got) > 20


def test_empty(spark):
    none = spark.createDataFrame([], NAME)
    texts = spark.createDataFrame([(1, "a text", "C", None)], TEXT)
    assert N.find(texts, none, spark.createDataFrame([], "word string")).collect() == []
    assert N.find(texts.limit(0), spark.createDataFrame([name("text", "x")], NAME), spark.createDataFrame([], "word string")).where(F.lit(True)).count() == 0
