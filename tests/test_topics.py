"""Topics: names claimed in order, sets of one answer, overrides, ids and slugs; the queries against a plain version one after another."""

import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tessera.operators import topics as operator
from tessera.operators.topics import claimed, slug_wishes, topic_table, with_topics
from tessera.plans import topics as plan

GROUPS = "group long, key string, name string, category string, members long"
LINKS = "group long, topic string, title string"
UNLINKS = "key string, category string, topic string"


def one_by_one(rows):
    """{key: name} of (key, order, wants), in order."""
    taken, out = set(), {}
    for key, _, wants in sorted(rows, key=lambda r: r[1]):
        names = iter(wants + [f"{wants[-1]}-{k}" for k in range(2, len(rows) + 3)])
        out[key] = next(n for n in names if n not in taken)
        taken.add(out[key])
    return out


def test_claims_as_one_by_one(spark):
    rng = random.Random(11)
    for n, names in ((60, 6), (200, 40), (1, 1)):
        rows = [(k, o, [rng.choice("abcdefghijklmnopqrstuvwxyz"[: min(names, 26)]) + "-2" * rng.randrange(3) for _ in range(rng.randrange(1, 4))]) for k, o in enumerate(rng.sample(range(10 * n), n))]
        got = claimed(spark.createDataFrame(rows, "k long, o long, wants array<string>"), "k", "o").collect()
        assert {r.k: r.name for r in got} == one_by_one(rows)
    assert claimed(spark.createDataFrame([], "k long, o long, wants array<string>"), "k", "o").count() == 0


def test_one_name_wanted_by_most(spark, monkeypatch):
    """2,000 rows want one name first and their own second: two rounds, each of which stores two tables, not 2,000."""
    made, stored = [], operator.stored
    monkeypatch.setattr(operator, "stored", lambda df: made.append(1) or stored(df))
    rows = spark.range(2_000).select(F.col("id").alias("k"), (-F.col("id")).alias("o"), F.array(F.lit("x"), F.concat(F.lit("x-"), F.col("id"))).alias("wants"))
    got = {r.k: r.name for r in claimed(rows, "k", "o").collect()}
    assert got == {k: "x" if k == 1_999 else f"x-{k}" for k in range(2_000)}
    assert len(made) == 4


def test_slug_wishes(spark):
    names = [("Jungle", "Q1"), ("The Jungle", "local:jungle"), ("", "Q3"), (None, "Q4"), ("Ægir & Søn", "Q5"), ("?!", "local:")]
    got = [r.w for r in spark.createDataFrame(names, "n string, t string").select(slug_wishes(F.col("n"), F.col("t")).alias("w")).collect()]
    assert got == [["jungle", "jungle", "jungle-q1"], ["jungle", "the-jungle", "jungle-jungle"], ["topic", "topic-q3"], ["topic", "topic-q4"], ["aegir-and-son", "aegir-and-son", "aegir-and-son-q5"], ["topic", "topic-"]]


def test_small(spark):
    """Links, an override with and without category, chains, equal keys kept apart, a key that is another's id with brand, no link, null key."""
    groups = [
        (1, "root", "Root", "Biology", 9), (2, "root", "roots", "Math", 8), (3, "root", "Root", "Math", 7), (4, "root", "Root", "Math", 2), (5, "root", "Root", "Biology", 1),
        (6, "root math", "Root Math", "Math", 50), (7, "ring", "Ring", "Opera", 5), (8, "ring", "Rings", None, 4), (9, "ring", "Ring", "Opera", 3), (10, None, None, None, None), (None, "x", "x", "x", 1),
    ]
    links = [(7, "Q7", "The Ring"), (8, "Q7", "The Ring"), (9, "Q8", "Ring"), (6, None, None)]
    unlinks = [("ring", None, "Q7"), ("ring", "Opera", "Q9")]
    shared = [(1, "u"), (5, "u"), (6, "u"), (2, "v"), (9, "v"), (3, "w"), (4, "w"), (4, "w"), (2, None), (3, None), (None, "w")]
    rows = with_topics(spark.createDataFrame(groups, GROUPS), spark.createDataFrame(links, LINKS), spark.createDataFrame(unlinks, UNLINKS), spark.createDataFrame(shared, "group long, thing string"))
    got = {r.group: r.topic for r in rows.collect()}
    # 6 comes before all and takes local:root-math; of the sets {1, 5}, {2}, {3, 4} the first has the plain id, the second finds its own taken
    assert got == {1: "local:root", 5: "local:root", 6: "local:root-math", 2: "local:root-math-2", 3: "local:root-math-3", 4: "local:root-math-3", 7: "Q7", 8: "local:ring", 9: "Q8", 10: "local:"}
    table = {r.topic: (r.slug, r.name, r.n_groups, r.members, r.category) for r in topic_table(rows).collect()}
    assert table["Q7"] == ("ring", "The Ring", 1, 5, "Opera") and table["local:ring"] == ("rings", "Rings", 1, 4, None) and table["Q8"] == ("ring-q8", "Ring", 1, 3, "Opera")
    assert table["local:root"] == ("root", "Root", 2, 10, "Biology") and table["local:"][0] == "topic" and len({v[0] for v in table.values()}) == len(table)


def test_empty(spark):
    rows = with_topics(*(spark.createDataFrame([], s) for s in (GROUPS, LINKS, UNLINKS, "group long, thing string")))
    assert rows.count() == 0 and topic_table(rows).count() == 0


def test_queries_as_plain(spark, sf_dir):
    """Both queries over the whole tables against groups walked one after another."""
    groups, links, unlinks, _ = (t.collect() for t in plan.topic_inputs(spark, sf_dir))
    plain = lambda t: re.sub("^(?:the|an|a) (?=.)", "", re.sub("[^a-z0-9]+", " ", t.lower()).strip())
    slug = lambda t: plain(t).replace(" ", "-")
    link, no = {r.group: r for r in links}, {tuple(r) for r in unlinks}
    topic = {g.group: link[g.group].topic for g in groups if g.group in link and (g.key, g.category, link[g.group].topic) not in no}
    free = {g.group: g for g in groups if g.group not in topic}
    orders = defaultdict(set)
    for r in spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_partkey").collect():
        if r.l_partkey in free:
            orders[r.l_orderkey, free[r.l_partkey].key].add(r.l_partkey)
    near = defaultdict(set)
    for same in orders.values():
        for a in same:
            near[a] |= same
    seen, sets = set(), []
    for g in sorted(free):
        todo, found = [g], set()
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                found.add(x)
                todo += near[x]
        if found:
            sets.append(sorted(found, key=lambda x: (-free[x].members, x)))
    rank = lambda s: (-free[s[0]].members, s[0])
    lead, wishes = {}, []
    for s in sorted(sets, key=rank):
        first = free[s[0]]
        base, behind = f"local:{slug(first.key)}", slug(first.category)
        wants = [f"{base}-{behind}", f"{base}-{behind}-{first.group}"]
        wishes.append((s[0], rank(s), wants if lead.setdefault(first.key, s[0]) != s[0] else [base, *wants]))
    ids = one_by_one(wishes)
    topic |= {g: ids[s[0]] for s in sets for g in s}
    assert {r.group: r.topic for r in plan.part_topics(spark, sf_dir).collect()} == topic
    assert len(set(ids.values())) == len(ids) > len(lead) and len(ids) < len(free)

    of = defaultdict(list)
    for g in groups:
        of[topic[g.group]].append(g)
    want, wishes = {}, []
    for t, gs in of.items():
        first = min(gs, key=lambda g: (-g.members, g.group))
        name = first.name if t.startswith("local:") else link[first.group].title
        by = Counter()
        for g in gs:
            by[g.category] += g.members
        n = sum(by.values())
        want[t] = (name, len(gs), n, min(by, key=lambda c: (-by[c], c)))
        whole = re.sub("[^a-z0-9]+", "-", name.lower()).strip("-")
        wishes.append((t, (-n, t), [slug(name), whole, f"{slug(name)}-{slug(t.removeprefix('local:'))}"]))
    slugs = one_by_one(wishes)
    got = {r.topic: (r.slug, r.name, r.n_groups, r.members, r.category) for r in plan.topics(spark, sf_dir).collect()}
    assert got == {t: (slugs[t], *w) for t, w in want.items()} and len({v[0] for v in got.values()}) == len(got)
