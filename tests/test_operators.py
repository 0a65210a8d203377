"""Sources, text functions, dictionary matching, streams."""

import json
import random
import statistics

from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators.dictionary import find_phrases, longest_first
from tessera.operators.places import medians
from tessera.plans.relational import tumbling_windows
from tessera.sources.tables import question_rows, questions, read_tsv, require_table, without_tags, write_overrides, write_table
from tessera.streaming.windows import event_stream, once_each, windowed


def test_questions(spark, tmp_path):
    rows = [
        {"_id": {"$oid": "a1"}, "question_sanitized": "Who?", "answer_sanitized": "Ada <AB> (1)", "category": "Science", "difficulty": {"$numberInt": "7"}, "set": {"name": "S", "year": {"$numberInt": "2020"}}},
        {"_id": "b2", "question_sanitized": "What?", "answer_sanitized": "It", "difficulty": 3},
        {"_id": {"$oid": "c3"}, "question_sanitized": "", "answer_sanitized": "x"},
        {"_id": {"$oid": "d4"}, "question_sanitized": "q", "answer_sanitized": "<AP>"},
    ]
    (tmp_path / "q.json").write_text("\n\n".join(map(json.dumps, rows)) + "\n")
    got = [tuple(r) for r in questions(spark, str(tmp_path / "q.json")).select("id", "answer", "difficulty", "year", "meta_score").orderBy("id").collect()]
    assert got == [("a1", "Ada", 7, 2020, 1), ("b2", "It", 3, None, 1)]


def test_filled_fields(spark):
    full = {"_id": "x", "question_sanitized": "q", "answer_sanitized": "a", "subcategory": "s", "alternate_subcategory": "", "difficulty": None, "number": {"$numberInt": "4"}, "packet": {"name": "p"}}
    lines = spark.createDataFrame([(json.dumps(full),)], "value string")
    assert [(r.meta_score, r.number, r.packet_name) for r in question_rows(lines).collect()] == [(3, 4, "p")]


def test_trailing_tags(spark):
    cases = [("Arc <MS>", "Arc"), ("Mons (1) [AU]", "Mons"), ("Charles I", "Charles I"), ("Novel (1984)", "Novel (1984)"), ("x [A]  [ABCD] ", "x"), ("x [ABCDE]", "x [ABCDE]"), ("<b>x</b>", "<b>x</b>"), (" x (12)<Ed. A>", "x"), ("(1)", ""), ("", ""), (None, None), ("a " + "(1)" * 200, "a")]
    df = spark.createDataFrame(cases, "a string, b string")
    assert df.where(~without_tags(F.col("a")).eqNullSafe(F.col("b"))).count() == 0


def test_tables(spark, tmp_path):
    for n in (3, 2):
        write_table(spark.range(n), str(tmp_path), "t")
    assert require_table(spark, str(tmp_path), "t", "first").count() == 2
    try:
        require_table(spark, str(tmp_path), "absent", "first")
    except RuntimeError as e:
        assert "run the first stage" in str(e)
    else:
        raise AssertionError


def test_text(spark):
    rows = [("The Éclair & Straße", "eclair and strasse"), ("A", "a"), ("an  Apple (fruit)!", "apple fruit"), (None, None), ("", "")]
    df = spark.createDataFrame(rows, "a string, b string")
    assert df.where(~X.normalize(F.col("a")).eqNullSafe(F.col("b"))).count() == 0
    pairs = spark.createDataFrame([("Monet", "Manet", True), ("Mona", "Monaco", False), ("abc", "abd", False), ("Henry 4", "Henry 5", False), ("Alexander", "Alexandra", True)], "a string, b string, w boolean")
    assert pairs.where(X.is_lookalike(F.col("a"), F.col("b")) != F.col("w")).count() == 0
    assert spark.range(1).select(X.text_hash(F.lit("A, b!")) == X.text_hash(F.lit("ab"))).first()[0]


def test_longest_first(spark):
    docs = spark.createDataFrame([(1, "The great fire of London burned London."), (2, "nothing"), (3, None)], "doc_id long, text string")
    phrases = spark.createDataFrame([("great fire", 1), ("fire of london", 2), ("great fire of london", 3), ("London", 4)], "phrase string, owner long")
    found = find_phrases(docs, phrases)
    assert found.count() == 5
    assert [tuple(r) for r in longest_first(found).orderBy("start").collect()] == [(1, 1, 4, 3), (1, 6, 1, 4)]


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    spark.read.parquet(f"{sf_dir}/events.parquet").repartitionByRange(3, "ts").write.parquet(str(tmp_path / "in"))
    query = windowed(once_each(event_stream(spark, str(tmp_path / "in"), 10))).writeStream.format("memory").queryName("w").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    got = {tuple(r) for r in spark.table("w").collect()}
    want = {tuple(r) for r in tumbling_windows(spark, sf_dir).collect()}
    assert got and got <= want and len(got) >= 0.8 * len(want)


def test_overrides_and_tab_separated_lists(spark, tmp_path):
    old = spark.createDataFrame([("b", "keep"), ("a", "drop")], "key string, action string")
    new = spark.createDataFrame([("b", "drop"), ("c", "drop"), ("c", "drop")], "key string, action string")
    write_overrides(new, old, str(tmp_path / "o"))
    assert [tuple(r) for r in spark.read.json(str(tmp_path / "o")).select("key", "action").orderBy("key").collect()] == [("a", "drop"), ("b", "keep"), ("c", "drop")]
    (tmp_path / "t.tsv").write_text("q1\tName one\nq2\tName, two\n")
    assert [tuple(r) for r in read_tsv(spark, str(tmp_path / "t.tsv"), "topic_id string, name string").orderBy("topic_id").collect()] == [("q1", "Name one"), ("q2", "Name, two")]


def test_predicates_of_names(spark):
    rows = [("It is not the Moon.", "moon", True), ("Not a moon", "Moon", True), ("nothing moon", "moon", False), ("not moonlight", "moon", False), (None, "moon", None)]
    df = spark.createDataFrame(rows, "t string, w string, want boolean")
    assert df.where(~X.negated(F.col("t"), F.col("w")).eqNullSafe(F.col("want"))).count() == 0
    places = spark.createDataFrame([(["a", "b", "c", "b", "c"], ["b", "c"], 1), (["a"], ["a", "b"], -1), (["a"], [], 0), ([], ["a"], -1)], "l array<string>, s array<string>, want int")
    assert places.where(X.position_in(F.col("l"), F.col("s")) != F.col("want")).count() == 0
    names = spark.createDataFrame([("The Moon", True, True), ("12 34", False, False), ("of", False, False), ("old moon", True, False), ("Ab", False, False)], "a string, u boolean, p boolean")
    assert names.where((X.usable_alias(F.col("a"), ("of",)) != F.col("u")) | (X.proper_name(F.col("a")) != F.col("p"))).count() == 0


def test_edges_of_orders_of_any_size(spark, monkeypatch):
    """Orders within a row and dealt over parts give what a loop over all pairs of lines gives."""
    import random
    from collections import Counter

    from tessera.plans import relational

    rng = random.Random(6)
    rows = [(o, rng.randrange(30), k) for o in range(12) for k in range(rng.randrange(1, 9))] + [(99, rng.randrange(200), k) for k in range(600)] + [(None, 1, 1), (7, None, 3)]
    want = Counter()
    for o in {r[0] for r in rows if r[0] is not None}:
        lines = [r for r in rows if r[0] == o and r[1] is not None]
        want.update({(x[1], y[1]) for x in lines for y in lines if x[2] < y[2] and x[1] != y[1]})
    items = spark.createDataFrame(rows, "l_orderkey long, l_suppkey long, l_linenumber int").repartition(3)
    for many in (2, 64, 10_000):
        monkeypatch.setattr(relational, "MANY", many)
        assert {(r.a, r.b): r.fwd for r in relational.order_edges(items).collect()} == dict(want)


def test_picks_return_every_row(spark):
    from tessera.operators.diverse import CANDIDATES, diverse_pick

    rows = [(t, k, float(k % 7), [1.0, 0.0] if k % 2 else [0.0, 1.0]) for t in (1, 2) for k in range(CANDIDATES + 15 * t)]
    got = diverse_pick(spark.createDataFrame(rows, "topic long, id long, impact double, vector array<double>"), most=0.5).collect()
    assert sorted((r.topic, r.id) for r in got) == [r[:2] for r in rows] and sorted((r.topic, r.place) for r in got if r.place) == [(1, 1), (1, 2), (2, 1), (2, 2)]


def test_medians(spark):
    """A group of most rows, ties, one value, even and odd counts, negative values, null values and a null group."""
    rng = random.Random(5)
    groups = {"hot": [rng.randrange(-50, 50) for _ in range(3_000)], "even": [1, 2, 3, 10], "odd": [7, -1, 3], "one": [4], "ties": [2] * 9 + [5] * 9, None: [8, 9], "void": [None, None], "some": [None, 6]}
    rows = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, v long")
    counts = rows.groupBy("g", "v").agg(F.count("*").alias("k"))
    want = {g: float(statistics.median([v for v in vs if v is not None])) for g, vs in groups.items() if g != "void"}
    assert {r.g: r.median for r in medians(counts, "g", "v", "k").collect()} == want
    assert medians(counts.where("false"), "g", "v", "k").count() == 0
