"""Answer lines and judging, picks, linkage and review folds against plain versions."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions.answers import judge, parse
from tessera.operators import diverse
from tessera.operators.diverse import diverse_pick, greedy, linkage
from tessera.functions.text import normalize
from tessera.plans.study import ORACLES, answer_lines, answer_parse, answer_verdicts, average_linkage
from tessera.streaming.review import fold, interval, review

LINE = "<b><u>Ada Lovelace</u></b> [accept Ada King; or Countess of Lovelace; prompt on Ada; do not accept Byron (if given first)]"


def test_parse(spark):
    rows = spark.createDataFrame([(LINE,), ("plain answer",), ("",), (None,), ("x [huh; accept y",)], "line string").select(parse(F.col("line")).alias("p")).select("p.*").collect()
    a = rows[0]
    assert (a.main, a.required, [x.text for x in a.accept], [x.text for x in a.prompt]) == ("Ada Lovelace", ["Ada Lovelace"], ["Ada King", "Countess of Lovelace"], ["Ada"])
    assert [(x.text, x.condition) for x in a.reject] == [("Byron", "if given first")] and a.confidence == 1.0
    assert (rows[1].main, rows[1].accept, rows[1].confidence) == ("plain answer", [], 1.0)
    assert rows[2].issues == rows[3].issues == ["empty_main"] and rows[3].confidence == 0.0
    assert rows[4].issues == ["unbalanced", "unrecognised"] and rows[4].accept[0].text == "y"


@pytest.mark.parametrize(("given", "verdict"), [("ada lovelace", "correct"), ("Ada King", "correct"), ("Ada", "prompt"), ("Byron", "incorrect"), ("Ada Lovelase", "correct"), ("the great Ada Lovelace", "correct"), ("Lord Byron", "incorrect"), ("Babbage", "incorrect"), ("", "incorrect")])
def test_judge(spark, given, verdict):
    assert spark.createDataFrame([(LINE, given)], "line string, given string").select(judge(F.col("given"), parse(F.col("line")))).first()[0] == verdict


def test_linkage_is_average():
    rng = np.random.default_rng(1)
    v = rng.normal(size=(25, 6))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    groups = [[i] for i in range(25)]
    apart = np.clip(1 - v @ v.T, 0, 2)
    while True:
        pairs = [(np.mean([apart[x, y] for x in a for y in b]), i, k) for i, a in enumerate(groups) for k, b in enumerate(groups) if i < k]
        d, i, k = min(pairs)
        if d >= 0.6:
            break
        groups[i] += groups.pop(k)
    got = linkage(v, 0.6)
    assert sorted(sorted(np.flatnonzero(got == c).tolist()) for c in set(got)) == sorted(map(sorted, groups))


@pytest.mark.parametrize(("local", "block"), [(4096, 4096), (20, 16)])
def test_all_rows_are_clustered(spark, tmp_path, monkeypatch, local, block):
    """The registered query over labels of far more than 60 rows, copies included, against plain linkage."""
    monkeypatch.setattr(diverse, "LOCAL", local)
    monkeypatch.setattr(diverse, "BLOCK", block)
    rng = np.random.default_rng(2)
    rows = []
    for label, n in enumerate((150, 1, 90)):
        v = rng.normal(size=(n, 8))
        v[n // 2 : n // 2 + n // 8] = v[0]
        v = (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)
        rows += [(1000 * label + int(i), x.tolist(), label) for i, x in zip(rng.permutation(n), v, strict=True)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3).write.parquet(str(tmp_path / "embeddings.parquet"))
    want = []
    for label in range(3):
        own = sorted((i, x) for i, x, k in rows if k == label)
        want += [(label, i, int(c)) for (i, _), c in zip(own, linkage(np.array([x for _, x in own]), 0.9), strict=True)]
    got = sorted(tuple(r) for r in average_linkage(spark, str(tmp_path)).select("topic", "id", "cluster").collect())
    assert got == want and len({r[2] for r in got if r[0] == 0}) > 3


def test_picks(spark):
    rows = [(1, i, float(-i), [float(np.cos(i)), float(np.sin(i))]) for i in range(80)]
    df = spark.createDataFrame(rows, "topic long, id long, impact double, vector array<float>")
    got = {r.id: r.place for r in diverse_pick(df).collect()}
    want = dict(greedy(list(range(60)), np.array([r[3] for r in rows[:60]], np.float32), 10, 0.5)) | {i: None for i in range(60, 80)}  # rows beyond the candidates are returned, too
    assert got == want and sum(p is not None for p in got.values()) >= 2


def test_reviews(spark):
    rows = [(c, float(86400 * (k * k + c) + (k % 3)), 1 + (k * c) % 4) for c in range(1, 30) for k in range(c % 9 + 1)]
    got = {r.card: r for r in fold(spark.createDataFrame(rows, "card long, at double, rating int").repartition(4)).collect()}
    for c in range(1, 30):
        own = sorted(r[1:] for r in rows if r[0] == c)
        state, last = None, own[0][0]
        for at, rating in own:
            state, last = review(state, rating, (at - last) / 86400), at
        r = got[c]
        assert (r.n_reviews, r.lapses, r.stability, r.difficulty, r.interval_days) == (len(own), sum(x == 1 for _, x in own), *state, interval(state[0]))
    assert review(None, 3, 0)[0] == 3.173 and interval(3.173) == 3


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left, row[0] = row[0], i
        for k, y in enumerate(b, 1):
            left, row[k] = row[k], min(row[k] + 1, row[k - 1] + 1, left + (x != y))
    return row[-1]


def test_verdicts(spark, sf_dir):
    """The query against a plain judge over the same lines; every verdict occurs."""
    norm = lambda xs: F.transform(xs, lambda x: normalize(x["text"]))
    p = parse(F.col("line"))
    lines = {r.page_id: r for r in answer_lines(spark, sf_dir).select("page_id", normalize(p["main"]).alias("main"), F.transform(p["required"], normalize).alias("required"), norm(p["accept"]).alias("accept"), norm(p["prompt"]).alias("prompt"), norm(p["reject"]).alias("reject")).collect()}
    seen = set()
    for r in answer_verdicts(spark, sf_dir).withColumn("given", normalize(F.col("reply"))).collect():
        x, given = lines[r.page_id], r.given
        right = [x.main, *x.accept]
        wrong = [w for w in x.reject if w not in right]
        near = lambda names: any(len(w) >= 4 and edits(w, given) * 200 <= 15 * (len(w) + len(given)) for w in names)  # noqa: B023, E731
        held = lambda names: any(w and f" {w} " in f" {given} " for w in names)  # noqa: B023, E731
        steps = [(given == "" or given in x.reject, "incorrect"), (given in right, "correct"), (given in x.prompt, "prompt"), (held(wrong), "incorrect"), (held(x.required), "correct"), (near(wrong), "incorrect"), (near(right), "correct"), (near(x.prompt), "prompt")]
        want = next((v for ok, v in steps if ok), "incorrect")
        assert r.verdict == want, (r, x)
        seen.add((r.kind, r.verdict))
    assert {("accepted", "correct"), ("prompted", "prompt"), ("rejected", "incorrect"), ("misspelled", "correct"), ("within", "correct"), ("other", "incorrect"), ("none", "incorrect")} <= seen


PAGES = [
    ("Ada Lovelace wrote", ["Ada King", "x", "y", "Ada Lovelace wrote"]), ("The Raven.", ["a", "b", "c", "raven"]), ("To", ["a", "b", "c", "to"]), ("none", []), ("$$$ *** %%%", ["a"]), ("日本 語 史", ["東京"]), ("", ["a", "b"]), (". ,", []),
    ("Rain“ ”now “x”", ["What if it rains", "the day before tomorrow", "“After” hours", "not until noon"]), ("Two\nlines\there or more", ["a  b", "c\td\ne", "  f  ", " g"]), ("a > b", [" ", "or", "on", "accept or x"]),
    ("A a A", ["if", "before", "prompt on", "do not accept"]),
]


def test_lines_as_sql(spark, tmp_path):
    """Answers that a line itself rejects, without letters or words, and links with conditions, quotes and white space."""
    rows = [(k, f"<title>{t}</title>" + "".join(f'<a href="u">{x}</a>' for x in links)) for k, (t, links) in enumerate(PAGES)] + [(100, None), (101, ""), (102, "<title>a</title")]
    spark.createDataFrame(rows, "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    want = con.sql(ORACLES["answer_parse"])
    got = sorted(tuple(r) for r in answer_parse(spark, str(tmp_path)).select(*want.columns).collect())
    assert got == sorted((*r[:6], float(r[6]), r[7]) for r in want.fetchall())


@pytest.mark.parametrize("times", [1, 32])
def test_large_labels_by_rounds_and_in_one_task(spark, monkeypatch, times):
    """More clusters than LOCAL, a hundred of them equally near: plain linkage, no table stored for rounds where a task holds the means."""
    monkeypatch.setattr(diverse, "LOCAL", 100)
    monkeypatch.setattr(diverse, "BLOCK", 64)
    monkeypatch.setattr(diverse, "TIMES", times)
    rng = np.random.default_rng(4)
    v = rng.normal(size=(300, 12))
    v = np.concatenate([np.c_[v, np.zeros((300, 100))], np.c_[np.ones((100, 12)), 2 * np.eye(100)]])  # the last hundred are equally near one another
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    calls = []
    monkeypatch.setattr(diverse, "stored", lambda df, real=diverse.stored: calls.append(1) or real(df))
    rows = spark.createDataFrame([(1, k, x.tolist()) for k, x in enumerate(v)], "topic long, id long, vector array<double>").repartition(3)
    got = [r.cluster for r in diverse.clusters(rows, 0.5).orderBy("id").collect()]
    assert got == linkage(v, 0.5).tolist() and len(set(got[300:])) == 1
    assert len(calls) == 5 if times == 32 else 5 < len(calls) < 90
