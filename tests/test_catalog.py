"""Every query with SQL against DuckDB on whole tables; every other one gives rows with a stable schema."""

import math

import duckdb
import pytest

from tessera import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 5) + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    return x


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_oracle(spark, sf_dir, db, name):
    got = catalog.QUERIES[name](spark, sf_dir)
    want = db.sql(catalog.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    a = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=str)
    at = [want.columns.index(c) for c in columns]
    b = sorted((tuple(plain(r[k]) for k in at) for r in want.fetchall()), key=str)
    assert a == b and a


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_rows(spark, sf_dir, name):
    assert catalog.QUERIES[name](spark, sf_dir).count() > 0


def test_patterns_need_no_stack(spark, tmp_path):
    """A megabyte made for each repeated group of a pattern: capitalised words, brackets, tags, numbers, quotations."""
    from pyspark.sql import functions as F

    from tessera.functions.answers import judge, parse
    from tessera.plans.study import key_terms
    from tessera.plans.terms import clue_terms
    from tessera.sources.tables import without_tags

    units = ["Anna Berg ", "the red barn ", "1,234 ", '"so on" ', "A. ", "word "]
    docs = spark.createDataFrame([(k, u * (1_000_000 // len(u))) for k, u in enumerate(units)], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert key_terms(spark, str(tmp_path)).count() and clue_terms(spark, str(tmp_path)).count()
    lines = ["x " + "(a) " * 5_000, "x [" + "(a) " * 5_000 + "]", "(" * 20_000, "x " + "[accept y] " * 1_000, "<b>" * 1_000]
    rows = spark.createDataFrame([(t,) for t in lines], "t string").select(parse(F.col("t")).alias("p"), F.length(without_tags(F.concat("t", F.lit(" <An Author>")))).alias("n"))
    assert [r.n > 0 for r in rows.select("n", judge(F.lit("y"), F.col("p"))).collect()] == [True] * 4 + [False]
