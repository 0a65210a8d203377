"""Bounds of shares against exact sums, tidy terms by cases, and the query of bounds against its table."""

from fractions import Fraction
from math import comb

import pytest
from pyspark.sql import functions as F

from tessera.plans.terms import audit_bounds, beta_share, lower_share, tidy


def tail(k, n, p):
    """Exact probability of k hits or more of n."""
    p = Fraction(p).limit_denominator(10**9)
    return float(sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k, n + 1)))


@pytest.mark.parametrize(("k", "n"), [(1, 1), (1, 10), (5, 10), (10, 10), (37, 46), (120, 121), (3, 200)])
def test_share(k, n):
    for p in (0.01, 0.3, 0.77, 0.99):
        assert beta_share(p, k, n - k + 1) == pytest.approx(tail(k, n, p), abs=1e-9)
    assert tail(k, n, lower_share(k, n)) == pytest.approx(0.05, abs=1e-6)


def test_share_ends():
    assert lower_share(0, 0) == lower_share(0, 9) == 0
    assert lower_share(10, 10) == pytest.approx(0.05**0.1, abs=1e-9)
    assert 0.4999 < lower_share(5 * 10**8, 10**9) < 0.5


def test_tidy(spark):
    cases = {"1877": None, "river of": None, "is mended": None, "BK": None, "": None, '"The Long Ferry,"': "The Long Ferry", "Orlov's": "Orlov", "We May Row It Home": "We May Row It Home", "one two three four five six": None, "harbour": "harbour"}
    got = spark.createDataFrame([(t,) for t in cases], "t string").select("t", tidy(F.col("t")).alias("x")).collect()
    assert {r.t: r.x for r in got} == cases


def test_audit_bounds(spark, sf_dir):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect() if r.quality is not None}
    want = {}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang").collect():
        if r.doc_id in labels:
            good, n = want.get(r.lang, (0, 0))
            want[r.lang] = (good + (labels[r.doc_id] >= 1), n + 1)
    got = {r.lang: r for r in audit_bounds(spark, sf_dir).collect()}
    assert {k: (r.good, r.n) for k, r in got.items()} == want
    for r in got.values():
        assert r.at_least == pytest.approx(lower_share(r.good, r.n), abs=1e-6)
