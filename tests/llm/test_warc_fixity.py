"""The audit against a record-by-record comparison, and that it reads only under differing nodes."""

import hashlib

import duckdb
from pyspark.sql import functions as F

from tessera.llm import warc_fixity as W
from tessera.llm.queries import OP2_SQL, op2_warc_fixity


def rows_of(df):
    return sorted(((r.page_id, r.offset, r.length, r.digest, r.found_digest, r.finding) for r in df.collect()), key=str)


def raw(i, url, html):
    html = html or ""
    return f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{i}>\r\nWARC-Target-URI: {url or ''}\r\nContent-Type: text/html\r\nContent-Length: {len(html.encode())}\r\n\r\n{html}\r\n\r\n".encode()


def test_audit(spark):
    pages = [(i, f"http://e/{i}", f"<p>é {i * i}</p>" * (i % 7)) for i in range(0, 9000, 3)] + [(5, None, None)]
    other = {i: (i, u, h) for i, u, h in pages}
    other[300] = (300, "http://e/300", "rot")
    other[301] = (301, "x", "new")
    del other[8997], other[0]
    schema = "page_id long, url string, html string"
    got = rows_of(W.audit(spark.createDataFrame(pages, schema), spark.createDataFrame(list(other.values()), schema)))
    digest = lambda r: hashlib.sha256(raw(*r)).hexdigest()
    ours = {r[0]: r for r in pages}
    at, offset = {}, 0
    for i in sorted(ours):
        if i and i % W.RECORDS_PER_FILE < 3 and i // W.RECORDS_PER_FILE != last:
            offset = 0
        last = i // W.RECORDS_PER_FILE
        at[i] = offset
        offset += len(raw(*ours[i]))
    want = [(i, at[i], len(raw(*ours[i])), digest(ours[i]), digest(other[i]) if i in other else None, "altered" if i in other else "missing") for i in (0, 300, 8997)]
    assert got == sorted([*want, (301, None, None, None, digest(other[301]), "extra")], key=str)


def test_equal_replicas_and_edges(spark):
    schema = "page_id long, url string, html string"
    odd = spark.createDataFrame([(1, None, "x"), (1, None, "x"), (1, "u", None), (None, None, None), (-7, "", "")], schema)
    assert W.audit(odd, odd.repartition(3)).count() == 0
    fewer = spark.createDataFrame([(1, None, "x"), (1, "u", None), (None, None, None), (-7, "", "")], schema)
    assert [r.finding for r in W.audit(odd, fewer).collect()] == ["altered"]
    assert W.audit(odd.limit(0), odd.limit(0)).count() == 0
    assert W.audit(odd.limit(0), fewer).where("finding = 'extra'").count() == 4


def test_oracle(spark, sf_dir):
    db = duckdb.connect()
    db.sql(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{sf_dir}/pages.parquet')")
    names = 'file, page_id, "offset", length, digest, found_digest, finding'
    want = db.sql(f"SELECT {names} FROM ({OP2_SQL})").fetchall()
    got = [tuple(r) for r in op2_warc_fixity(spark, sf_dir).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and {r[-1] for r in got} == {"altered", "missing", "extra"}


def test_tree_goes_to_one_root_per_file(spark, sf_dir):
    nodes = W.tree(W.records(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    top = nodes.agg(F.max("level")).first()[0]
    assert nodes.where(F.col("level") == top).groupBy("file").count().where("count > 1").count() == 0


def test_another_length_changes_one_path(spark):
    """One longer record in a file of 4,096 changes its leaf's group and what is above, and no sibling."""
    pages = spark.range(W.RECORDS_PER_FILE).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.concat(F.lit("p"), "id").alias("html"))
    other = pages.withColumn("html", F.when(F.col("page_id") == 70, "much longer than before").otherwise(F.col("html")))
    a, b = (W.tree(W.records(p)).select("file", "level", "node", "hash") for p in (pages, other))
    changed = sorted((r.level, r.node) for r in b.exceptAll(a).collect())
    assert changed == [(0, 4), (1, 0), (2, 0)]


def test_numbers_of_very_many_records(spark, monkeypatch):
    """One number in most records, and none in as many: the same records as by a plain join."""
    schema = "page_id long, url string, html string"
    rows = spark.createDataFrame([(7, "u", f"v{i}") for i in range(90)] + [(None, "u", f"w{i}") for i in range(90)] + [(9, "u", "a"), (9, "u", "b"), (11, "u", "c")], schema).repartition(4)
    names = ["file", "place", "slot", "page_id", "length", "digest", "copies"]
    want = sorted(map(tuple, W.records(rows).select(names).collect()), key=str)
    monkeypatch.setattr(W, "HOT_NUMBER", 5)
    assert sorted(map(tuple, W.records(rows).select(names).collect()), key=str) == want and len(want) == 183
    owned = [r for r in want if r[3] in (7, 9, 11) and r[0] >= 0]
    assert sorted(r[3] for r in owned) == [7, 9, 11]


def test_records_without_a_number_of_their_own(spark):
    """Thousands of records of one number and of none spread over files; altered ones are missing and extra. Long payloads, too."""
    schema = "page_id long, url string, html string"
    rows = [(7, "u", f"v{i}") for i in range(3000)] + [(None, "u", f"w{i}") for i in range(3000)] + [(9, None, "x" * 3_000_000)]
    other = [r for r in rows if r[2] not in ("w5", "v8")] + [(None, "u", "fresh")]
    ours, theirs = (spark.createDataFrame(r, schema).repartition(4) for r in (rows, other))
    assert W.records(ours).groupBy("file").count().agg(F.max("count")).first()[0] <= 3
    found = sorted((r.page_id or -1, r.finding) for r in W.audit(ours, theirs).collect())
    # the record that has number 7 itself is the one of the least digest; v8 isn't
    least = min(range(3000), key=lambda i: hashlib.sha256(raw(7, "u", f"v{i}")).hexdigest())
    assert least != 8 and found == sorted([(-1, "missing"), (-1, "extra"), (7, "missing")])
