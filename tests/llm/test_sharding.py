"""Shards and places against plain sums, on skewed and odd rows; the plan has no Python."""

import zlib

import pytest
from pyspark.sql import functions as F

from tessera.llm import positions as P
from tessera.llm import sharding as S
from tessera.llm.queries import op11_byte_shards

SCHEMA = "doc_id long, text string"


def plain(rows, shards):
    """(id, size, crc, shard, slot) by one loop over the sorted rows."""
    sized = sorted((i is not None, i or 0, zlib.crc32((t or "").encode()), len((t or "").encode()) + 8) for i, t in rows)
    whole, before, slots, out = sum(r[3] for r in sized), 0, {}, []
    for known, i, crc, size in sized:
        k = shards * (2 * before + size) // (2 * whole)
        out.append((i if known else None, size, crc, k, slots.get(k, 0)))
        slots[k] = slots.get(k, 0) + 1
        before += size
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((r.doc_id, r["size"], r.text_crc32, r.shard, r.slot) for r in df.collect()), key=str)


@pytest.mark.parametrize("per_range", [3, 1_000_000])
def test_against_a_loop(spark, monkeypatch, per_range):
    """A third of all rows are copies under one id, as many under no id; there are empty, null and long texts."""
    monkeypatch.setattr(P, "ROWS_PER_RANGE", per_range)
    rows = [(7, "copy")] * 40 + [(None, "né")] * 30 + [(i, "x" * (i * 37 % 101)) for i in range(40)] + [(-3, None), (8, ""), (9, "y" * 3000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for shards in (1, 4, 24, 200):
        assert rows_of(S.shard(df, shards)) == plain(rows, shards)


def test_sizes_are_near_equal(spark, sf_dir):
    out = op11_byte_shards(spark, sf_dir)
    sizes = {r.shard: r.bytes for r in out.groupBy("shard").agg(F.sum("size").alias("bytes")).collect()}
    most = out.agg(F.max("size")).first()[0]
    target = sum(sizes.values()) / 24
    assert set(sizes) <= set(range(24)) and all(abs(v - target) <= most for v in sizes.values())
    ids = out.groupBy("shard").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.max("slot").alias("top"), F.count("*").alias("n")).orderBy("shard").collect()
    assert all(a.high < b.low for a, b in zip(ids, ids[1:])) and all(r.top == r.n - 1 for r in ids)


def test_odd_tables(spark):
    assert S.shard(spark.createDataFrame([], SCHEMA), 24).collect() == []
    one = spark.createDataFrame([(5, "é")], SCHEMA)
    assert rows_of(S.shard(one, 24)) == [(5, 10, zlib.crc32("é".encode()), 12, 0)]
    clash = spark.createDataFrame([(1, "a", 9, 8, "z"), (2, "b", 7, 6, "y")], SCHEMA + ", size long, rows_before long, `kept_a.b` string")
    assert sorted((r.doc_id, r.shard, r["kept_a.b"]) for r in S.shard(clash, 2, keep=("kept_a.b",)).collect()) == [(1, 0, "z"), (2, 1, "y")]


def test_written_shards(spark, tmp_path, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    S.write_shards(docs, 5, str(tmp_path / "out"), rows_per_file=17)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.select(*docs.columns).exceptAll(docs).isEmpty() and back.count() == docs.count()
    assert sorted((r.doc_id, r.shard, r.slot) for r in back.select("doc_id", "shard", "slot").collect()) == sorted((r.doc_id, r.shard, r.slot) for r in S.shard(docs, 5).collect())


def test_no_python_in_the_plan(spark, sf_dir):
    plan = op11_byte_shards(spark, sf_dir)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
