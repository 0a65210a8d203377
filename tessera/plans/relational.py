"""Rollups, rankings, pairs, modes and event-log queries over the relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators.places import medians
from tessera.plans.corpus import table
from tessera.sources.tables import stored


def topic_stats_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders per nation: count, customers, first and last year. Orders are counted per customer before the join."""
    per = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.min(F.year("o_orderdate")).alias("lo"), F.max(F.year("o_orderdate")).alias("hi"))
    named = per.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations
    return named.groupBy("n_name").agg(F.sum("n").alias("n_orders"), F.count("*").alias("n_customers"), F.min("lo").alias("first_year"), F.max("hi").alias("last_year"))


def left_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer with the number and value of their orders, zero where there are none."""
    per = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("v"))
    joined = table(spark, sf_dir, "customer").join(per, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"), F.round(F.coalesce("v", F.lit(0.0)), 2).alias("total"))


def orphans_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without an order of more than 250,000, per segment."""
    orders = table(spark, sf_dir, "orders").where("o_totalprice > 250000")
    return table(spark, sf_dir, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left_anti").groupBy("c_mktsegment").agg(F.count("*").alias("n_without_orders"))


def not_exists_either_way(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations that neither a customer nor a supplier has: the OR becomes one anti-join on the union of keys."""
    keys = table(spark, sf_dir, "customer").where("c_acctbal > 5000").select(F.col("c_nationkey").alias("k")).union(table(spark, sf_dir, "supplier").where("s_acctbal > 5000").select("s_nationkey")).distinct()
    return table(spark, sf_dir, "nation").withColumn("unused", F.lit(False)).join(keys, F.col("n_nationkey") == F.col("k"), "left").select("n_name", F.col("k").isNull().alias("unused"))


def difficulty_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts per brand in bands of size."""
    size = F.col("p_size")
    band = F.when(size.isNull() | (size == 0), "unrated").when(size == 1, "middle_school").when(size <= 5, "high_school").when(size <= 9, "college").otherwise("open")
    return table(spark, sf_dir, "part").groupBy("p_brand", band.alias("band")).agg(F.count("*").alias("n"))


def position_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by the tenth of the day in which they fall, all ten bins per type, also empty ones."""
    place = (F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")) / 86400
    counted = table(spark, sf_dir, "events").groupBy("event_type", F.least(F.lit(9), F.floor(place * 10)).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    by_type = counted.groupBy("event_type").agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("m"))  # ten entries at most
    return by_type.select("event_type", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0)))).alias("bin", "n"))


def trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers whose orders are rising, steady or fading against all orders, by the share in the later third of years.

    Fewer than three orders are steady. The cutoff is the year at two thirds of all orders in order of year.
    """
    years = table(spark, sf_dir, "orders").select("o_custkey", F.year("o_orderdate").alias("y"))
    by_year = years.groupBy("y").agg(F.count("*").alias("n")).withColumn("upto", F.sum("n").over(Window.orderBy("y")))  # a row a year
    total = by_year.agg(F.sum("n").alias("total"))
    cut = by_year.join(total, F.lit(True)).where(F.col("upto") > F.floor(F.col("total") * 2 / 3)).agg(F.min("y").alias("cut"), F.max("total").alias("total"))
    share = by_year.join(cut, F.lit(True)).agg((F.sum(F.when(F.col("y") >= F.col("cut"), F.col("n")).otherwise(0)) / F.max(cut["total"])).alias("all_share"), F.max("cut").alias("cut"))
    per = years.join(F.broadcast(share), F.lit(True)).groupBy("o_custkey").agg(F.count("*").alias("n"), F.avg((F.col("y") >= F.col("cut")).cast("int")).alias("share"), F.max("all_share").alias("all_share"))  # share is one row
    ratio = F.col("share") / F.col("all_share")
    return per.select("o_custkey", "n", F.when(F.col("n") < 3, "steady").when(ratio >= 1.5, "rising").when(ratio <= 0.5, "fading").otherwise("steady").alias("trend"))


def breakdown_having(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days and types with at least two events of value over 50."""
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("n_high"), F.round(F.sum("value"), 4).alias("total")).where("n_high >= 2")


def struggled_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 users with most events of low value (a top-20 report)."""
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(F.col("value") < 10).alias("n_low"), F.count("*").alias("n"), F.max("event_type").alias("some_type"))
    return e.where("n_low >= 2").orderBy(F.desc("n_low"), "user_id").limit(20)


def event_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median, mean, share over 50 per type; null where nothing qualifies. Values are counted first, and medians are places in running sums."""
    e = stored(table(spark, sf_dir, "events").groupBy("event_type", "value").agg(F.count("*").alias("k")))
    given, high = F.when(F.col("value").isNotNull(), F.col("k")), F.when(F.col("value") > 50, F.col("k")).otherwise(0)
    of = e.groupBy("event_type").agg(F.sum("k").alias("n"), F.round(F.sum(F.col("value") * F.col("k")) / F.sum(given), 6).alias("mean_value"), F.round(F.sum(high) / F.sum(given), 6).alias("share_high"))
    mid = medians(e, "event_type", "value", "k").withColumnRenamed("event_type", "of")
    return of.join(mid, F.col("event_type").eqNullSafe(F.col("of")), "left").select("event_type", "n", F.round("median", 6).alias("median_value"), "mean_value", "share_high")


def usage_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per type on the last day, in the last seven days and in all, in one pass after the latest time is known."""
    e = table(spark, sf_dir, "events")
    latest = e.agg(F.max("ts").alias("latest"))
    j = e.join(F.broadcast(latest), F.lit(True))  # one row
    return j.groupBy("event_type").agg(F.count_if(F.to_date("ts") == F.to_date("latest")).alias("today"), F.count_if(F.col("ts") > F.col("latest") - F.expr("interval 7 days")).alias("week"), F.count("*").alias("all_time"))


def candidate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts grouped by normalised name: members, distinct brands, most common spelling, number by size.

    The largest group is number 1, of equals the one with the smallest key. Groups are cut into ranges of that order; a number is
    the place in its range and the groups of the ranges before, so no window runs over all groups.
    """
    norm = F.trim(F.regexp_replace(F.lower("p_name"), "[^a-z0-9]+", " "))
    rows = table(spark, sf_dir, "part").select(norm.alias("norm"), "p_name", "p_brand", "p_partkey")
    spelled = rows.groupBy("norm", "p_name").agg(F.count("*").alias("k"), F.min("p_partkey").alias("first"))
    shown = spelled.groupBy("norm").agg(F.max_by("p_name", F.struct("k", -F.col("first"))).alias("display"), F.sum("k").alias("members"), F.min("first").alias("first"))
    brands = rows.groupBy("norm").agg(F.countDistinct("p_brand").alias("brands"))
    groups = stored(shown.join(brands, "norm").repartitionByRange(F.desc("members"), "first").withColumn("range", F.spark_partition_id()))
    before = F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before")
    ranges = groups.groupBy("range").agg(F.count("*").alias("n")).select("range", before)  # a row for each range
    place = F.row_number().over(Window.partitionBy("range").orderBy(F.desc("members"), "first"))
    return groups.withColumn("place", place).join(F.broadcast(ranges), "range").select("norm", "display", "members", "first", "brands", (F.col("before") + F.col("place")).alias("number"))


def mode_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's most common priority, the smallest among equals."""
    n = table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.count("*").alias("n"))
    return n.groupBy("o_custkey").agg(F.min_by("o_orderpriority", F.struct(-F.col("n"), "o_orderpriority")).alias("priority"), F.max("n").alias("n"))


def adjacent_order_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per customer, neighbouring orders by date whose price falls."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = table(spark, sf_dir, "orders").withColumn("next_price", F.lead("o_totalprice").over(w))
    return o.groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_if(F.col("next_price") < F.col("o_totalprice")).alias("n_falls"))


def cooccurrence_top8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 8 suppliers most often in an order with each supplier. An order has a handful of lines, so pairs per order are few."""
    s = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey").distinct()
    pairs = s.join(s.select("l_orderkey", F.col("l_suppkey").alias("other")), "l_orderkey").where("l_suppkey <> other").groupBy("l_suppkey", "other").agg(F.count("*").alias("n"))
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy("l_suppkey").orderBy(F.desc("n"), "other"))).where("rank <= 8")


def best_example(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each supplier the cheapest earliest line, by an ordered minimum instead of a sort."""
    items = table(spark, sf_dir, "lineitem")
    return items.groupBy("l_suppkey").agg(F.min_by(F.struct("l_orderkey", "l_linenumber"), F.struct("l_extendedprice", "l_orderkey", "l_linenumber")).alias("b")).select("l_suppkey", "b.*")


#: Suppliers of an order up to which its pairs are made within one row; those of larger orders meet in parts of so many.
MANY = 64


def order_edges(items: DataFrame) -> DataFrame:
    """(a, b, fwd): in how many orders a line of supplier a stands before one of supplier b.

    A supplier's lowest and highest line say all that an order tells of it, so lines are summed up first. Pairs of an order with at most MANY suppliers are made in its row; larger
    orders are dealt over parts, each supplier meeting every part.
    """
    own = items.where("l_orderkey is not null").groupBy("l_orderkey", "l_suppkey").agg(F.min("l_linenumber").alias("low"), F.max("l_linenumber").alias("high"))
    large = stored(own.groupBy("l_orderkey").agg(F.count("*").alias("m")).where(F.col("m") > MANY))
    rows = own.join(large.select("l_orderkey"), "l_orderkey", "left_anti").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_suppkey", "low", "high")).alias("l"))
    after = lambda x: F.filter("l", lambda y: (x["low"] < y["high"]) & (x["l_suppkey"] != y["l_suppkey"]))
    pairs = F.flatten(F.transform("l", lambda x: F.transform(after(x), lambda y: F.struct(x["l_suppkey"].alias("a"), y["l_suppkey"].alias("b")))))
    near = rows.select(F.explode(pairs).alias("p")).select("p.a", "p.b")
    parts = F.ceil(F.col("m") / MANY).cast("int")
    dealt = own.join(large, "l_orderkey")
    left = dealt.select("l_orderkey", F.pmod(F.xxhash64("l_suppkey"), parts).cast("int").alias("part"), F.col("l_suppkey").alias("a"), "low")
    right = dealt.select("l_orderkey", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.col("l_suppkey").alias("b"), "high")
    far = left.join(right, ["l_orderkey", "part"]).where("low < high and a <> b").select("a", "b")
    return near.unionByName(far).groupBy("a", "b").agg(F.count("*").alias("fwd"))


def edges_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier to supplier edges: log of shared orders times rarity, plus half the reverse direction.

    An edge runs from the supplier of an order's lower line to that of a higher one; it is counted once and stored, as four sides read it.
    """
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber")
    fwd = stored(order_edges(items))
    both = fwd.unionByName(fwd.select(F.col("b").alias("a"), F.col("a").alias("b"), F.lit(0).cast("long").alias("fwd"))).groupBy("a", "b").agg(F.max("fwd").alias("fwd"))
    back = both.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("fwd").alias("rev"))
    named = fwd.groupBy("b").agg(F.count("*").alias("df"))
    n = items.agg(F.greatest(F.countDistinct("l_suppkey"), F.lit(2)).alias("n"))
    scored = both.join(back, ["a", "b"]).join(named, "b", "left").join(named.select(F.col("b").alias("a"), F.col("df").alias("dfa")), "a", "left").join(F.broadcast(n), F.lit(True))  # one row
    idf = lambda c: F.coalesce(F.log(F.col("n") / F.col(c)), F.lit(0.0))
    return scored.select("a", "b", "fwd", "rev", F.round(F.log1p("fwd") * idf("df") + 0.5 * F.log1p("rev") * idf("dfa"), 6).alias("score"))


def related_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 12 best related suppliers of each, of edges with at least two orders either way."""
    e = edges_score(spark, sf_dir).where("fwd + rev >= 2")
    return e.withColumn("rank", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("score"), "b"))).where("rank <= 12")


def balanced_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten parts per brand, one type after another in rounds, types by their best price."""
    p = table(spark, sf_dir, "part").select("p_brand", "p_type", "p_partkey", "p_retailprice")
    in_type = Window.partitionBy("p_brand", "p_type").orderBy(F.desc("p_retailprice"), "p_partkey")
    first = p.groupBy("p_brand", "p_type").agg(F.max("p_retailprice").alias("best"))
    rounds = p.withColumn("round", F.row_number().over(in_type)).where("round <= 10").join(first, ["p_brand", "p_type"])
    place = F.row_number().over(Window.partitionBy("p_brand").orderBy("round", F.desc("best"), "p_type"))
    return rounds.withColumn("place", place).where("place <= 10").select("p_brand", "p_type", "p_partkey", "round", "place")


def page_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third page of 25 orders, newest first (paging is the feature)."""
    return table(spark, sf_dir, "orders").orderBy(F.desc("o_orderdate"), "o_orderkey").offset(50).limit(25).select("o_orderkey", "o_orderdate")


def distinguishing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For neighbouring suppliers in order of number, how many part types only one of them delivers."""
    types = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").join(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey")).select("l_suppkey", "p_brand").distinct()
    sets = types.groupBy("l_suppkey").agg(F.collect_set("p_brand").alias("s"))  # 25 brands at most
    other = sets.select((F.col("l_suppkey") - 1).alias("l_suppkey"), F.col("s").alias("t"))
    return sets.join(other, "l_suppkey").select("l_suppkey", F.size(F.array_except("s", "t")).alias("only_here"), F.size(F.array_except("t", "s")).alias("only_there"))


def filing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's usual status and priority and the half-even rounded median price."""
    o = table(spark, sf_dir, "orders")
    mode = lambda c: o.groupBy("o_custkey", c).agg(F.count("*").alias("n")).groupBy("o_custkey").agg(F.min_by(c, F.struct(-F.col("n"), c)).alias(c))
    return o.groupBy("o_custkey").agg(F.bround(F.median("o_totalprice"), 0).alias("median_price")).join(mode("o_orderstatus"), "o_custkey").join(mode("o_orderpriority"), "o_custkey")


def job_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest state per user from the event log: last event, attempts since the last purchase, backoff 60 * 2**(n - 1) s."""
    e = table(spark, sf_dir, "events")
    last = e.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("state"), F.max(F.when(F.col("event_type") == "purchase", F.col("ts"))).alias("done"))
    since = e.join(last, "user_id").where("done is null or ts > done").groupBy("user_id").agg(F.count("*").alias("attempts"))
    n = F.coalesce("attempts", F.lit(0))
    return last.join(since, "user_id", "left").select("user_id", "state", n.cast("long").alias("attempts"), F.when(n > 0, 60 * F.pow(F.lit(2.0), F.least(n, F.lit(10)) - 1)).otherwise(0.0).alias("backoff_s"))


def staleness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents per language by whether a label exists and is out of date (its quality differs from the length rule)."""
    d, lab = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    j = d.join(lab, "doc_id", "left")
    state = F.when(F.col("quality").isNull(), "missing").when((F.col("n_chars") >= 1000).cast("int") != F.col("quality"), "stale").otherwise("fresh")
    return j.groupBy("lang", state.alias("state")).agg(F.count("*").alias("n"))


def ndjson_unwrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Props of events from JSON with an explicit schema, counted per value."""
    k = F.from_json("props", "k int")["k"]
    return table(spark, sf_dir, "events").groupBy("event_type", k.alias("k")).agg(F.count("*").alias("n"))


def tumbling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per six hours and type (an extension; the same windows run on a stream in tessera.streaming)."""
    e = table(spark, sf_dir, "events").withColumn("t", F.col("ts").cast("timestamp"))
    return e.groupBy(F.window("t", "6 hours").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.unix_seconds("w.start").alias("start_s"), "event_type", "n", "total")


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of each user, apart by more than six hours (an extension)."""
    e = table(spark, sf_dir, "events").withColumn("t", F.col("ts").cast("timestamp"))
    s = e.groupBy(F.session_window("t", "6 hours").alias("w"), "user_id").agg(F.count("*").alias("n"))
    return s.groupBy("user_id").agg(F.count("*").alias("n_sessions"), F.max("n").alias("longest"))


QUERIES = {
    f.__name__: f
    for f in (
        topic_stats_join, left_default, orphans_anti, not_exists_either_way, difficulty_bands, position_hist, trend, breakdown_having, struggled_users, event_stats, usage_windows, candidate_groups, mode_priority, adjacent_order_check,
        cooccurrence_top8, best_example, edges_score, related_ranked, balanced_page, page_offset, distinguishing, filing, job_state, staleness, ndjson_unwrap, tumbling_windows, sessions,
    )
}

EDGES = """
    f AS (SELECT x.l_suppkey AS a, y.l_suppkey AS b, count(DISTINCT x.l_orderkey) AS fwd FROM lineitem x JOIN lineitem y USING (l_orderkey)
      WHERE x.l_suppkey <> y.l_suppkey AND x.l_linenumber < y.l_linenumber GROUP BY 1, 2),
    e AS (SELECT a, b, max(fwd) AS fwd FROM (SELECT * FROM f UNION ALL SELECT b, a, 0 FROM f) GROUP BY a, b),
    named AS (SELECT b, count(*) AS df FROM f GROUP BY b),
    c AS (SELECT greatest(count(DISTINCT l_suppkey), 2) AS n FROM lineitem),
    edges AS (SELECT e.a, e.b, e.fwd, r.fwd AS rev, round(ln(1 + e.fwd) * coalesce(ln(n / nb.df), 0) + 0.5 * ln(1 + r.fwd) * coalesce(ln(n / na.df), 0), 6) AS score
      FROM e JOIN e r ON r.a = e.b AND r.b = e.a LEFT JOIN named nb ON nb.b = e.b LEFT JOIN named na ON na.b = e.a, c)"""

ORACLES = {
    "topic_stats_join": """SELECT n_name, count(*) AS n_orders, count(DISTINCT o_custkey) AS n_customers, CAST(min(year(o_orderdate)) AS INTEGER) AS first_year, CAST(max(year(o_orderdate)) AS INTEGER) AS last_year
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""",
    "left_default": "SELECT c_custkey, count(o_orderkey) AS n_orders, round(coalesce(sum(o_totalprice), 0), 2) AS total FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey",
    "orphans_anti": "SELECT c_mktsegment, count(*) AS n_without_orders FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000) GROUP BY c_mktsegment",
    "not_exists_either_way": """SELECT n_name, NOT EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal > 5000) AND NOT EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 5000) AS unused FROM nation""",
    "difficulty_bands": """SELECT p_brand, CASE WHEN p_size IS NULL OR p_size = 0 THEN 'unrated' WHEN p_size = 1 THEN 'middle_school' WHEN p_size <= 5 THEN 'high_school' WHEN p_size <= 9 THEN 'college' ELSE 'open' END AS band, count(*) AS n FROM part GROUP BY 1, 2""",
    "position_hist": """WITH c AS (SELECT event_type, CAST(least(9, floor((hour(ts) * 3600 + minute(ts) * 60 + second(ts)) / 86400 * 10)) AS INTEGER) AS bin FROM events)
        SELECT t.event_type, CAST(b.bin AS INTEGER) AS bin, count(c.bin) AS n FROM (SELECT DISTINCT event_type FROM events) t CROSS JOIN (SELECT unnest(range(10)) AS bin) b LEFT JOIN c ON c.event_type = t.event_type AND c.bin = b.bin GROUP BY 1, 2""",
    "trend": """WITH y AS (SELECT o_custkey, year(o_orderdate) AS y FROM orders), s AS (SELECT y, row_number() OVER (ORDER BY y) - 1 AS k, count(*) OVER () AS n FROM y),
        cut AS (SELECT max(y) AS cut FROM s WHERE k = CAST(floor(n * 2 / 3) AS BIGINT)), a AS (SELECT avg(CASE WHEN y >= cut THEN 1 ELSE 0 END) AS all_share FROM y, cut),
        p AS (SELECT o_custkey, count(*) AS n, avg(CASE WHEN y >= cut THEN 1 ELSE 0 END) AS share FROM y, cut GROUP BY o_custkey)
        SELECT o_custkey, n, CASE WHEN n < 3 THEN 'steady' WHEN share / all_share >= 1.5 THEN 'rising' WHEN share / all_share <= 0.5 THEN 'fading' ELSE 'steady' END AS trend FROM p, a""",
    "breakdown_having": "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, count_if(value > 50) AS n_high, round(sum(value), 4) AS total FROM events GROUP BY 1, 2 HAVING count_if(value > 50) >= 2",
    "struggled_users": "SELECT user_id, count_if(value < 10) AS n_low, count(*) AS n, max(event_type) AS some_type FROM events GROUP BY user_id HAVING count_if(value < 10) >= 2 ORDER BY n_low DESC, user_id LIMIT 20",
    "event_stats": "SELECT event_type, count(*) AS n, round(median(value), 6) AS median_value, round(avg(value), 6) AS mean_value, round(count_if(value > 50) / nullif(count(value), 0), 6) AS share_high FROM events GROUP BY event_type",
    "usage_windows": "WITH l AS (SELECT max(ts) AS latest FROM events) SELECT event_type, count_if(CAST(ts AS DATE) = CAST(latest AS DATE)) AS today, count_if(ts > latest - INTERVAL 7 DAY) AS week, count(*) AS all_time FROM events, l GROUP BY event_type",
    "candidate_groups": """WITH r AS (SELECT trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) AS norm, p_name, p_brand, p_partkey FROM part),
        s AS (SELECT norm, p_name, count(*) AS k, min(p_partkey) AS first FROM r GROUP BY norm, p_name)
        SELECT norm, arg_max(p_name, k * 1000000000 - first) AS display, CAST(sum(k) AS BIGINT) AS members, min(first) AS first, (SELECT count(DISTINCT p_brand) FROM r WHERE r.norm = s.norm) AS brands, row_number() OVER (ORDER BY sum(k) DESC, min(first)) AS number FROM s GROUP BY norm""",
    "mode_priority": "WITH c AS (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2) SELECT o_custkey, o_orderpriority AS priority, n FROM c QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, o_orderpriority) = 1",
    "adjacent_order_check": "WITH o AS (SELECT *, lead(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS nx FROM orders) SELECT o_custkey, count(*) AS n, count(*) FILTER (WHERE nx < o_totalprice) AS n_falls FROM o GROUP BY o_custkey",
    "cooccurrence_top8": """WITH s AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem), p AS (SELECT a.l_suppkey, b.l_suppkey AS other, count(*) AS n FROM s a JOIN s b USING (l_orderkey) WHERE a.l_suppkey <> b.l_suppkey GROUP BY 1, 2)
        SELECT *, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, other) AS INTEGER) AS rank FROM p QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, other) <= 8""",
    "best_example": "SELECT l_suppkey, l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice, l_orderkey, l_linenumber) = 1",
    "edges_score": f"WITH {EDGES} SELECT * FROM edges",
    "related_ranked": f"WITH {EDGES} SELECT *, CAST(row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS INTEGER) AS rank FROM edges WHERE fwd + rev >= 2 QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 12",
    "balanced_page": """WITH r AS (SELECT p_brand, p_type, p_partkey, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_retailprice DESC, p_partkey) AS round, max(p_retailprice) OVER (PARTITION BY p_brand, p_type) AS best FROM part),
        q AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY round, best DESC, p_type) AS place FROM r) SELECT p_brand, p_type, p_partkey, CAST(round AS INTEGER) AS round, CAST(place AS INTEGER) AS place FROM q WHERE place <= 10""",
    "page_offset": "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 25 OFFSET 50",
    "distinguishing": """WITH t AS (SELECT DISTINCT l_suppkey, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey), s AS (SELECT l_suppkey, list(p_brand) AS b FROM t GROUP BY l_suppkey)
        SELECT x.l_suppkey, CAST(len(list_filter(x.b, lambda v: NOT list_contains(y.b, v))) AS INTEGER) AS only_here, CAST(len(list_filter(y.b, lambda v: NOT list_contains(x.b, v))) AS INTEGER) AS only_there FROM s x JOIN s y ON y.l_suppkey = x.l_suppkey + 1""",
    "filing": """WITH s AS (SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY count(*) DESC, o_orderstatus) = 1),
        p AS (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY count(*) DESC, o_orderpriority) = 1)
        SELECT o_custkey, round_even(median(o_totalprice), 0) AS median_price, any_value(s.o_orderstatus) AS o_orderstatus, any_value(p.o_orderpriority) AS o_orderpriority FROM orders JOIN s USING (o_custkey) JOIN p USING (o_custkey) GROUP BY o_custkey""",
    "job_state": """WITH l AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS state, max(CASE WHEN event_type = 'purchase' THEN ts END) AS done FROM events GROUP BY user_id),
        a AS (SELECT user_id, count(*) AS n FROM events JOIN l USING (user_id) WHERE done IS NULL OR ts > done GROUP BY user_id)
        SELECT user_id, state, coalesce(n, 0) AS attempts, CASE WHEN n > 0 THEN 60 * pow(2.0, least(n, 10) - 1) ELSE 0.0 END AS backoff_s FROM l LEFT JOIN a USING (user_id)""",
    "staleness": "SELECT lang, CASE WHEN quality IS NULL THEN 'missing' WHEN CAST(n_chars >= 1000 AS INTEGER) <> quality THEN 'stale' ELSE 'fresh' END AS state, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1, 2",
    "ndjson_unwrap": "SELECT event_type, CAST(json_extract(props, '$.k') AS INTEGER) AS k, count(*) AS n FROM events GROUP BY 1, 2",
    "tumbling_windows": "SELECT CAST(epoch(time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01')) AS BIGINT) AS start_s, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "sessions": """WITH e AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events),
        s AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
        SELECT user_id, count(DISTINCT k) AS n_sessions, max(n) AS longest FROM (SELECT user_id, k, count(*) AS n FROM s GROUP BY user_id, k) GROUP BY user_id""",
}
