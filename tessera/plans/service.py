"""What a study service asks of its tables: filters, rollups, queues, upserts, draws and checks, on the given tables.

Every result is defined for null columns (they compare as SQL does), repeated rows and empty tables (no rows).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.text import position_in, proper_name, usable_alias
from tessera.plans.corpus import STOP_WORDS, table, words
from tessera.plans.knowledge import ORACLES as KNOWLEDGE
from tessera.plans.knowledge import bm25_search
from tessera.plans.relational import ORACLES as RELATIONAL
from tessera.plans.relational import edges_score
from tessera.sources.tables import question_rows

SEED = "seed-7"


def ask(spark: SparkSession, sf_dir: str, sql: str, *names: str) -> DataFrame:
    """A Spark SQL statement over {table} names."""
    return spark.sql(sql, **{n: table(spark, sf_dir, n) for n in names})


def eligible_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that may be grouped: from a source that isn't excluded, with text, long enough; names stand in for nulls."""
    d = table(spark, sf_dir, "documents").where((F.col("source") != "forum") & (F.trim(F.coalesce("text", F.lit(""))) != "") & (F.col("n_chars") >= 50))
    return d.groupBy(F.coalesce("lang", F.lit("Unknown")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))


def practice_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts by brand, type or the like, size range, without those of an exclusion list (those ordered in bulk)."""
    bulk = table(spark, sf_dir, "lineitem").where("l_quantity >= 50").select(F.col("l_partkey").alias("p_partkey")).distinct()
    parts = table(spark, sf_dir, "part").where("(p_type like 'STANDARD%' or p_type like '%BRASS') and p_size between 5 and 30")
    return parts.join(bulk, "p_partkey", "left_anti").select("p_partkey", "p_brand", "p_size")


def due_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as cards: not suspended (a balance of 0 or more), of two segments, due if their last order is 90 days old."""
    sql = """SELECT c_custkey, c_mktsegment, CAST(last_day AS STRING) AS last_day FROM (
      SELECT o_custkey, CAST(max(o_orderdate) AS DATE) AS last_day FROM {orders} GROUP BY o_custkey) o
    JOIN {customer} ON c_custkey = o_custkey CROSS JOIN (SELECT CAST(max(o_orderdate) AS DATE) AS today FROM {orders}) t
    WHERE c_acctbal >= 0 AND c_mktsegment IN ('BUILDING', 'MACHINERY') AND date_add(last_day, 90) <= today"""
    return ask(spark, sf_dir, sql, "orders", "customer")  # the crossed table has one row


def span_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which line of an order holds a place in the order's running quantity: start <= place < end."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber")
    spans = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("long").alias("q")).withColumn("end", F.sum("q").over(w)).withColumn("start", F.col("end") - F.col("q"))
    places = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.pmod(F.col("o_orderkey") * 7, F.lit(60)).alias("place"))
    return spans.join(places, "l_orderkey").where("start <= place and place < end").select("l_orderkey", "l_linenumber", "place", "start", "end")


def impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Impact of a part: root of its suppliers, times how early in orders it comes (with a bonus for returned ones), times a bonus for last lines.

    The median is over at most seven line numbers.
    """
    items = table(spark, sf_dir, "lineitem")
    per = items.groupBy("l_partkey").agg(F.countDistinct("l_suppkey").alias("sets"), (F.median("l_linenumber") / 8).alias("place"), F.avg(F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0)).alias("power"), F.avg(F.when(F.col("l_linestatus") == "F", 1.0).otherwise(0.0)).alias("last"))
    early = F.pow(F.greatest(F.lit(1.0) - F.col("place") + 0.25 * F.col("power"), F.lit(0.0)), 0.25)
    return per.select("l_partkey", "sets", F.round(F.sqrt("sets") * early * (1 + 0.3 * F.col("last")), 6).alias("impact"))


def followed_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers in arrears with their judged orders and the filled ones among them: one aggregation before a left join."""
    per = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count_if(F.col("o_orderstatus").isin("F", "O")).alias("judged"), F.count_if(F.col("o_orderstatus") == "F").alias("correct"))
    some = table(spark, sf_dir, "customer").where("c_acctbal < 0").select("c_custkey", "c_nationkey")
    return some.join(per, "c_custkey", "left").select("c_custkey", "c_nationkey", F.coalesce("judged", F.lit(0)).alias("judged"), F.coalesce("correct", F.lit(0)).alias("correct"))


def rating_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histogram of events by rating (quarters of 100), with those due after as many days as the rating and those of the last day."""
    e = table(spark, sf_dir, "events")
    last = e.agg(F.to_date(F.max("ts")).alias("today"))
    rated = e.withColumn("rating", F.least(F.lit(4), F.greatest(F.lit(1), F.floor(F.col("value") / 25) + 1)).cast("int")).join(F.broadcast(last), F.lit(True))  # one row
    day = F.to_date("ts")
    return rated.groupBy("rating").agg(F.count("*").alias("n"), F.count_if(F.date_add(day, F.col("rating")) <= F.col("today")).alias("due"), F.count_if(day == F.col("today")).alias("today"))


def job_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by priority and status, as one map of counts a priority, printed in order of status."""
    n = table(spark, sf_dir, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"))
    return n.groupBy("o_orderpriority").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "o_orderstatus", "n"))), ",").alias("counts"))  # three statuses


def size_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by their number of lines: one, two, three or more."""
    n = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("m"))
    return n.groupBy(F.when(F.col("m") == 1, "1").when(F.col("m") == 2, "2").otherwise("3+").alias("bucket")).agg(F.count("*").alias("n"), F.sum("m").alias("n_lines"))


def reviewed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns grouped by the key of their text (16 digits of a hash of the text with single blanks): how many, first and last conversation, roles."""
    key = F.substring(F.sha1(F.trim(F.regexp_replace("text", r"[ \t\r\n]+", " "))), 1, 16)
    return table(spark, sf_dir, "conversations").where("text is not null").groupBy(key.alias("line_key")).agg(F.count("*").alias("n"), F.min("conv_id").alias("first_conv"), F.max("conv_id").alias("last_conv"), F.min("role").alias("role_low"), F.max("role").alias("role_high"))


def source_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five words of seven letters or more for each source that most of its documents hold; among equals the one seen in the smaller doc_id, then by spelling.

    A document gives its distinct words once, so one shuffle of counts is all.
    """
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{7,}"), F.lit(0)))
    d = table(spark, sf_dir, "documents").where("text is not null").select("source", "doc_id", F.explode(words).alias("term"))
    n = d.groupBy("source", "term").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))
    rank = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n"), "first_id", "term"))
    return n.withColumn("place", rank).where("place <= 5")


def counts_per_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each user by type, printed as a map in order of type."""
    n = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return n.groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "event_type", "n"))), ",").alias("counts"), F.sum("n").alias("n"))  # an entry a type


def cited_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names without their first word as titles: how often, and the brand of the first record."""
    title = F.trim(F.regexp_replace(F.lower("p_name"), "^[^ ]+ ", ""))
    return table(spark, sf_dir, "part").groupBy(title.alias("title")).agg(F.count("*").alias("n"), F.min_by("p_brand", "p_partkey").alias("brand"))


def confusions_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five suppliers with the highest edge score for each, smaller numbers first among equals."""
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("score"), "b"))
    return edges_score(spark, sf_dir).where("score > 0").withColumn("place", rank).where("place <= 5").select("a", "b", "place", "score")


def best_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dearest line of each order (the first among equals), by an ordered minimum."""
    best = F.min_by(F.struct("l_linenumber", "l_partkey"), F.struct(-F.col("l_extendedprice"), F.col("l_linenumber"))).alias("b")
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(best).select("l_orderkey", "b.*")


def best_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each user and type the event of the highest precision (digits of its value), the first among equals."""
    precision = F.length(F.col("value").cast("decimal(18,2)").cast("string"))
    best = F.max_by(F.struct("event_id", "value"), F.struct(precision, -F.col("event_id"))).alias("b")
    return table(spark, sf_dir, "events").where("value is not null").groupBy("user_id", "event_type").agg(best).select("user_id", "event_type", "b.*")


def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A slug for each part: of its name, with the brand where another has that, with the number where that is taken, too.

    Parts in more lines choose first. Whoever isn't first of a name has a slug with a brand or number, which no name gives.
    """
    uses = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("n"))
    slug = F.regexp_replace(F.lower("p_name"), "[^a-z0-9]+", "-")
    p = table(spark, sf_dir, "part").join(uses, "p_partkey", "left").select("p_partkey", F.coalesce("n", F.lit(0)).alias("n"), slug.alias("plain"), F.lower(F.regexp_replace("p_brand", "#", "")).alias("brand"))
    first = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "p_partkey"))
    p = p.withColumn("r", first("plain"))
    p = p.withColumn("late", F.col("r") > 1).withColumn("q", first("plain", "brand", "late"))
    return p.select("p_partkey", F.when(~F.col("late"), F.col("plain")).when(F.col("q") == 1, F.concat_ws("-", "plain", "brand")).otherwise(F.concat_ws("-", "plain", "p_partkey")).alias("slug"))


def roulette(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty parts drawn by a hash of number and seed."""
    return table(spark, sf_dir, "part").select("p_partkey", "p_name", F.md5(F.concat(F.col("p_partkey").cast("string"), F.lit(SEED))).alias("draw")).orderBy("draw").limit(20)


def audit_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty labelled documents of each quality, drawn by a hash of number and seed."""
    drawn = table(spark, sf_dir, "labels").where("quality is not null").select("doc_id", "quality", "toxic", F.md5(F.concat(F.lit(SEED), F.col("doc_id").cast("string"))).alias("draw"))
    return drawn.withColumn("place", F.row_number().over(Window.partitionBy("quality").orderBy("draw", "doc_id"))).where("place <= 20")


def claim_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next twenty open orders to be worked on: the most urgent first, then the oldest number."""
    return table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select("o_orderkey", "o_orderpriority").orderBy("o_orderpriority", "o_orderkey").limit(20)


def shown_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight parts to show for each brand: those of no promotion first, then by price, then by name and number."""
    order = Window.partitionBy("p_brand").orderBy(F.col("p_type").startswith("PROMO"), F.desc("p_retailprice"), "p_name", "p_partkey")
    return table(spark, sf_dir, "part").select("p_brand", "p_partkey", F.row_number().over(order).alias("place")).where("place <= 8")


def said_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns whose text, whatever its case, wasn't said before in their conversation."""
    t = table(spark, sf_dir, "conversations").where("text is not null").withColumn("k", F.sha2(F.lower("text"), 256))
    return t.groupBy("conv_id", "k").agg(F.min("turn").alias("turn"), F.count("*").alias("times")).select("conv_id", "turn", "times")


def trade_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of nations against two lists: neighbours by number that don't trade are missing, deals of a nation with itself are wrong."""
    deals = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).select("l_suppkey", "o_custkey").distinct()
    pairs = deals.join(table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("a")), F.col("l_suppkey") == F.col("s_suppkey")).join(table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("b")), F.col("o_custkey") == F.col("c_custkey")).select("a", "b").distinct()
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("a"))
    golden = nations.withColumn("b", F.col("a") + 1).where("b < 25")
    missing = golden.join(pairs, ["a", "b"], "left_anti").select(F.lit("missing").alias("finding"), "a", "b")
    return missing.unionByName(pairs.where("a = b").select(F.lit("wrong").alias("finding"), "a", "b"))


def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progress of each user by type after events were merged into it one by one: the highest value ever, and the latest time."""
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max("value").alias("through"), F.max("event_id").alias("last_event"))


def cards_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards of customers after an update: those with a new order are active again, and an empty balance is filled from it.

    Customers without any order go, and all that hangs on them.
    """
    new = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderkey").alias("latest"), F.count_if(F.col("o_orderstatus") == "O").alias("open"))
    c = table(spark, sf_dir, "customer").join(new, "c_custkey")
    filled = F.coalesce(F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")), F.col("latest").cast("double"))
    return c.select("c_custkey", filled.alias("balance"), ((F.col("c_acctbal") < 0) & (F.col("open") == 0)).alias("suspended"))


def open_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One open order for each customer and priority, the first; how many more would break the rule."""
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'")
    return o.groupBy("o_custkey", "o_orderpriority").agg(F.min("o_orderkey").alias("o_orderkey"), (F.count("*") - 1).alias("refused"))


def ready_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open orders that may start: their customer has a filled order, or one that was given up (pending); others wait."""
    o = table(spark, sf_dir, "orders")
    done = o.where("o_orderstatus in ('F', 'P')").groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "F").alias("stored"), F.count_if(F.col("o_orderstatus") == "P").alias("failed"))
    queued = o.where("o_orderstatus = 'O'").select("o_orderkey", "o_custkey").join(done, "o_custkey", "left")
    return queued.select("o_orderkey", F.when(F.col("stored") > 0, "ready").when(F.col("failed") > 0, "ready without").otherwise("waits").alias("state"))


def refreshed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types of users after a refresh of two types: their rows go, and one new request for each takes their place."""
    n = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    again = F.col("event_type").isin("click", "purchase")
    return n.select("user_id", "event_type", F.when(again, 0).otherwise(F.col("n")).cast("long").alias("stored"), F.when(again, 1).otherwise(0).alias("queued"))


def durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds of ISO 8601 durations, written from the events' times of day, per type."""
    h, m, s = F.hour("ts"), F.minute("ts"), F.second("ts")
    part = lambda n, unit: F.when(n > 0, F.concat(n.cast("string"), F.lit(unit))).otherwise("")
    iso = F.concat(F.lit("PT"), part(h, "H"), part(m, "M"), part(s, "S"))
    parsed = lambda unit: F.coalesce(F.regexp_extract(iso, f"([0-9]+){unit}", 1).try_cast("long"), F.lit(0))
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.sum(parsed("H") * 3600 + parsed("M") * 60 + parsed("S")).alias("seconds"), F.max(iso).alias("longest_print"))


def quota_resets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When a daily quota that an event used up is new: the next midnight of Los Angeles and five minutes, in UTC; events per reset."""
    zone = "America/Los_Angeles"
    local = F.from_utc_timestamp(F.col("ts").cast("timestamp"), zone)
    reset = F.to_utc_timestamp(F.date_trunc("day", local) + F.expr("interval 1 day 5 minutes"), zone)
    return table(spark, sf_dir, "events").groupBy(F.date_format(reset, "yyyy-MM-dd HH:mm").alias("reset_at")).agg(F.count("*").alias("n"))


def dates_printed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates at four precisions, by priority: day, month, year or century; how many orders print so."""
    y, urgent = F.year("o_orderdate"), F.substring("o_orderpriority", 1, 1)
    text = F.when(urgent == "1", F.date_format("o_orderdate", "yyyy-MM-dd")).when(urgent == "2", F.date_format("o_orderdate", "yyyy-MM")).when(urgent == "3", y.cast("string")).otherwise(F.concat(F.ceil(y / 100).cast("string"), F.lit("th century")))
    return table(spark, sf_dir, "orders").groupBy(text.alias("printed")).agg(F.count("*").alias("n"))


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last JSON object of a reply in prose, read back: its value, or that there is none."""
    reply = F.concat(F.lit('Of {"k": -1} or so: ```json '), F.coalesce("props", F.lit("nothing")), F.lit(" ``` it is."))
    last = F.regexp_extract(reply, r"(\{[^{}]*\})[^{}]*$", 1)
    return table(spark, sf_dir, "events").groupBy(F.get_json_object(last, "$.k").try_cast("long").alias("k")).agg(F.count("*").alias("n"))


def resolved_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that are customers' numbers or names, resolved to numbers: two left joins, the number first."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0"))).otherwise(F.col("o_custkey").cast("string")).alias("key"))
    by_id = c.select(F.col("c_custkey").cast("string").alias("key"), F.col("c_custkey").alias("i"))
    by_name = c.select(F.col("c_name").alias("key"), F.col("c_custkey").alias("j"))
    return o.join(by_id, "key", "left").join(by_name, "key", "left").select("o_orderkey", F.coalesce("i", "j").alias("c_custkey"))


def inspected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty newest documents in which a word occurs, whatever its case."""
    d = table(spark, sf_dir, "documents").where(F.ilike("text", F.lit("%license%")))
    return d.select("doc_id", "lang", "source", "n_chars").orderBy(F.desc("doc_id")).limit(50)


def run_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures of a run over documents, a row each, from one pass: lines, skipped ones, and repeats of a text."""
    d = table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("k")).agg(F.count("*").alias("m"))
    total = d.agg(F.sum("m").alias("source_lines"), F.sum(F.when(F.col("k").isNull(), F.col("m")).otherwise(0)).alias("skipped"), F.sum(F.when(F.col("k").isNotNull(), F.col("m") - 1).otherwise(0)).alias("duplicates"))
    return total.selectExpr("stack(3, 'source_lines', source_lines, 'skipped', skipped, 'duplicates', duplicates) as (key, value)")


def overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of customers to nations with decisions exported over them: an entry that exists wins over a proposed one."""
    mine = table(spark, sf_dir, "customer").where("c_acctbal > 9000").select(F.col("c_custkey").alias("key"), F.lit("keep").alias("action"), F.lit(1).alias("rank"))
    proposed = table(spark, sf_dir, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("key"), F.lit("unlink").alias("action"), F.lit(2).alias("rank"))
    return mine.unionByName(proposed).groupBy("key").agg(F.min_by("action", "rank").alias("action"), F.count("*").alias("n"))


def search_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best three documents for each benchmark item by the full-text score, joined back to their rows."""
    hits = bm25_search(spark, sf_dir).where("rank <= 3")
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars").join(hits, "doc_id").select("item_id", "rank", "doc_id", "lang", "source", "n_chars")


def label_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each language, precision among the five and recall among the ten longest labelled documents, good quality being what is sought."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(table(spark, sf_dir, "labels").where("quality is not null"), "doc_id")
    ranked = d.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n_chars"), "doc_id"))).where("place <= 10")
    good = d.groupBy("lang").agg(F.sum("quality").alias("sought"))
    of = ranked.groupBy("lang").agg(F.avg(F.when(F.col("place") <= 5, F.col("quality"))).alias("p"), F.sum("quality").alias("found"))
    return of.join(good, "lang").select("lang", F.round("p", 6).alias("precision_at_5"), F.round(F.col("found") / F.nullif(F.col("sought"), F.lit(0)), 6).alias("recall_at_10"))


def centroid_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors whose cosine with their label's centroid is 0.5 or more. Positions are summed before they meet the vectors."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("pos", "x")).withColumn("x", F.col("x").cast("double"))
    sums = e.groupBy("label", "pos").agg(F.sum("x").alias("s"))
    norm = sums.groupBy("label").agg(F.sqrt(F.sum(F.col("s") * F.col("s"))).alias("length"))
    dots = e.join(sums, ["label", "pos"]).groupBy("label", "vec_id").agg(F.sum(F.col("x") * F.col("s")).alias("dot"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("own"))
    cosine = F.col("dot") / F.greatest(F.col("own") * F.col("length"), F.lit(1e-12))
    return dots.join(norm, "label").select("vec_id", "label", F.round(cosine, 5).alias("cosine"), (cosine >= 0.5).alias("kept"))


def same_name_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands that share a part name: the brand of most parts with each other one, with the numbers of parts. Pairs go by the first brand only."""
    n = table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("name"), F.col("p_brand").alias("other")).agg(F.count("*").alias("n"))
    first = n.groupBy("name").agg(F.max_by(F.struct(F.col("other").alias("brand"), F.col("n").alias("most")), F.struct("n", "other")).alias("f"), F.count("*").alias("brands")).where("brands > 1")
    return n.join(first, "name").where("other <> f.brand").groupBy(F.col("f.brand").alias("brand"), "other").agg(F.count("*").alias("names"), F.sum("n").alias("parts"))


def alias_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and titles of pages as names: how many are usable, and how many look like proper names."""
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    names = table(spark, sf_dir, "pages").select(F.explode(F.array_append(F.split(title, " +"), title)).alias("name")).where("name <> ''")
    return names.groupBy(usable_alias(F.col("name"), STOP_WORDS).alias("usable"), proper_name(F.col("name")).alias("proper")).agg(F.count("*").alias("n"), F.countDistinct("name").alias("names"))


def phrase_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the last two words of an item stand first in it."""
    w = words(F.col("text"))
    return table(spark, sf_dir, "benchmark").where(F.size(w) >= 2).select("item_id", position_in(w, F.slice(w, -2, 2)).alias("place"))


def question_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as lines of an extended-JSON export, read back as question records: ids, stripped answers, numbers and filled fields."""
    t = table(spark, sf_dir, "conversations").where("conv_id is not null and turn is not null")
    tag = F.when(F.col("turn") % 4 == 0, " <Ed. AB> (1)").when(F.col("turn") % 4 == 1, " [A] [ABCD]").when(F.col("turn") % 4 == 2, " (1984)").otherwise("</b>")
    oid = F.struct(F.concat_ws("-", "conv_id", "turn").alias("$oid"))
    packet = F.when(F.col("turn") % 2 == 0, F.struct(F.lit("P").alias("name")))
    record = F.struct(oid.alias("_id"), F.col("text").alias("question_sanitized"), F.concat("role", tag).alias("answer_sanitized"), F.col("role").alias("subcategory"), F.struct(F.col("turn").alias("$numberInt")).alias("difficulty"), packet.alias("packet"))
    return question_rows(t.select(F.to_json(record).alias("value"))).select("id", "answer", "subcategory", "difficulty", "meta_score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    eligible_documents, practice_filter, due_cards, span_lookup, impact, followed_rollup, rating_stats, job_counts, size_buckets, reviewed_lines, source_terms, counts_per_user,
    cited_titles, confusions_top5, best_line, best_values, slugs, roulette, audit_sample, claim_order, shown_names, said_first, trade_checks, progress, cards_filled, open_once, ready_jobs, refreshed,
    durations, quota_resets, dates_printed, replies, resolved_keys, inspected, run_meta, overrides, question_records, search_hits, label_ranks, centroid_gate, same_name_pairs, alias_kinds,
    phrase_places,
)}

ORACLES: dict[str, str] = {
    "eligible_documents": "SELECT coalesce(lang, 'Unknown') AS lang, coalesce(source, '') AS source, count(*) AS n, min(doc_id) AS first_id FROM documents WHERE source <> 'forum' AND trim(coalesce(text, '')) <> '' AND n_chars >= 50 GROUP BY ALL",
    "practice_filter": "SELECT p_partkey, p_brand, p_size FROM part WHERE (p_type LIKE 'STANDARD%' OR p_type LIKE '%BRASS') AND p_size BETWEEN 5 AND 30 AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 50)",
    "due_cards": "SELECT c_custkey, c_mktsegment, CAST(last_day AS VARCHAR) AS last_day FROM (SELECT o_custkey, CAST(max(o_orderdate) AS DATE) AS last_day FROM orders GROUP BY 1) JOIN customer ON c_custkey = o_custkey WHERE c_acctbal >= 0 AND c_mktsegment IN ('BUILDING', 'MACHINERY') AND last_day + 90 <= (SELECT CAST(max(o_orderdate) AS DATE) FROM orders)",
    "span_lookup": """SELECT l_orderkey, l_linenumber, place, e - q AS start, e AS "end" FROM (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS q, CAST(sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS BIGINT) AS e FROM lineitem) JOIN (SELECT o_orderkey, o_orderkey * 7 % 60 AS place FROM orders) ON l_orderkey = o_orderkey WHERE e - q <= place AND place < e""",
    "impact": "SELECT l_partkey, count(DISTINCT l_suppkey) AS sets, round(sqrt(count(DISTINCT l_suppkey)) * power(greatest(1 - median(l_linenumber) / 8 + 0.25 * avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END), 0), 0.25) * (1 + 0.3 * avg(CASE WHEN l_linestatus = 'F' THEN 1.0 ELSE 0.0 END)), 6) AS impact FROM lineitem GROUP BY l_partkey",
    "followed_rollup": "SELECT c_custkey, c_nationkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus IN ('F', 'O')) AS judged, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS correct FROM customer WHERE c_acctbal < 0",
    "rating_stats": "SELECT rating, count(*) AS n, count(*) FILTER (CAST(ts AS DATE) + rating <= today) AS due, count(*) FILTER (CAST(ts AS DATE) = today) AS today FROM (SELECT ts, CAST(least(4, greatest(1, floor(value / 25) + 1)) AS INTEGER) AS rating, (SELECT CAST(max(ts) AS DATE) FROM events) AS today FROM events) GROUP BY rating",
    "job_counts": "SELECT o_orderpriority, string_agg(o_orderstatus || ':' || n, ',' ORDER BY o_orderstatus) AS counts FROM (SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL) GROUP BY 1",
    "size_buckets": "SELECT CASE m WHEN 1 THEN '1' WHEN 2 THEN '2' ELSE '3+' END AS bucket, count(*) AS n, CAST(sum(m) AS BIGINT) AS n_lines FROM (SELECT l_orderkey, count(*) AS m FROM lineitem GROUP BY 1) GROUP BY 1",
    "reviewed_lines": r"SELECT substr(sha1(trim(regexp_replace(text, '[ \t\r\n]+', ' ', 'g'))), 1, 16) AS line_key, count(*) AS n, min(conv_id) AS first_conv, max(conv_id) AS last_conv, min(role) AS role_low, max(role) AS role_high FROM conversations WHERE text IS NOT NULL GROUP BY 1",
    "source_terms": "SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY source ORDER BY n DESC, first_id, term) AS INTEGER) AS place FROM (SELECT source, term, count(*) AS n, min(doc_id) AS first_id FROM (SELECT source, doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]{7,}'))) AS term FROM documents WHERE text IS NOT NULL) GROUP BY ALL)) WHERE place <= 5",
    "counts_per_user": "SELECT user_id, string_agg(event_type || ':' || n, ',' ORDER BY event_type) AS counts, CAST(sum(n) AS BIGINT) AS n FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY 1",
    "cited_titles": "SELECT trim(regexp_replace(lower(p_name), '^[^ ]+ ', '')) AS title, count(*) AS n, arg_min(p_brand, p_partkey) AS brand FROM part GROUP BY 1",
    "confusions_top5": f"SELECT a, b, place, score FROM (SELECT *, CAST(row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS INTEGER) AS place FROM ({RELATIONAL['edges_score']}) WHERE score > 0) WHERE place <= 5",
    "best_line": "SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS r FROM lineitem) WHERE r = 1",
    "best_values": "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY length(CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR)) DESC, event_id) AS r FROM events WHERE value IS NOT NULL) WHERE r = 1",
    "slugs": """WITH p AS (SELECT p_partkey, coalesce(n, 0) AS n, regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g') AS plain, lower(replace(p_brand, '#', '')) AS brand FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) ON p_partkey = l_partkey),
r AS (SELECT *, row_number() OVER (PARTITION BY plain ORDER BY n DESC, p_partkey) > 1 AS late FROM p)
SELECT p_partkey, CASE WHEN NOT late THEN plain WHEN row_number() OVER (PARTITION BY plain, brand, late ORDER BY n DESC, p_partkey) = 1 THEN plain || '-' || brand ELSE plain || '-' || p_partkey END AS slug FROM r""",
    "roulette": f"SELECT p_partkey, p_name, md5(CAST(p_partkey AS VARCHAR) || '{SEED}') AS draw FROM part ORDER BY draw LIMIT 20",
    "audit_sample": f"SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY quality ORDER BY draw, doc_id) AS INTEGER) AS place FROM (SELECT doc_id, quality, toxic, md5('{SEED}' || CAST(doc_id AS VARCHAR)) AS draw FROM labels WHERE quality IS NOT NULL)) WHERE place <= 20",
    "claim_order": "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderpriority, o_orderkey LIMIT 20",
    "shown_names": "SELECT p_brand, p_partkey, place FROM (SELECT p_brand, p_partkey, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY starts_with(p_type, 'PROMO'), p_retailprice DESC, p_name, p_partkey) AS INTEGER) AS place FROM part) WHERE place <= 8",
    "said_first": "SELECT conv_id, min(turn) AS turn, count(*) AS times FROM conversations WHERE text IS NOT NULL GROUP BY conv_id, lower(text)",
    "trade_checks": """WITH pairs AS (SELECT DISTINCT s_nationkey AS a, c_nationkey AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN customer ON o_custkey = c_custkey)
SELECT 'missing' AS finding, n_nationkey AS a, n_nationkey + 1 AS b FROM nation WHERE n_nationkey + 1 < 25 AND NOT EXISTS (SELECT 1 FROM pairs WHERE a = n_nationkey AND b = n_nationkey + 1) UNION ALL SELECT 'wrong', a, b FROM pairs WHERE a = b""",
    "progress": "SELECT user_id, event_type, max(value) AS through, max(event_id) AS last_event FROM events GROUP BY ALL",
    "cards_filled": "SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN c_acctbal ELSE CAST(latest AS DOUBLE) END AS balance, c_acctbal < 0 AND open = 0 AS suspended FROM customer JOIN (SELECT o_custkey, max(o_orderkey) AS latest, count(*) FILTER (o_orderstatus = 'O') AS open FROM orders GROUP BY 1) ON c_custkey = o_custkey",
    "open_once": "SELECT o_custkey, o_orderpriority, min(o_orderkey) AS o_orderkey, count(*) - 1 AS refused FROM orders WHERE o_orderstatus = 'O' GROUP BY ALL",
    "ready_jobs": "SELECT o_orderkey, CASE WHEN EXISTS (SELECT 1 FROM orders x WHERE x.o_custkey = o.o_custkey AND x.o_orderstatus = 'F') THEN 'ready' WHEN EXISTS (SELECT 1 FROM orders x WHERE x.o_custkey = o.o_custkey AND x.o_orderstatus = 'P') THEN 'ready without' ELSE 'waits' END AS state FROM orders o WHERE o_orderstatus = 'O'",
    "refreshed": "SELECT user_id, event_type, CASE WHEN event_type IN ('click', 'purchase') THEN 0 ELSE count(*) END AS stored, CAST(event_type IN ('click', 'purchase') AS INTEGER) AS queued FROM events GROUP BY user_id, event_type",
    "durations": "SELECT event_type, CAST(sum(hour(ts) * 3600 + minute(ts) * 60 + second(ts)) AS BIGINT) AS seconds, max('PT' || CASE WHEN hour(ts) > 0 THEN hour(ts) || 'H' ELSE '' END || CASE WHEN minute(ts) > 0 THEN minute(ts) || 'M' ELSE '' END || CASE WHEN second(ts) > 0 THEN second(ts) || 'S' ELSE '' END) AS longest_print FROM events GROUP BY 1",
    "quota_resets": "SELECT strftime((date_trunc('day', ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/Los_Angeles') + INTERVAL 1 DAY + INTERVAL 5 MINUTE) AT TIME ZONE 'America/Los_Angeles' AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M') AS reset_at, count(*) AS n FROM events GROUP BY 1",
    "dates_printed": "SELECT CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN strftime(o_orderdate, '%Y-%m-%d') WHEN '2' THEN strftime(o_orderdate, '%Y-%m') WHEN '3' THEN CAST(year(o_orderdate) AS VARCHAR) ELSE CAST(ceil(year(o_orderdate) / 100) AS INTEGER) || 'th century' END AS printed, count(*) AS n FROM orders GROUP BY 1",
    "replies": "SELECT CASE WHEN props IS NULL THEN -1 ELSE TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k, count(*) AS n FROM events GROUP BY 1",
    "resolved_keys": "SELECT o_orderkey, c_custkey FROM orders LEFT JOIN customer ON c_custkey = o_custkey",
    "inspected": "SELECT doc_id, lang, source, n_chars FROM documents WHERE text ILIKE '%license%' ORDER BY doc_id DESC LIMIT 50",
    "run_meta": "SELECT 'source_lines' AS key, count(*) AS value FROM documents UNION ALL SELECT 'skipped', count(*) FROM documents WHERE text IS NULL UNION ALL SELECT 'duplicates', count(text) - count(DISTINCT text) FROM documents",
    "question_records": """SELECT conv_id || '-' || turn AS id, role || CASE turn % 4 WHEN 2 THEN ' (1984)' WHEN 3 THEN '</b>' ELSE '' END AS answer, role AS subcategory, CAST(turn AS INTEGER) AS difficulty,
        CASE WHEN coalesce(role, '') = '' THEN 0 ELSE 1 END + 1 + CASE WHEN turn % 2 = 0 THEN 1 ELSE 0 END AS meta_score FROM conversations WHERE trim(text) <> '' AND role IS NOT NULL""",
    "search_hits": f"SELECT item_id, rank, doc_id, lang, source, n_chars FROM ({KNOWLEDGE['bm25_search']}) JOIN documents USING (doc_id) WHERE rank <= 3",
    "label_ranks": """WITH d AS (SELECT lang, quality, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS place FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL)
SELECT lang, round(avg(quality) FILTER (place <= 5), 6) AS precision_at_5, round(sum(quality) FILTER (place <= 10) / nullif(sum(quality), 0), 6) AS recall_at_10 FROM d GROUP BY lang""",
    "centroid_gate": """WITH e AS (SELECT vec_id, label, unnest(range(len(embedding))) AS pos, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings), s AS (SELECT label, pos, sum(x) AS s FROM e GROUP BY ALL), n AS (SELECT label, sqrt(sum(s * s)) AS length FROM s GROUP BY label),
c AS (SELECT vec_id, label, sum(x * s) / sqrt(sum(x * x)) AS d FROM e JOIN s USING (label, pos) GROUP BY ALL) SELECT vec_id, label, round(d / length, 5) AS cosine, d / length >= 0.5 AS kept FROM c JOIN n USING (label)""",
    "same_name_pairs": """WITH n AS (SELECT p_name, p_brand, count(*) AS n, row_number() OVER (PARTITION BY p_name ORDER BY count(*) DESC, p_brand DESC) AS r FROM part GROUP BY p_name, p_brand)
SELECT f.p_brand AS brand, o.p_brand AS other, count(*) AS names, CAST(sum(o.n) AS BIGINT) AS parts FROM n f JOIN n o ON f.p_name = o.p_name AND f.r = 1 AND o.r > 1 GROUP BY f.p_brand, o.p_brand""",
    "alias_kinds": f"""WITH t AS (SELECT regexp_extract(html, '<title>([^<]*)</title>', 1) AS t FROM pages), w AS (SELECT unnest(list_append(regexp_split_to_array(t, ' +'), t)) AS name FROM t)
SELECT length(regexp_replace(lower(name), '[^a-z0-9]', '', 'g')) >= 3 AND NOT regexp_full_match(regexp_replace(lower(name), '[^a-z0-9]', '', 'g'), '[0-9]+') AND lower(trim(name)) NOT IN {STOP_WORDS} AS usable,
  regexp_matches(name, '[A-Za-z]{{3}}') AND NOT regexp_matches(name, '(^|[^A-Za-z])[a-z][A-Za-z]{{2}}') AS proper, count(*) AS n, count(DISTINCT name) AS names FROM w WHERE name <> '' GROUP BY 1, 2""",
    "phrase_places": "SELECT item_id, CAST(list_min([i - 1 FOR i IN range(1, len(w)) IF w[i : i + 1] = w[len(w) - 1 : len(w)]]) AS INTEGER) AS place FROM (SELECT item_id, regexp_extract_all(lower(text), '[a-z]+') AS w FROM benchmark) WHERE len(w) >= 2",
    "overrides": "SELECT key, CASE WHEN min(rank) = 1 THEN 'keep' ELSE 'unlink' END AS action, count(*) AS n FROM (SELECT c_custkey AS key, 1 AS rank FROM customer WHERE c_acctbal > 9000 UNION ALL SELECT o_custkey, 2 FROM orders WHERE o_totalprice > 300000) GROUP BY key",
}
