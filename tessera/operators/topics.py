"""Topics of linked and unlinked groups: overrides, sets of one answer that are alike, ids and slugs that no two topics share.

Tables (one row for each group; rows without a group are left out):

- groups: group, key (the answer, normalised), name (as shown), category, members;
- links: group, topic, title, of the groups that are linked well enough;
- unlinks: key, category, topic, of links that name a different thing;
- shared: group, thing; unlinked groups of one key that share a thing are alike, and what is alike is chained. Each thing gives a star of edges, no pairs.

The larger group comes first, of equals the smaller number; null categories and overrides of these meet as empty ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import fold, slugify
from tessera.operators.graph import components
from tessera.sources.tables import stored


def claimed(rows: DataFrame, key: str, order: str) -> DataFrame:
    """(key, name): each of rows (key, order, wants) gets the first of the names it wants that none before it, by order, took.

    The same as one after another in order: each row asks for its next name, of those who ask for a name the first in order holds it, and who is
    turned away goes on, until all hold one. A round is a minimum for each name and a join on the key, so a name that very many want is no hot task.
    Behind the last wish come numbers from 2, so the last should tell rows apart. Keys and orders are distinct, wishes not empty; a row with no key is left out.
    """
    size, k, own = F.size("_wants"), F.col("_k"), F.col("_key")
    name = F.when(k < size, F.get("_wants", k)).otherwise(F.concat_ws("-", F.get("_wants", size - 1), k - size + 2))
    state = rows.where(F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.col(order).alias("_order"), F.col("wants").alias("_wants"), F.lit(0).alias("_k"))
    while True:
        asks = stored(state.withColumn("_name", name))
        held = asks.groupBy("_name").agg(F.min_by("_key", "_order").alias("_key")).select("_key", F.lit(1).alias("_holds"))
        asks = stored(asks.join(held, "_key", "left"))
        if asks.where("_holds is null").isEmpty():
            return asks.select(own.alias(key), F.col("_name").alias("name"))
        state = asks.select("_key", "_order", "_wants", (k + 1 - F.coalesce("_holds", F.lit(0))).alias("_k"))


def slug_wishes(name: Column, topic: Column) -> Column:
    """A slug without the article, with it, with the topic's id; "topic" where a name has no letters."""
    plain = F.coalesce(F.nullif(slugify(name), F.lit("")), F.lit("topic"))
    whole = F.regexp_replace(F.regexp_replace(fold(name), "[^a-z0-9]++", "-"), "^-|-$", "")
    of = slugify(F.regexp_replace(topic, "^local:", ""))
    return F.filter(F.array(plain, whole, F.concat_ws("-", plain, of)), lambda w: w.isNotNull() & (w != ""))


def with_topics(groups: DataFrame, links: DataFrame, unlinks: DataFrame, shared: DataFrame) -> DataFrame:
    """(group, key, name, category, members, topic, title): a linked group's topic is its link's, unless an override says no.

    The others' are ids local:<slug of the key>; the first set of a key in order wants that, the others want their category behind it, then their first group's number.
    """
    blank = lambda c: F.coalesce(c, F.lit(""))
    no = unlinks.select("key", blank(F.col("category")).alias("_category"), "topic", F.lit(True).alias("_no")).distinct()
    linked = groups.where(F.col("group").isNotNull()).join(links, "group", "left").withColumn("_category", blank(F.col("category"))).join(no, ["key", "_category", "topic"], "left")
    named = F.col("_no").isNull() & F.col("topic").isNotNull()
    rows = stored(linked.select("group", "key", "name", "category", "members", F.when(named, F.col("topic")).alias("topic"), F.when(named, F.col("title")).alias("title")))

    free = rows.where("topic is null").select("group", blank(F.col("key")).alias("key"), "category", F.struct((-F.coalesce("members", F.lit(0))).alias("less"), "group").alias("order"))
    things = stored(shared.where(F.col("thing").isNotNull()).join(free.select("group", "key"), "group").distinct())
    centres = things.groupBy("key", "thing").agg(F.min("group").alias("a"), F.max("group").alias("b")).where("a < b").drop("b")
    edges = things.withColumnRenamed("group", "b").join(centres, ["key", "thing"]).where("a < b").select("a", "b").distinct()
    sets = stored(free.join(components(edges).withColumnRenamed("id", "group"), "group", "left").withColumn("set", F.coalesce("root", "group")))
    firsts = sets.groupBy("set").agg(F.min_by(F.struct("group", "key", "category", "order"), "order").alias("f")).select("set", "f.*")
    leads = firsts.groupBy("key").agg(F.min_by("set", "order").alias("set")).select("set", F.lit(True).alias("lead"))
    base = F.concat(F.lit("local:"), slugify(F.col("key")))
    slug = F.nullif(slugify(blank(F.col("category"))), F.lit(""))
    wants = F.concat(F.when(F.col("lead"), F.array(base)).otherwise(F.array().cast("array<string>")), F.array(F.concat_ws("-", base, slug), F.concat_ws("-", base, slug, F.col("group"))))
    wishes = firsts.join(leads, "set", "left").select("set", "order", wants.alias("wants"))
    ids = claimed(wishes, "set", "order")
    local = sets.join(ids, "set").select("group", F.col("name").alias("_local"))
    return rows.join(local, "group", "left").select("group", "key", "name", "category", "members", F.coalesce("topic", "_local").alias("topic"), "title")


def topic_table(rows: DataFrame) -> DataFrame:
    """(topic, slug, name, n_groups, members, category) of groups with topics: the link's title or the first group's name, the category of most members.

    Topics with more members choose their slugs first. Of equal categories the smaller wins, a null one last.
    """
    count = F.coalesce("members", F.lit(0))
    by_category = rows.groupBy("topic", "category").agg(F.sum(count).alias("m"), F.count("*").alias("k"), F.min("title").alias("title"), F.min_by("name", F.struct(-count, "group")).alias("name"), F.min(F.struct((-count).alias("less"), "group")).alias("order"))
    topics = by_category.groupBy("topic").agg(
        F.sum("m").alias("members"), F.sum("k").alias("n_groups"), F.coalesce(F.min("title"), F.min_by("name", "order")).alias("name"), F.min_by("category", F.struct(-F.col("m"), F.col("category").isNull(), "category")).alias("category")
    )
    topics = stored(topics)
    wishes = topics.select("topic", F.struct((-F.col("members")).alias("less"), "topic").alias("order"), slug_wishes(F.coalesce("name", F.lit("")), F.col("topic")).alias("wants"))
    slugs = claimed(wishes, "topic", "order").withColumnRenamed("name", "slug")
    return topics.join(slugs, "topic").select("topic", "slug", "name", "n_groups", "members", "category")
