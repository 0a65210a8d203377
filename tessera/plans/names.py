"""Names that look alike, and what can be confused with what."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.text import base_name, is_lookalike
from tessera.plans.corpus import table
from tessera.plans.knowledge import NORM

# Parts a topic must have for either kind of pair, owners of a name, likeness of vectors, weights, pairs kept.
SAME_QUESTIONS, LOOK_QUESTIONS, OWNERS, LIKENESS = 2, 3, 8, 0.6
SAME_WEIGHT, LOOK_WEIGHT, KEPT = 1.0, 0.5, 5


def _without(w: Column, i: Column) -> Column:
    return F.concat(F.substr(w, F.lit(1), i - 1), F.substr(w, i + 1))


def _keyed(names: DataFrame, col: str) -> DataFrame:
    """Rows with each form of a text that has up to two of its letters left out, as ``key``."""
    none = F.array().cast("array<string>")
    w = F.col(col)
    one = F.when(F.length(w) >= 1, F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: _without(w, i))).otherwise(none)
    # the second letter left out stands behind the first
    places = F.sequence(F.lit(1), F.length(w) - 1)
    two = F.when(F.length(w) >= 2, F.flatten(F.transform(places, lambda i: F.transform(F.sequence(i, F.length(w) - 1), lambda k: _without(_without(w, i), k))))).otherwise(none)
    return names.select("*", F.explode(F.array_distinct(F.concat(F.array(w), one, two))).alias("key"))


def lookalike_pairs(names: DataFrame) -> DataFrame:
    """(kind, a, b) of names (kind, name) of one kind that look alike, a < b; repeats count once, nulls never.

    Names that differ in digits only are no pair, however many there are, so shapes (names without digits) meet first, on
    keys with up to two letters left out; only names of two shapes that are near each other meet on keys of their own.
    """
    named = names.where("length(name) >= 4").distinct().withColumn("shape", F.regexp_replace("name", r"\d", ""))
    shapes = _keyed(named.select("kind", "shape").distinct(), "shape")
    met = shapes.withColumnRenamed("shape", "one").join(shapes.withColumnRenamed("shape", "other"), ["kind", "key"]).where("one < other")
    near = met.select("kind", "one", "other").distinct().where("levenshtein(one, other, 2) >= 0")
    side = lambda shape, a: _keyed(near.join(named.select("kind", F.col("shape").alias(shape), F.col("name").alias(a)), ["kind", shape]), a)
    pairs = side("one", "x").join(side("other", "y"), ["kind", "one", "other", "key"]).select("kind", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    return pairs.where(is_lookalike(F.col("a"), F.col("b")))


def lookalike_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of names of customers, of suppliers and of parts that look alike, by their base names."""
    of = lambda t, c: table(spark, sf_dir, t).select(F.lit(t).alias("kind"), base_name(F.col(c)).alias("name"))
    return lookalike_pairs(of("customer", "c_name").unionByName(of("supplier", "s_name")).unionByName(of("part", "p_name")))


def same_names(topics: DataFrame) -> DataFrame:
    """(a, b) of topics (topic, name, n) that share a name of four letters or more which at most OWNERS topics have."""
    owners = topics.where(F.col("n") >= SAME_QUESTIONS).where("length(name) >= 4").select("topic", "name")
    shared = owners.groupBy("name").count().where(F.col("count").between(2, OWNERS)).select("name")
    few = owners.join(shared, "name")
    return few.withColumnRenamed("topic", "a").join(few.withColumnRenamed("topic", "b"), "name").where("a < b").select("a", "b")


def like_vectors(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """Pairs (a, b) whose centroids, of vectors (topic, vector), have a cosine of LIKENESS or more; a topic without a vector is in none.

    Positions are summed before they meet the pairs, so no topic's vectors are ever in one task.
    """
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("topic")).distinct()
    sums = vectors.join(wanted, "topic", "left_semi").select("topic", F.posexplode("vector").alias("pos", "x")).groupBy("topic", "pos").agg(F.sum(F.col("x").cast("double")).alias("x"))
    whole = sums.groupBy("topic").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("v"))  # as many as a vector is long
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
    side = lambda c: whole.select(F.col("topic").alias(c), F.col("v").alias(f"v{c}"))
    cosine = dot("va", "vb") / F.greatest(F.sqrt(dot("va", "va")) * F.sqrt(dot("vb", "vb")), F.lit(1e-9))
    return pairs.join(side("a"), "a").join(side("b"), "b").where(F.round(cosine, 9) >= LIKENESS).select("a", "b")


def confused(topics: DataFrame, rejects: DataFrame, vectors: DataFrame) -> DataFrame:
    """The KEPT topics most easily taken for each topic: place, score, questions that reject it and whether names are the same or look alike.

    Topics are (topic, kind, name, n questions), rejects (topic, other, question). The score is ln(1 + questions with a
    reject between the two), SAME_WEIGHT for a shared name and LOOK_WEIGHT for look-alike names of like vectors and one kind.
    """
    ordered = rejects.where("topic <> other").select(F.least("topic", "other").alias("a"), F.greatest("topic", "other").alias("b"), "question").distinct()
    rejected = ordered.groupBy("a", "b").agg(F.count("*").alias("rejects"))
    some = topics.where(F.col("n") >= LOOK_QUESTIONS).select("kind", "name", "topic")
    alike = lookalike_pairs(some.select("kind", "name"))
    for c in ("a", "b"):
        alike = alike.join(some.select("kind", F.col("name").alias(c), F.col("topic").alias(f"t{c}")), ["kind", c])
    look = like_vectors(alike.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")), vectors)
    signals = [rejected.select("a", "b", "rejects", F.lit(0).alias("same"), F.lit(0).alias("look"))]
    signals += [same_names(topics).select("a", "b", F.lit(0).cast("long").alias("rejects"), F.lit(1).alias("same"), F.lit(0).alias("look"))]
    signals += [look.select("a", "b", F.lit(0).cast("long").alias("rejects"), F.lit(0).alias("same"), F.lit(1).alias("look"))]
    pairs = signals[0].unionByName(signals[1]).unionByName(signals[2]).groupBy("a", "b").agg(F.sum("rejects").alias("rejects"), F.max("same").alias("same"), F.max("look").alias("look"))
    score = F.round(F.log1p("rejects") + SAME_WEIGHT * F.col("same") + LOOK_WEIGHT * F.col("look"), 4)
    ends = F.explode(F.array(F.struct(F.col("a").alias("topic"), F.col("b").alias("other")), F.struct(F.col("b").alias("topic"), F.col("a").alias("other"))))
    both = pairs.select(ends.alias("e"), score.alias("score"), "rejects", (F.col("same") == 1).alias("same_name"), (F.col("look") == 1).alias("lookalike")).select("e.*", "score", "rejects", "same_name", "lookalike")
    place = F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("score"), "other"))
    return both.withColumn("place", place).where(F.col("place") <= KEPT)


def confusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confusions of part names, each kind of part apart: a returned line rejects the part of the order's next line; parts are questions and vectors go by their keys."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.concat_ws("/", "p_type", base_name(F.col("p_name"))).alias("topic"), F.col("p_type").alias("kind"), base_name(F.col("p_name")).alias("name"))
    topics = part.groupBy("topic", "kind", "name").agg(F.count("*").alias("n"))
    following = F.lead("l_partkey").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_returnflag"))  # over an order's lines, whose numbers can repeat
    returned = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag", following.alias("next")).where("l_returnflag = 'R' and next is not null")
    own = returned.join(part.select("key", "topic"), F.col("l_partkey") == F.col("key")).drop("key")
    rejects = own.join(part.select("key", F.col("topic").alias("other")), F.col("next") == F.col("key")).select("topic", "other", F.col("l_orderkey").alias("question"))
    vectors = table(spark, sf_dir, "embeddings").join(part, F.col("vec_id") == F.col("key")).select("topic", F.col("embedding").alias("vector"))
    return confused(topics, rejects, vectors)


QUERIES = {f.__name__: f for f in (lookalike_names, confusions)}

_BASE = lambda c: NORM.format(rf"regexp_replace({c}, '\s*\([^)]*\)', '', 'g')")
_DIGITS = lambda c: f"regexp_replace({c}, '[0-9]', '', 'g')"
_ALIKE = f"""x.kind = y.kind AND x.name < y.name AND abs(length(x.name) - length(y.name)) <= 2 AND least(length(x.name), length(y.name)) >= 4 AND {_DIGITS("x.name")} <> {_DIGITS("y.name")}
        AND levenshtein(x.name, y.name) <= CASE WHEN greatest(length(x.name), length(y.name)) < 8 THEN 1 ELSE 2 END AND NOT contains(x.name, y.name) AND NOT contains(y.name, x.name)"""
ORACLES = {
    "lookalike_names": f"""WITH n AS (SELECT 'customer' AS kind, {_BASE("c_name")} AS name FROM customer UNION SELECT 'supplier', {_BASE("s_name")} FROM supplier UNION SELECT 'part', {_BASE("p_name")} FROM part)
        SELECT x.kind, x.name AS a, y.name AS b FROM n x JOIN n y ON {_ALIKE}""",
    "confusions": f"""WITH p AS (SELECT p_partkey AS key, p_type AS kind, {_BASE("p_name")} AS name, p_type || '/' || {_BASE("p_name")} AS topic FROM part),
        t AS (SELECT topic, kind, name, count(*) AS n FROM p GROUP BY ALL),
        l AS (SELECT l_orderkey, l_partkey, l_returnflag, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_returnflag) AS next FROM lineitem),
        r AS (SELECT least(p.topic, o.topic) AS a, greatest(p.topic, o.topic) AS b, count(DISTINCT l_orderkey) AS rejects, 0 AS same, 0 AS look FROM l JOIN p ON l_partkey = p.key JOIN p o ON next = o.key WHERE l_returnflag = 'R' AND p.topic <> o.topic GROUP BY 1, 2),
        s AS (SELECT name FROM t WHERE n >= {SAME_QUESTIONS} AND length(name) >= 4 GROUP BY name HAVING count(*) BETWEEN 2 AND {OWNERS}),
        m AS (SELECT x.topic AS a, y.topic AS b, 0, 1, 0 FROM t x JOIN t y ON x.name = y.name AND x.topic < y.topic WHERE x.n >= {SAME_QUESTIONS} AND y.n >= {SAME_QUESTIONS} AND x.name IN (SELECT name FROM s)),
        v AS (SELECT topic, list(x ORDER BY pos) AS v FROM (SELECT topic, pos, sum(CAST(x AS DOUBLE)) AS x FROM (SELECT topic, unnest(embedding) AS x, unnest(range(len(embedding))) AS pos FROM embeddings JOIN p ON vec_id = key) GROUP BY 1, 2) GROUP BY 1),
        k AS (SELECT least(x.topic, y.topic) AS a, greatest(x.topic, y.topic) AS b, 0, 0, 1 FROM t x JOIN t y ON {_ALIKE} JOIN v vx ON vx.topic = x.topic JOIN v vy ON vy.topic = y.topic WHERE x.n >= {LOOK_QUESTIONS} AND y.n >= {LOOK_QUESTIONS} AND round(list_cosine_similarity(vx.v, vy.v), 9) >= {LIKENESS}),
        u AS (SELECT a, b, CAST(sum(rejects) AS BIGINT) AS rejects, max(same) AS same, max(look) AS look FROM (SELECT * FROM r UNION ALL SELECT * FROM m UNION ALL SELECT * FROM k) GROUP BY a, b),
        e AS (SELECT topic, other, round(ln(1 + rejects) + {SAME_WEIGHT} * same + {LOOK_WEIGHT} * look, 4) AS score, rejects, same = 1 AS same_name, look = 1 AS lookalike FROM (SELECT a AS topic, b AS other, * FROM u UNION ALL SELECT b, a, * FROM u))
        SELECT topic, other, score, rejects, same_name, lookalike, CAST(row_number() OVER (PARTITION BY topic ORDER BY score DESC, other) AS INTEGER) AS place FROM e QUALIFY place <= {KEPT}""",
}
