"""Spellings of part names: near ones, and groups of one thing with their labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.keys import spelling
from tessera.operators.spellings import labelled, merged, near_pairs
from tessera.plans.corpus import table


def spelled_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions (group, form, sentence, known): each part names its name in one of 16 ways, by its number; the brand is the group, the part the sentence."""
    part = table(spark, sf_dir, "part")
    ws = F.split("p_name", " ")
    a, b = F.initcap(F.get(ws, F.lit(0))), F.initcap(F.get(ws, F.lit(1)))
    text = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in xs])
    ways = [
        text(a, " ", b), text(a, " ", b), text(a, " ", b, "s"), text(a, " ", b, " works"), text(a, " ", b, " Valley"), text("Battle of ", a, " ", b), a, text(b, "'s Bridge"),
        text("the ", F.lower(a), " ", F.lower(b)), text("General ", a, " ", b), text(a, " Q. ", b), text(a, " and ", b), text(F.left(a, F.length(a) - 1), " ", b), text(a, " ", b, "e"), b, text("New ", a, "-", b),
    ]
    way = F.pmod("p_partkey", F.lit(len(ways))).cast("int")
    return part.select(F.col("p_brand").alias("group"), F.get(F.array(*ways), way).alias("form"), F.floor(F.col("p_partkey") / 3).alias("sentence"), F.when(way.isin(1, 7), F.col("p_type")).alias("known"))


def near_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of names of a brand that are one spelling apart."""
    keys = spelled_parts(spark, sf_dir).select("group", "form").distinct().select("group", spelling(F.col("form"))["key"].alias("key"))
    return near_pairs(keys)


def spelling_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All spellings of a brand's names with the one name and label of those that are one thing."""
    groups = merged(spelled_parts(spark, sf_dir))
    return groups.join(labelled(groups), ["group", "root"]).select("group", "name", "n", "root", "label", "n_spellings")


QUERIES = {f.__name__: f for f in (near_spellings, spelling_groups)}

ORACLES = {
    "near_spellings": r"""WITH p AS (SELECT p_brand AS g, p_partkey % 16 AS k, upper(left(split_part(p_name, ' ', 1), 1)) || substr(split_part(p_name, ' ', 1), 2) AS a, upper(left(split_part(p_name, ' ', 2), 1)) || substr(split_part(p_name, ' ', 2), 2) AS b FROM part),
        f AS (SELECT DISTINCT g, CASE WHEN k < 2 THEN a || ' ' || b WHEN k = 2 THEN a || ' ' || b || 's' WHEN k = 3 THEN a || ' ' || b || ' work' WHEN k = 4 THEN a || ' ' || b || ' valley' WHEN k = 5 THEN 'battle of ' || a || ' ' || b WHEN k = 6 THEN a WHEN k = 7 THEN b || ' bridge'
          WHEN k IN (8, 9, 10) THEN a || ' ' || b WHEN k = 11 THEN a || ' and ' || b WHEN k = 12 THEN left(a, len(a) - 1) || ' ' || b WHEN k = 13 THEN a || ' ' || b || 'e' WHEN k = 14 THEN b ELSE 'new ' || a || ' ' || b END AS name FROM p),
        n AS (SELECT DISTINCT g, lower(name) AS name, string_split(lower(name), ' ') AS w FROM f),
        x AS (SELECT l.g, l.name AS a, r.name AS b, l.w AS v, r.w AS w, [i FOR i IN range(1, len(l.w) + 1) IF l.w[i] <> r.w[i]] AS d FROM n l JOIN n r ON l.g = r.g AND l.name <> r.name AND len(l.w) = len(r.w)),
        y AS (SELECT g, a, b, v, w, v[d[1]] AS s, w[d[1]] AS t, d[1] = len(v) AS last_ FROM x WHERE len(d) = 1)
        SELECT DISTINCT g AS "group", least(a, b) AS a, greatest(a, b) AS b FROM y
        WHERE (last_ AND (t = s || 's' OR t = s || 'es')) OR levenshtein(s, t) = 1 AND CASE WHEN len(v) = 1 THEN len(s) = len(t) AND len(s) >= 5 AND regexp_full_match(s || t, '[a-z]*') ELSE least(len(s), len(t)) >= 5 OR len(s) >= 4 AND t = s || 'e' END""",
}
