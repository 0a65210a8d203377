"""Groups of ten documents linked to documents as pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.linking import STOP, links, scored
from tessera.plans.corpus import table

#: How pages begin, by document modulo 7; what giveaways ask for, by group modulo 5.
LEADS = (" is a film. ", " was a small village. ", " is a given name. ", " is the second studio album. ", " (16 May 1854 – 1900) was a poet. ", " is a list of films. ", " is a bird. ")
GIVEAWAYS = ("name this film", "name this city", "give this name", "name this thing", "name this song")


def link_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Tables as `tessera.operators.linking` takes them. A document is a question of its ten, and a page for its ten and, the first two, for the ten before."""
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text", F.floor(F.col("doc_id") / 10).alias("group"), (F.col("doc_id") % 10).cast("int").alias("k"))
    by = lambda values, key: F.get(F.array(*map(F.lit, values)), F.pmod(key, F.lit(len(values))).cast("int"))
    questions = docs.select(F.col("doc_id").alias("question"), "group", "text", by(GIVEAWAYS, F.col("group")).alias("giveaway"))
    two = F.array_join(F.slice(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)), 1, 2), " ")
    title = F.concat(two, F.when(F.col("doc_id") % 4 == 1, " (a tale)").otherwise(""))
    pages = docs.select(F.col("doc_id").alias("page"), title.alias("title"), F.concat(two, by(LEADS, F.col("doc_id")), "text").alias("extract"), (F.col("k") == 7).alias("disambiguation"))
    place = F.explode(F.when(F.col("k") < 2, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("back")
    found = docs.select("doc_id", "group", "k", place).select(
        (F.col("group") - F.col("back")).alias("group"), F.col("doc_id").alias("page"), (F.col("k") + 5 * F.col("back")).alias("rank"), F.col("k").isin(4, 8).alias("hinted"),
        F.when(F.col("k") == 9, by((0.35, 0.30, 0.25), F.col("group"))).alias("direct"), (F.col("group") % 6 == 0).alias("ambiguous"),
    ).where("`group` >= 0")
    names = docs.where("k in (3, 6)").where(F.col("group") % 4 < 3).select("group", two.alias("name"), (F.col("k") == 3).alias("main"))
    return questions, pages, found, names


def link_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate with likeness, score and what it is."""
    return scored(*link_tables(spark, sf_dir)).select("group", "page", "likeness", "score", "exact_title", "wrong_kind", "best", "promoted")


def group_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each group's best page and whether it is good enough."""
    return links(scored(*link_tables(spark, sf_dir)))


QUERIES = {f.__name__: f for f in (link_candidates, group_links)}

_W = "array_to_string(regexp_extract_all(lower(text), '[a-z]+')[1:2], ' ')"
_NORM = "regexp_replace(trim(regexp_replace({0}, '[^a-z0-9]+', ' ', 'g')), '^(the|an|a) (.)', '\\2')"
_SCORED = f"""WITH d AS (SELECT doc_id, text, doc_id // 10 AS g, doc_id % 10 AS k, {_W} AS two FROM documents WHERE text IS NOT NULL),
    pg AS (SELECT doc_id AS page, two || CASE WHEN doc_id % 4 = 1 THEN ' (a tale)' ELSE '' END AS title, {_NORM.format('two')} AS plain, doc_id % 7 AS lead, two || [{', '.join(repr(x) for x in LEADS)}][CAST(doc_id % 7 AS INTEGER) + 1] || text AS extract, k = 7 AS dis FROM d),
    q AS (SELECT 'q' AS s, doc_id AS key, text FROM d UNION ALL SELECT 'p', page, title || '. ' || extract FROM pg),
    t AS (SELECT s, key, word, count(*) AS tf FROM (SELECT s, key, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS word FROM q) WHERE word NOT IN ({', '.join(repr(w) for w in STOP)}) GROUP BY ALL),
    v AS (SELECT word, ln((1 + (SELECT count(*) FROM d)) / (1 + count(*))) + 1 AS idf FROM t WHERE s = 'q' GROUP BY word HAVING count(*) >= 2 AND count(*) <= 0.5 * (SELECT count(*) FROM d)),
    w AS (SELECT s, key, word, w / sqrt(sum(w * w) OVER (PARTITION BY s, key)) AS w FROM (SELECT s, key, word, (1 + ln(tf)) * idf AS w FROM t JOIN v USING (word))),
    gw AS (SELECT g, word, w / sqrt(sum(w * w) OVER (PARTITION BY g)) AS v FROM (SELECT key // 10 AS g, word, sum(w) AS w FROM w WHERE s = 'q' GROUP BY ALL)),
    c AS (SELECT g - b AS g, doc_id AS page, k + 5 * b AS rank, k IN (4, 8) AS hinted, CASE WHEN k = 9 THEN [0.35, 0.30, 0.25][CAST(g % 3 AS INTEGER) + 1] END AS direct, g % 6 = 0 AS ambiguous FROM d, (SELECT unnest([0, 1]) AS b) WHERE (b = 0 OR k < 2) AND g - b >= 0),
    sim AS (SELECT c.g, c.page, round(sum(w.w * gw.v), 6) AS likeness FROM c JOIN w ON w.s = 'p' AND w.key = c.page JOIN gw ON gw.g = c.g AND gw.word = w.word GROUP BY ALL),
    nm AS (SELECT g, {_NORM.format('two')} AS name, k = 3 AS main FROM d WHERE k IN (3, 6) AND g % 4 < 3),
    r AS (SELECT c.*, title, lead, coalesce(likeness, 0) AS likeness, CASE WHEN direct = 0.25 AND NOT (lead = 4 AND coalesce(likeness, 0) >= 0.05) THEN 0 ELSE coalesce(direct, 0) END AS dir,
        EXISTS (SELECT 1 FROM nm WHERE nm.g = c.g AND main AND name = plain) AS exact, EXISTS (SELECT 1 FROM nm WHERE nm.g = c.g AND (NOT main AND name = plain OR main AND length(name) > 3 AND (contains(plain, name) OR plain <> '' AND contains(name, plain)))) AS part,
        lead = 0 AND c.g % 5 <> 0 OR lead = 1 AND c.g % 5 <> 1 OR lead = 2 AND c.g % 5 <> 2 OR lead = 3 AND c.g % 5 <> 4 AS wrong
        FROM c JOIN pg USING (page) LEFT JOIN sim ON sim.g = c.g AND sim.page = c.page WHERE NOT dis),
    f AS (SELECT *, exact OR dir > 0 AS titled, round(likeness + CASE WHEN dir > 0 THEN dir WHEN exact THEN CASE WHEN contains(title, '(') THEN 0.25 ELSE 0.30 END WHEN part THEN 0.12 ELSE 0 END - CASE WHEN hinted THEN 0.05 ELSE 0 END + 0.01 * greatest(0, 5 - rank), 6) AS "full" FROM r),
    x AS (SELECT *, round("full" - CASE WHEN wrong THEN 0.2 ELSE 0 END, 6) AS cut FROM f),
    o AS (SELECT *, first_value(page) OVER a AS wp, first_value(titled) OVER a AS wt, first_value(page) OVER b AS up, first_value(wrong) OVER b AS uw FROM x WINDOW a AS (PARTITION BY g ORDER BY cut DESC, rank, page), b AS (PARTITION BY g ORDER BY "full" DESC, rank, page)),
    s AS (SELECT *, uw AND up <> wp AND NOT wt AS back, uw AND up <> wp AND wt AS passed FROM o),
    z AS (SELECT g AS "group", page, title, rank, ambiguous, CAST(likeness AS DOUBLE) AS likeness, dir, titled, wrong, CAST(CASE WHEN back THEN "full" ELSE cut END AS DOUBLE) AS score, page = CASE WHEN back THEN up ELSE wp END AS best, passed FROM s)
"""
ORACLES = {
    "link_candidates": _SCORED + """SELECT "group", page, likeness, score, titled AS exact_title, wrong AS wrong_kind, best, best AND passed AS promoted FROM z""",
    "group_links": _SCORED
    + """SELECT "group", page, title, likeness, score, passed AS promoted, score >= 0.2 AND likeness >= CASE WHEN wrong OR ambiguous OR dir = 0.25 THEN 0.05 WHEN dir > 0 THEN 0 WHEN titled THEN CASE WHEN contains(title, '(') THEN 0.01 ELSE 0 END ELSE 0.05 END AS linked FROM z WHERE best""",
}
