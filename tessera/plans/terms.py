"""Which terms can be clues, weights of names, fuzzy search over names, firm relations and bounds of audits."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.text import normalize
from tessera.plans.corpus import STOP_WORDS, doc_frequency, stand_in_rate, table
from tessera.plans.relational import ORACLES as RELATIONAL
from tessera.plans.relational import edges_score

# How rare (ln of documents by 1 + those with the word) words must be, and shares.
COMMON, GENERIC, CAPITALISED, NAME, PHRASE, SINGLE = 4, 7, 7, 6, 8, 9
STAND_IN_SHARE, LABEL_WORDS = 0.2, 5
HUB, HUB_QUESTIONS, HUB_SHARE, FEW = 150, 3, 0.25, 6
# What a name weighs by where it comes from.
WEIGHTS = {"title": 2.0, "main": 1.0, "required": 0.5, "accept": 0.5, "accept_if": 0.25}


def tidy(term: Column) -> Column:
    """A term fit to be a label, else null: a letter, LABEL_WORDS words at most, no lower-case phrase that begins or ends on a small word."""
    bare = F.regexp_replace(F.regexp_replace(term, "^[ \"“”'‘’,;:]+|[ \"“”'‘’,;:]+$", ""), "['’]s?$", "")
    bare = F.trim(bare)
    ws = F.split(F.lower(bare), " +")
    dangling = F.rlike(bare, F.lit(r"^\p{Ll}")) & (((F.size(ws) > 1) & F.get(ws, F.lit(0)).isin(*STOP_WORDS)) | F.element_at(ws, -1).isin(*STOP_WORDS))
    return F.when(F.rlike(bare, F.lit(r"\p{L}")) & (F.size(ws) <= LABEL_WORDS) & ~dangling & ((F.size(ws) > 1) | (F.length(bare) > 2)), bare)


def clue_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capitalised runs and phrases after "the" that are tidy: documents, rarest word, whether plain, usable as a clue and specific enough.

    Terms are counted per document before the shuffle by term; only distinct (term, word) rows meet the counts of words.
    """
    docs = table(spark, sf_dir, "documents").select("text")
    found = F.concat(F.regexp_extract_all("text", F.lit("([A-Z][a-z]++(?: [A-Z][a-z]++)*+)"), F.lit(1)), F.regexp_extract_all("text", F.lit(r"\bthe ([a-z]+(?: [a-z]+)?)"), F.lit(1)))
    terms = docs.select(F.explode(F.array_distinct(F.transform(found, tidy))).alias("term")).where("term is not null").groupBy("term").agg(F.count("*").alias("n_docs"))
    ws = F.filter(F.regexp_extract_all(F.lower("term"), F.lit("[a-z]+"), F.lit(0)), lambda w: ~w.isin(*STOP_WORDS))
    pairs = terms.select("term", F.explode(F.array_distinct(ws)).alias("word"))
    idf = F.log(F.greatest(F.col("n"), F.lit(1)) / (1 + F.coalesce("df", F.lit(0))))
    rare = pairs.join(doc_frequency(spark, sf_dir).select("word", "df"), "word", "left").join(stand_in_rate(spark, sf_dir).select("word", "rate"), "word", "left").join(F.broadcast(docs.agg(F.count("*").alias("n"))), F.lit(True))  # one row
    best = rare.groupBy("term").agg(F.max(F.round(idf, 6)).alias("idf"), F.max(F.coalesce("rate", F.lit(0.0))).alias("stand_in"), F.count("*").alias("n_words"))
    one, lower = ~F.col("term").contains(" "), F.rlike("term", F.lit("^[a-z]"))
    loud = F.upper("term") == F.col("term")
    plain = one & ~loud & ((F.col("idf") < COMMON) | (F.col("stand_in") >= STAND_IN_SHARE) | (lower & (F.col("idf") < GENERIC)))
    usable = ~plain & F.when(one & ~lower & ~loud, F.col("idf") >= CAPITALISED).when(~lower & (F.col("n_words") > 1), F.col("idf") >= NAME).otherwise(True)
    specific = ~lower | ((F.col("n_docs") >= 2) & (F.col("idf") >= F.when(F.col("n_words") > 1, PHRASE).otherwise(SINGLE)))
    return terms.join(best, "term").select("term", "n_docs", "idf", plain.alias("plain"), usable.alias("usable"), specific.alias("specific"))


def alias_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight of each name of a brand, summed over where it comes from, and its best spelling. Sums are made before the shuffle.

    Parts without a name or type give none.
    """
    name = lambda source, place, text: F.struct(F.lit(WEIGHTS[source]).alias("weight"), F.lit(place).alias("place"), text.alias("text"))
    long = F.concat_ws(" ", "p_name", "p_type")
    given = F.concat(
        F.array(name("title", 0, F.col("p_type")), name("main", 1, F.col("p_name")), F.when(F.col("p_size") >= 25, name("accept", 3, long)).otherwise(name("accept_if", 3, long))),
        F.transform(F.split("p_name", " "), lambda w: name("required", 2, w)),
    )
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("brand"), F.explode(given).alias("g")).select("brand", "g.*", normalize(F.col("g.text")).alias("key"))
    return rows.where("key <> ''").groupBy("brand", "key").agg(F.sum("weight").alias("weight"), F.min(F.struct("place", "text"))["text"].alias("surface"))


def name_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best brands for each needle: part names without their third letter, and their first two letters.

    Needles of three letters on meet names by shared trigrams, shorter ones names that begin with them. Likeness is 1 less the
    edits by the longer length, more for equal names, prefixes and beginnings of words; a brand counts with its best name.
    Every name that shares a trigram is scored, so no cut of candidates is needed.
    """
    grams = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - 2), lambda i: F.substr(F.col(c), i, F.lit(3))))
    parts = table(spark, sf_dir, "part").where("p_name is not null").groupBy("p_brand", F.lower("p_name").alias("name")).agg(F.count("*").alias("n"))
    names = parts.select("name").distinct()
    needles = names.select(F.explode(F.array(F.concat(F.substr("name", F.lit(1), F.lit(2)), F.substr("name", F.lit(4))), F.substr("name", F.lit(1), F.lit(2)))).alias("needle")).distinct()
    long = needles.where("length(needle) >= 3").select("needle", F.explode(grams("needle")).alias("gram"))
    short = needles.where("length(needle) between 1 and 2")
    postings = names.where("length(name) >= 3").select("name", F.explode(grams("name")).alias("gram"))
    starts = names.select("name", F.explode(F.array_distinct(F.array(F.substr("name", F.lit(1), F.lit(1)), F.substr("name", F.lit(1), F.lit(2))))).alias("needle"))
    met = long.join(postings, "gram").select("needle", "name").unionByName(short.join(starts, "needle").select("needle", "name"))
    like = 1 - F.levenshtein("needle", "name") / F.greatest(F.length("needle"), F.length("name"))
    bonus = F.when(F.col("name") == F.col("needle"), 0.3).when(F.col("name").startswith(F.col("needle")), 0.2).when(F.concat(F.lit(" "), "name").contains(F.concat(F.lit(" "), "needle")), 0.05).otherwise(0.0)
    scored = met.distinct().withColumn("like", F.round(like + bonus, 6))
    brands = parts.groupBy("p_brand").agg(F.sum("n").alias("n"))
    top = brands.agg(F.max("n").alias("most"))  # one row
    best = scored.join(parts.select("p_brand", "name"), "name").groupBy("needle", "p_brand").agg(F.max("like").alias("like"))
    known = best.join(brands, "p_brand").join(F.broadcast(top), F.lit(True)).withColumn("score", F.round(0.8 * F.col("like") + 0.2 * F.log1p("n") / F.log1p("most"), 4))
    rank = F.row_number().over(Window.partitionBy("needle").orderBy(F.desc("score"), "p_brand"))
    return known.withColumn("rank", rank).where("rank <= 10").select("needle", "p_brand", "rank", "score")


def firm_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 12 best related suppliers of each that pass the hub and the mutual rule.

    Two orders either way (one for suppliers of fewer than FEW orders). One that more than HUB suppliers name needs three orders
    and a quarter of the namer's. Links must go both ways, unless both suppliers are of one nation.
    """
    e = edges_score(spark, sf_dir)
    orders = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("a")).agg(F.countDistinct("l_orderkey").alias("orders"))
    named = e.where("fwd > 0").groupBy("b").agg(F.count("*").alias("namers"))
    nation = lambda c: table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias(c), F.col("s_nationkey").alias(f"nation_{c}"))
    rows = e.join(orders, "a").join(named, "b", "left").join(nation("a"), "a", "left").join(nation("b"), "b", "left")
    enough = F.col("fwd") + F.col("rev") >= F.when(F.col("orders") < FEW, 1).otherwise(2)
    hub = (F.coalesce("namers", F.lit(0)) <= HUB) | ((F.col("fwd") >= HUB_QUESTIONS) & (F.col("fwd") >= HUB_SHARE * F.col("orders")))
    mutual = ((F.col("fwd") > 0) & (F.col("rev") > 0)) | F.coalesce(F.col("nation_a") == F.col("nation_b"), F.lit(False))
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("score"), "b"))
    return rows.where(enough & hub & mutual).select("a", "b", "fwd", "rev", "score", rank.alias("rank")).where("rank <= 12")


def beta_share(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_share(1 - x, b, a)
    tiny, c, d, f = 1e-300, 1.0, 0.0, 1.0
    for i in range(100_000):
        m = i // 2
        num = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / ((1 + num * d) or tiny)
        c = (1 + num / c) or tiny
        f *= c * d
        if abs(1 - c * d) < 1e-14:
            break
    return math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) * (f - 1) / a


def lower_share(k: int, n: int, confidence: float = 0.95) -> float:
    """The least share that k hits of n leave possible, one-sided (Clopper and Pearson); 0 without hits."""
    low, high = 0.0, 1.0
    for _ in range(60 if k > 0 else 0):
        mid = (low + high) / 2
        low, high = (mid, high) if beta_share(mid, k, n - k + 1) < 1 - confidence else (low, mid)
    return low


def audit_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Good documents of the labelled ones by language, and the least share of good ones that this leaves possible; one call a group."""

    @F.pandas_udf("double")
    def bound(k: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([lower_share(int(a), int(b)) for a, b in zip(k, n, strict=True)], dtype=float)

    rows = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels").where("quality is not null").select("doc_id", "quality"), "doc_id")
    by = rows.groupBy("lang").agg(F.count_if(F.col("quality") >= 1).alias("good"), F.count("*").alias("n"))
    return by.select("lang", "good", "n", F.round(bound("good", "n"), 6).alias("at_least"))


QUERIES = {f.__name__: f for f in (clue_terms, alias_weights, name_search, firm_relations, audit_bounds)}

ORACLES = {
    "clue_terms": f"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS w FROM documents), n AS (SELECT count(*) AS n FROM documents),
f AS (SELECT x AS word, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest(w) AS x FROM w) GROUP BY 1),
r AS (SELECT x AS word, round(count(*) FILTER (p IN ('this', 'these', 'that', 'those')) / count(*), 6) AS rate FROM (SELECT unnest(w) AS x, unnest(list_prepend('', w[:-2])) AS p FROM w WHERE len(w) > 0) WHERE x IS NOT NULL GROUP BY 1),
t AS (SELECT doc_id, unnest(list_distinct(list_concat(regexp_extract_all(text, '([A-Z][a-z]+(?: [A-Z][a-z]+)*)', 1), regexp_extract_all(text, '\\bthe ([a-z]+(?: [a-z]+)?)', 1)))) AS term FROM documents),
k AS (SELECT term, count(*) AS n_docs FROM (SELECT *, string_split(lower(term), ' ') AS l FROM t) WHERE NOT (regexp_matches(term, '^[a-z]') AND (len(l) > 1 AND l[1] IN {STOP_WORDS} OR l[-1] IN {STOP_WORDS})) AND len(l) <= {LABEL_WORDS} AND (len(l) > 1 OR length(term) > 2) GROUP BY term),
p AS (SELECT term, unnest(list_distinct([x FOR x IN regexp_extract_all(lower(term), '[a-z]+') IF x NOT IN {STOP_WORDS}])) AS word FROM k),
b AS (SELECT term, max(round(ln(greatest(n, 1) / (1 + coalesce(df, 0))), 6)) AS idf, max(coalesce(rate, 0)) AS stand_in, count(*) AS n_words FROM p LEFT JOIN f USING (word) LEFT JOIN r USING (word), n GROUP BY term),
c AS (SELECT *, NOT contains(term, ' ') AS one, regexp_matches(term, '^[a-z]') AS low, NOT contains(term, ' ') AND upper(term) <> term AND (idf < {COMMON} OR stand_in >= {STAND_IN_SHARE} OR regexp_matches(term, '^[a-z]') AND idf < {GENERIC}) AS plain FROM k JOIN b USING (term))
SELECT term, n_docs, idf, plain, NOT plain AND CASE WHEN one AND NOT low AND upper(term) <> term THEN idf >= {CAPITALISED} WHEN NOT low AND n_words > 1 THEN idf >= {NAME} ELSE true END AS usable, NOT low OR n_docs >= 2 AND idf >= CASE WHEN n_words > 1 THEN {PHRASE} ELSE {SINGLE} END AS specific FROM c""",
    "alias_weights": """WITH g AS (SELECT p_brand AS brand, 2.0 AS weight, 0 AS place, p_type AS text FROM part UNION ALL SELECT p_brand, 1.0, 1, p_name FROM part UNION ALL SELECT p_brand, 0.5, 2, unnest(string_split(p_name, ' ')) FROM part
UNION ALL SELECT p_brand, CASE WHEN p_size >= 25 THEN 0.5 ELSE 0.25 END, 3, p_name || ' ' || p_type FROM part),
k AS (SELECT *, regexp_replace(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), '^(the|an|a) (.)', '\\2') AS key FROM g)
SELECT brand, key, CAST(sum(weight) AS DOUBLE) AS weight, arg_min(text, (place, text)) AS surface FROM k WHERE key <> '' GROUP BY brand, key""",
    "name_search": """WITH p AS (SELECT p_brand, lower(p_name) AS name, count(*) AS n FROM part WHERE p_name IS NOT NULL GROUP BY ALL), d AS (SELECT DISTINCT name FROM p),
q AS (SELECT DISTINCT unnest([substr(name, 1, 2) || substr(name, 4), substr(name, 1, 2)]) AS needle FROM d),
m AS (SELECT needle, name FROM q, d WHERE length(needle) >= 3 AND len(list_intersect([needle[i : i + 2] FOR i IN range(1, length(needle) - 1)], [name[i : i + 2] FOR i IN range(1, length(name) - 1)])) > 0 OR length(needle) BETWEEN 1 AND 2 AND starts_with(name, needle)),
s AS (SELECT needle, name, round(1 - levenshtein(needle, name) / greatest(length(needle), length(name)) + CASE WHEN name = needle THEN 0.3 WHEN starts_with(name, needle) THEN 0.2 WHEN contains(' ' || name, ' ' || needle) THEN 0.05 ELSE 0 END, 6) AS likeness FROM m),
b AS (SELECT p_brand, CAST(sum(n) AS BIGINT) AS n FROM p GROUP BY 1), k AS (SELECT needle, p_brand, max(likeness) AS likeness FROM s JOIN p USING (name) GROUP BY ALL),
r AS (SELECT needle, p_brand, round(0.8 * likeness + 0.2 * ln(1 + n) / ln(1 + (SELECT max(n) FROM b)), 4) AS score FROM k JOIN b USING (p_brand))
SELECT needle, p_brand, CAST(rank AS INTEGER) AS rank, score FROM (SELECT *, row_number() OVER (PARTITION BY needle ORDER BY score DESC, p_brand) AS rank FROM r) WHERE rank <= 10""",
    "firm_relations": f"""WITH e AS ({RELATIONAL["edges_score"]}), o AS (SELECT l_suppkey AS a, count(DISTINCT l_orderkey) AS orders FROM lineitem GROUP BY 1), h AS (SELECT b, count(*) AS namers FROM e WHERE fwd > 0 GROUP BY 1),
j AS (SELECT a, b, fwd, rev, score FROM e JOIN o USING (a) LEFT JOIN h USING (b) LEFT JOIN supplier x ON x.s_suppkey = a LEFT JOIN supplier y ON y.s_suppkey = b WHERE fwd + rev >= CASE WHEN orders < {FEW} THEN 1 ELSE 2 END
  AND (coalesce(namers, 0) <= {HUB} OR fwd >= {HUB_QUESTIONS} AND fwd >= {HUB_SHARE} * orders) AND (fwd > 0 AND rev > 0 OR coalesce(x.s_nationkey = y.s_nationkey, false)))
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS INTEGER) AS rank FROM j) WHERE rank <= 12""",
}
