"""Vectors, search, dictionary matching, graphs and pair measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.text import base_name, is_lookalike, normalize, slugify
from tessera.operators.dictionary import find_phrases, longest_first
from tessera.operators.graph import components
from tessera.plans.corpus import table, words

#: Words of the items, each per item, that are broadcast at most; more are joined by a shuffle.
BROADCAST_WORDS = 50_000


def centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean vector of each label, scaled to length one; sums are pre-aggregated per label and place."""
    parts = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("pos", "x"))
    mean = parts.groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    norm = mean.groupBy("label").agg(F.greatest(F.sqrt(F.sum(F.col("m") * F.col("m"))), F.lit(1e-9)).alias("norm"))
    return mean.join(norm, "label").select("label", "pos", F.round(F.col("m") / F.col("norm"), 6).alias("x"))


def medoid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vector of each label with the largest sum of similarities to all of the label.

    That sum is the product with the label's sum vector, so no pairs are made.
    """
    v = table(spark, sf_dir, "embeddings")
    parts = v.select("vec_id", "label", F.posexplode("embedding").alias("pos", "x"))
    sums = parts.groupBy("label", "pos").agg(F.sum(F.col("x").cast("double")).alias("s"))
    scored = parts.join(sums, ["label", "pos"]).groupBy("label", "vec_id").agg(F.round(F.sum(F.col("x").cast("double") * F.col("s")), 4).alias("support"))
    return scored.groupBy("label").agg(F.max_by("vec_id", F.struct("support", -F.col("vec_id"))).alias("vec_id"), F.max("support").alias("support"))


def bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for each benchmark item (a top-10 report) by BM25 over all of its words; words are counted within documents before they meet the items."""
    docs = table(spark, sf_dir, "documents").select("doc_id", words(F.col("text")).alias("w"))
    total = docs.agg(F.count("*").alias("n"), F.avg(F.size("w")).alias("mean"))
    queries = table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.array_distinct(words(F.col("text")))).alias("word"))
    wanted = queries.select("word").distinct()
    sent = F.broadcast if queries.count() <= BROADCAST_WORDS else lambda side: side
    # by document from here on: counts, weights and scores need no further shuffle where the items' words are broadcast
    found = docs.select("doc_id", F.size("w").alias("len"), F.explode("w").alias("word")).join(sent(wanted), "word", "left_semi").repartition("doc_id")
    tf = found.groupBy("doc_id", "len", "word").agg(F.count("*").alias("tf"))
    df = tf.groupBy("word").agg(F.count("*").alias("df")).join(F.broadcast(total), F.lit(True))  # total is one row
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * 2.2 / (F.col("tf") + 1.2 * (0.25 + 0.75 * F.col("len") / F.col("mean")))
    scored = tf.join(sent(queries.join(df, "word")), "word").groupBy("item_id", "doc_id").agg(F.round(F.sum(weight), 6).alias("score"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id"))).where("rank <= 10")


def trigram_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts per trigram of their normalised name."""
    names = table(spark, sf_dir, "part").select("p_partkey", normalize(F.col("p_name")).alias("s")).where("length(s) >= 3")
    grams = names.select("p_partkey", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("s") - 2), lambda i: F.substr("s", i, F.lit(3))))).alias("gram"))
    return grams.groupBy("gram").agg(F.count("*").alias("n_parts"), F.min("p_partkey").alias("first_part"))


def tfidf_top_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five words of the highest weight in each document; the length of its vector goes into the weight."""
    docs = table(spark, sf_dir, "documents")
    n = docs.agg(F.count("*").alias("n"))
    tf = docs.select("doc_id", F.explode(words(F.col("text"))).alias("word")).groupBy("doc_id", "word").agg(F.count("*").alias("tf"))
    df = tf.groupBy("word").agg(F.count("*").alias("df"))
    weight = (1 + F.log("tf")) * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1)
    w = tf.join(df, "word").join(F.broadcast(n), F.lit(True)).select("doc_id", "word", weight.alias("w"))  # n is one row
    per_doc = Window.partitionBy("doc_id")
    scaled = w.select("doc_id", "word", F.round(F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(per_doc)), 5).alias("weight"))
    return scaled.withColumn("rank", F.row_number().over(per_doc.orderBy(F.desc("weight"), "word"))).where("rank <= 5")


def alias_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places in documents of each benchmark item's first three words."""
    phrases = table(spark, sf_dir, "benchmark").select(F.array_join(F.slice(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0)), 1, 3), " ").alias("phrase"), F.col("item_id").alias("owner"))
    found = find_phrases(table(spark, sf_dir, "documents"), phrases)
    return found.groupBy("owner").agg(F.count("*").alias("n_places"), F.countDistinct("doc_id").alias("n_docs"))


def alias_longest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions of items' first two to five words, longest first, without overlap."""
    t = F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))
    phrases = table(spark, sf_dir, "benchmark").select(F.explode(F.transform(F.sequence(F.lit(2), F.lit(5)), lambda n: F.array_join(F.slice(t, 1, n), " "))).alias("phrase"), F.col("item_id").alias("owner")).distinct()
    taken = longest_first(find_phrases(table(spark, sf_dir, "documents"), phrases))
    return taken.groupBy("owner", "n_tokens").agg(F.count("*").alias("n_mentions"), F.countDistinct("doc_id").alias("n_docs"))


def supplier_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of suppliers that share an order of the same part."""
    items = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", F.year("l_shipdate").alias("y"), F.month("l_shipdate").alias("m"))
    least = items.groupBy("l_partkey", "y", "m").agg(F.min("l_suppkey").alias("b"))
    edges = items.join(least, ["l_partkey", "y", "m"]).select(F.col("l_suppkey").alias("a"), "b").distinct()
    roots = components(edges)
    nodes = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"))
    return nodes.join(roots, "id", "left").select("id", F.coalesce("root", "id").alias("root"))


def pair_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well grouping documents by language finds pairs of equal quality: from cell counts, without pairs."""
    joined = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    cells = joined.groupBy("lang", "quality").agg(F.count("*").alias("n"))
    pairs = lambda c: F.col(c) * (F.col(c) - 1) / 2
    both = cells.agg(F.sum(pairs("n")).alias("both"))
    said = cells.groupBy("lang").agg(F.sum("n").alias("n")).agg(F.sum(pairs("n")).alias("said"))
    true = cells.groupBy("quality").agg(F.sum("n").alias("n")).agg(F.sum(pairs("n")).alias("true"))
    return both.join(said, F.lit(True)).join(true, F.lit(True)).select("both", "said", "true", F.round(2 * F.col("both") / (F.col("said") + F.col("true")), 6).alias("f1"))  # one row each


def normalized_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised title, slug and base name of each page."""
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    return table(spark, sf_dir, "pages").select("page_id", normalize(title).alias("norm"), slugify(title).alias("slug"), base_name(title).alias("base"))


def snapshot_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One nested record per nation: customers by segment and best customers, as JSON text."""
    c = table(spark, sf_dir, "customer")
    segments = c.groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n")).groupBy("c_nationkey").agg(F.array_sort(F.collect_list(F.struct(F.col("c_mktsegment").alias("segment"), "n"))).alias("segments"))  # a few segments
    rank = F.row_number().over(Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey"))
    best = c.withColumn("rank", rank).where("rank <= 10").groupBy("c_nationkey").agg(F.array_sort(F.collect_list(F.struct("rank", "c_custkey", "c_acctbal"))).alias("best"))
    joined = table(spark, sf_dir, "nation").join(segments, F.col("n_nationkey") == F.col("c_nationkey"), "left").drop("c_nationkey").join(best, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    return joined.select("n_nationkey", F.to_json(F.struct(F.lit(2).alias("schema_version"), F.col("n_name").alias("name"), "segments", "best")).alias("record"))


def lookalike_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of title words that look alike: one edit apart, two where one has 8 letters or more, and neither within the other.

    Words that many edits apart share a form with at most as many letters left out of either, so they meet on those keys. Of two
    words two edits apart only one of 8 letters or more leaves out two: a shorter one is met by more letters left out of the other.
    """
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    word = table(spark, sf_dir, "pages").select(F.explode(words(title)).alias("w")).where("length(w) >= 4").distinct()
    without = lambda w, i: F.concat(F.substr(w, F.lit(1), i - 1), F.substr(w, i + 1))
    shorter = F.transform(F.sequence(F.lit(1), F.length("w")), lambda i: without(F.col("w"), i))
    one = word.select("w", F.explode(F.array_distinct(F.concat(F.array("w"), shorter))).alias("key"))
    # the second letter left out stands behind the first
    pairs = F.transform(F.sequence(F.lit(1), F.length("w") - 1), lambda i: F.transform(F.sequence(i, F.length("w") - 1), lambda k: without(without(F.col("w"), i), k)))
    two = word.where("length(w) >= 8").select("w", F.explode(pairs).alias("some")).select("w", F.explode("some").alias("key"))
    keyed = one.unionByName(two).distinct()
    met = keyed.select(F.col("w").alias("a"), "key").join(keyed.select(F.col("w").alias("b"), "key"), "key").where("a < b").select("a", "b").distinct()
    return met.where(is_lookalike(F.col("a"), F.col("b")))


def exact_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The brand that a part name stands for: the most frequent, unless the next has more than half as many.

    The window runs over one name's brands, 25 at most.
    """
    counted = table(spark, sf_dir, "part").groupBy(normalize(F.col("p_name")).alias("name"), "p_brand").agg(F.count("*").alias("n"))
    by_name = Window.partitionBy("name").orderBy(F.desc("n"), "p_brand")
    top = counted.withColumns({"place": F.row_number().over(by_name), "next_n": F.lead("n").over(by_name)}).where("place = 1")
    return top.select("name", "n", F.when(F.coalesce("next_n", F.lit(0)) * 2 > F.col("n"), None).otherwise(F.col("p_brand")).alias("brand"))


def upsert_keep_better(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event kept per user and type when a later one replaces an earlier only if its value is higher."""
    e = table(spark, sf_dir, "events")
    kept = e.groupBy("user_id", "event_type").agg(F.min_by(F.struct("event_id", "value"), F.struct(-F.col("value"), "ts", "event_id")).alias("k"), F.count("*").alias("n_seen"))
    return kept.select("user_id", "event_type", "k.*", "n_seen")


QUERIES = {f.__name__: f for f in (lookalike_words, exact_lookup, upsert_keep_better, centroid, medoid, bm25_search, trigram_index, tfidf_top_terms, alias_mentions, alias_longest, supplier_components, pair_f1, normalized_titles, snapshot_json)}

W = "regexp_extract_all(lower(text), '[a-z]+')"
T = "regexp_extract_all(lower(text), '[a-z0-9]+')"
NORM = "regexp_replace(trim(regexp_replace(replace(replace(replace(strip_accents(lower({0})), 'ß', 'ss'), 'æ', 'ae'), '&', ' and '), '[^a-z0-9]+', ' ', 'g')), '^(the|an|a) (.)', '\\2')"
TITLE = "regexp_extract(html, '<title>([^<]*)</title>', 1)"
ORACLES = {
    "alias_longest": r"""WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM documents),
        q AS (SELECT phrase, owner, len(string_split(phrase, ' ')) AS n FROM (SELECT DISTINCT array_to_string(w[1 : k], ' ') AS phrase, item_id AS owner FROM (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM benchmark), range(2, 6) r(k)) WHERE phrase <> ''),
        g AS (SELECT doc_id, i - 1 AS start, n, array_to_string(t[i : i + n - 1], ' ') AS phrase FROM (SELECT doc_id, t, unnest(range(1, len(t) + 1)) AS i FROM t), (SELECT DISTINCT n FROM q) WHERE i + n - 1 <= len(t)),
        b AS (SELECT doc_id, start, n, min(owner) AS owner FROM g JOIN q USING (phrase, n) GROUP BY doc_id, start, n QUALIFY row_number() OVER (PARTITION BY doc_id, start ORDER BY n DESC) = 1),
        r AS (SELECT doc_id, list_reduce(list_prepend({'free': 0, 'took': []}, list({'free': start, 'took': [[start, n, owner]]} ORDER BY start)), lambda a, x: CASE WHEN x.free >= a.free THEN {'free': x.free + x.took[1][2], 'took': list_concat(a.took, x.took)} ELSE a END).took AS took FROM b GROUP BY doc_id),
        u AS (SELECT doc_id, unnest(took) AS m FROM r)
        SELECT m[3] AS owner, CAST(m[2] AS INTEGER) AS n_tokens, count(*) AS n_mentions, count(DISTINCT doc_id) AS n_docs FROM u GROUP BY ALL""",
    "snapshot_json": """WITH s AS (SELECT c_nationkey, list({'segment': c_mktsegment, 'n': n} ORDER BY c_mktsegment) AS segments FROM (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL) GROUP BY 1),
        r AS (SELECT c_nationkey, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS INTEGER) AS rank, c_custkey, c_acctbal FROM customer),
        b AS (SELECT c_nationkey, list({'rank': rank, 'c_custkey': c_custkey, 'c_acctbal': c_acctbal} ORDER BY rank) AS best FROM r WHERE rank <= 10 GROUP BY 1)
        SELECT n_nationkey, CASE WHEN segments IS NULL THEN to_json({'schema_version': 2, 'name': n_name}) ELSE to_json({'schema_version': 2, 'name': n_name, 'segments': segments, 'best': best}) END::VARCHAR AS record
        FROM nation LEFT JOIN s ON s.c_nationkey = n_nationkey LEFT JOIN b ON b.c_nationkey = n_nationkey""",
    "lookalike_words": f"""WITH w AS (SELECT DISTINCT w FROM (SELECT unnest(regexp_extract_all(lower({TITLE}), '[a-z]+')) AS w FROM pages) WHERE length(w) >= 4)
        SELECT x.w AS a, y.w AS b FROM w x JOIN w y ON x.w < y.w AND abs(length(x.w) - length(y.w)) <= 2 AND levenshtein(x.w, y.w) <= CASE WHEN greatest(length(x.w), length(y.w)) < 8 THEN 1 ELSE 2 END WHERE NOT contains(x.w, y.w) AND NOT contains(y.w, x.w)""",
    "exact_lookup": f"""WITH c AS (SELECT {NORM.format("p_name")} AS name, p_brand, count(*) AS n FROM part GROUP BY 1, 2),
        r AS (SELECT *, row_number() OVER w AS place, lead(n) OVER w AS next_n FROM c WINDOW w AS (PARTITION BY name ORDER BY n DESC, p_brand))
        SELECT name, n, CASE WHEN coalesce(next_n, 0) * 2 > n THEN NULL ELSE p_brand END AS brand FROM r WHERE place = 1""",
    "upsert_keep_better": """SELECT user_id, event_type, event_id, value, count(*) OVER (PARTITION BY user_id, event_type) AS n_seen FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, ts, event_id) = 1""",
    "centroid": """WITH p AS (SELECT label, unnest(embedding) AS x, unnest(range(len(embedding))) AS pos FROM embeddings), m AS (SELECT label, pos, avg(CAST(x AS DOUBLE)) AS m FROM p GROUP BY label, pos)
        SELECT label, CAST(pos AS INTEGER) AS pos, round(m / greatest(sqrt(sum(m * m) OVER (PARTITION BY label)), 1e-9), 6) AS x FROM m""",
    "medoid": """WITH s AS (SELECT a.label, a.vec_id, round(sum(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))), 4) AS support FROM embeddings a JOIN embeddings b ON a.label = b.label GROUP BY 1, 2)
        SELECT label, vec_id, support FROM s QUALIFY row_number() OVER (PARTITION BY label ORDER BY support DESC, vec_id) = 1""",
    "bm25_search": f"""WITH d AS (SELECT doc_id, {W} AS w FROM documents), total AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM d),
        q AS (SELECT item_id, unnest(list_distinct({W})) AS word FROM benchmark), x AS (SELECT doc_id, len(w) AS len, unnest(w) AS word FROM d),
        tf AS (SELECT doc_id, len, word, count(*) AS tf FROM x GROUP BY ALL), df AS (SELECT word, count(*) AS df FROM tf GROUP BY word),
        s AS (SELECT item_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 6) AS score FROM q JOIN tf USING (word) JOIN df USING (word), total GROUP BY 1, 2)
        SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10""",
    "trigram_index": f"""WITH s AS (SELECT p_partkey, {NORM.format("p_name")} AS s FROM part), g AS (SELECT DISTINCT p_partkey, substring(s, i, 3) AS gram FROM (SELECT p_partkey, s, unnest(range(1, length(s) - 1)) AS i FROM s WHERE length(s) >= 3))
        SELECT gram, count(*) AS n_parts, min(p_partkey) AS first_part FROM g GROUP BY gram""",
    "tfidf_top_terms": f"""WITH tf AS (SELECT doc_id, word, count(*) AS tf FROM (SELECT doc_id, unnest({W}) AS word FROM documents) GROUP BY ALL), df AS (SELECT word, count(*) AS df FROM tf GROUP BY word),
        w AS (SELECT doc_id, word, (1 + ln(tf)) * (ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1) AS w FROM tf JOIN df USING (word)),
        s AS (SELECT doc_id, word, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 5) AS weight FROM w)
        SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, word) AS INTEGER) AS rank FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, word) <= 5""",
    "alias_mentions": f"""WITH i AS (SELECT item_id AS owner, array_to_string({T}[1:3], ' ') AS phrase, len({T}[1:3]) AS n FROM benchmark), d AS (SELECT doc_id, {T} AS t FROM documents),
        g AS (SELECT doc_id, array_to_string(t[s : s + n - 1], ' ') AS phrase FROM (SELECT doc_id, t, n, unnest(range(1, len(t) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM i WHERE n > 0)))
        SELECT owner, count(*) AS n_places, count(DISTINCT doc_id) AS n_docs FROM g JOIN i USING (phrase) GROUP BY owner""",
    "supplier_components": """WITH RECURSIVE e AS (SELECT DISTINCT a.l_suppkey AS a, b.l_suppkey AS b FROM lineitem a JOIN lineitem b ON a.l_partkey = b.l_partkey AND year(a.l_shipdate) = year(b.l_shipdate) AND month(a.l_shipdate) = month(b.l_shipdate)),
        r AS (SELECT s_suppkey AS id, s_suppkey AS o FROM supplier UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.o) SELECT id, min(o) AS root FROM r GROUP BY id""",
    "pair_f1": """WITH j AS (SELECT lang, quality FROM documents JOIN labels USING (doc_id)), b AS (SELECT sum(n * (n - 1) / 2) AS both_ FROM (SELECT count(*) AS n FROM j GROUP BY lang, quality)),
        s AS (SELECT sum(n * (n - 1) / 2) AS said FROM (SELECT count(*) AS n FROM j GROUP BY lang)), t AS (SELECT sum(n * (n - 1) / 2) AS true_ FROM (SELECT count(*) AS n FROM j GROUP BY quality))
        SELECT both_ AS "both", said, true_ AS "true", round(2 * both_ / (said + true_), 6) AS f1 FROM b, s, t""",
    "normalized_titles": f"""SELECT page_id, {NORM.format(TITLE)} AS norm, replace({NORM.format(TITLE)}, ' ', '-') AS slug, {NORM.format(f"regexp_replace({TITLE}, '[ ]*[(][^)]*[)]', '', 'g')")} AS base FROM pages""",
}
