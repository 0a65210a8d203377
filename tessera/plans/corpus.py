"""Deduplication, word statistics, sentences and examples over documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators.places import medians
from tessera.sources.tables import stored

STOP_WORDS = ("the", "a", "an", "of", "and", "to", "in", "is", "de", "la", "le", "der", "die", "und", "el", "y")
STAND_INS = ("this", "these", "that", "those")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Lower-case ASCII-letter words, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0))


def dedup_topic_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keep the longest, then lowest-numbered, document per text; statistics per (lang, source); rank within lang.

    Only a hash of the text is shuffled, and equal texts meet map-side first. Lengths are counted, and medians are places in running sums.
    """
    docs = table(spark, sf_dir, "documents")
    kept = docs.groupBy(F.md5("text").alias("h")).agg(F.min_by(F.struct("doc_id", "lang", "source", "n_chars"), F.struct(-F.col("n_chars"), "doc_id")).alias("k")).select("k.*")
    counts = stored(kept.groupBy(F.struct("lang", "source").alias("of"), "n_chars").agg(F.count("*").alias("k")))
    mid = medians(counts, "of", "n_chars", "k").withColumnRenamed("of", "at")
    stats = counts.groupBy("of").agg(F.sum("k").alias("n_docs"), F.min("n_chars").alias("min_chars"), F.max("n_chars").alias("max_chars")).join(mid, F.col("of").eqNullSafe(F.col("at")), "left")
    stats = stats.select("of.lang", "of.source", "n_docs", "min_chars", "max_chars", F.col("median").alias("median_chars"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n_docs"), "source"))
    return stats.withColumn("rank_in_lang", rank)


def dedup_losers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document dropped as a repetition, with the one kept for its text. Minima are pre-aggregated; one join."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("h"))
    keepers = docs.groupBy("h").agg(F.min("doc_id").alias("keeper_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    return docs.join(keepers, "h").where("doc_id <> keeper_id").select("doc_id", "keeper_id")


def doc_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and uses of each word. A document gives each use, and its distinct words once more; they are summed
    before the only shuffle, by word."""
    found = table(spark, sf_dir, "documents").select(words(F.col("text")).alias("w"))
    one = lambda df: lambda x: F.struct(x.alias("word"), F.lit(df).cast("long").alias("df"), F.lit(1 - df).cast("long").alias("uses"))
    given = found.select(F.explode(F.concat(F.transform("w", one(0)), F.transform(F.array_distinct("w"), one(1)))).alias("g"))
    return given.groupBy("g.word").agg(F.sum("g.df").alias("df"), F.sum("g.uses").alias("uses"))


def stand_in_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of each word's uses that follow this, these, that or those; previous words come from the array, not a window."""
    ws = table(spark, sf_dir, "documents").select(words(F.col("text")).alias("w"))
    pairs = ws.select(F.explode(F.arrays_zip("w", F.concat(F.array(F.lit("")), F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0)))).alias("p"))).alias("x")).select("x.w", "x.p")
    return pairs.where("w is not null").groupBy(F.col("w").alias("word")).agg(F.count("*").alias("uses"), F.count_if(F.col("p").isin(*STAND_INS)).alias("after_stand_in")).withColumn("rate", F.round(F.col("after_stand_in") / F.col("uses"), 6))


def capitalised_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of capitalised uses of each word, the first of a document left out."""
    ws = table(spark, sf_dir, "documents").select(F.posexplode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("pos", "w")).where("pos > 0")
    return ws.groupBy(F.lower("w").alias("word")).agg(F.count("*").alias("uses"), F.round(F.avg(F.col("w").rlike("^[A-Z]").cast("int")), 6).alias("share"))


def idf_specificity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and largest inverse document frequency of each benchmark item's distinct words."""
    docs = table(spark, sf_dir, "documents")
    n = docs.agg(F.count("*").alias("n"))
    items = table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.array_distinct(words(F.col("text")))).alias("word"))
    df = docs.select(F.explode(F.array_distinct(words(F.col("text")))).alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    idf = F.log(F.greatest(F.col("n"), F.lit(1)) / (1 + F.coalesce("df", F.lit(0))))
    joined = items.join(df, "word", "left").join(F.broadcast(n), F.lit(True)).withColumn("idf", idf)  # n is one row
    return joined.groupBy("item_id").agg(F.round(F.avg("idf"), 6).alias("mean_idf"), F.round(F.max("idf"), 6).alias("max_idf"))


def examples_one_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longest document of each (lang, source), then the four best sources of a language."""
    docs = table(spark, sf_dir, "documents")
    best = docs.groupBy("lang", "source").agg(F.max_by(F.struct("doc_id", "n_chars"), F.struct("n_chars", -F.col("doc_id"))).alias("b")).select("lang", "source", "b.*")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n_chars"), "doc_id"))
    return best.withColumn("rank", rank).where("rank <= 4")


def distinct_wordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source, documents and distinct sets of words, so reworded orderings count once."""
    sets = table(spark, sf_dir, "documents").select("source", F.md5(F.array_join(F.array_sort(F.array_distinct(words(F.col("text")))), " ")).alias("h"))
    return sets.groupBy("source", "h").agg(F.count("*").alias("n")).groupBy("source").agg(F.sum("n").alias("n_docs"), F.count("*").alias("n_wordings"))


def sentence_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences (cut at full stops) with their place in ten bins of the text, counted per language."""
    parts = table(spark, sf_dir, "documents").select("lang", F.length("text").alias("n"), F.split("text", r"\.", -1).alias("s"))
    starts = F.transform(F.sequence(F.lit(1), F.size("s")), lambda k: F.element_at("s", k))
    rows = parts.where("n > 0").select("lang", F.size("s").alias("m"), F.posexplode(starts).alias("k", "text")).where(F.trim("text") != "")
    return rows.groupBy("lang", F.least(F.lit(9), F.floor(F.col("k") * 10 / F.col("m"))).cast("int").alias("bin")).agg(F.count("*").alias("n_sentences"), F.max(F.length("text")).cast("long").alias("longest"))


def word_cooccurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 8 most frequent following words of each word of 8 or more letters; counts by pair are pre-aggregated."""
    ws = table(spark, sf_dir, "documents").select(words(F.col("text")).alias("w"))
    zipped = F.arrays_zip(F.col("w").alias("a"), F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(0))).alias("b"))
    pairs = ws.select(F.explode(zipped).alias("x")).select("x.a", "x.b").where("b is not null and length(a) >= 8")
    counted = pairs.groupBy("a", "b").agg(F.count("*").alias("n"))
    return counted.withColumn("rank", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("n"), "b"))).where("rank <= 8")


def last_turn_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn and whether it is its conversation's last; the maximum is joined, so a long conversation is no window."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    last = turns.groupBy("conv_id").agg(F.max("turn").alias("last_turn"))
    return turns.join(last, "conv_id").select("conv_id", "turn", "role", (F.col("turn") == F.col("last_turn")).alias("is_last"))


def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title, host and plain length of each page: markup, scripts and styles removed, white space collapsed."""
    bare = F.regexp_replace(F.regexp_replace("html", r"(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->", " "), "<[^>]*>", " ")
    plain = F.trim(F.regexp_replace(bare, r"[ \t\r\n]+", " "))
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.length(plain).cast("long").alias("n_plain"))


def label_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall and F1 of "long documents are of good quality" per language."""
    joined = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    said, true = F.col("n_chars") >= 1000, F.col("quality") == 1
    counts = joined.groupBy("lang").agg(F.count_if(said & true).alias("tp"), F.count_if(said & ~true).alias("fp"), F.count_if(~said & true).alias("fn"))
    p, r = F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0)), F.col("tp") / F.nullif(F.col("tp") + F.col("fn"), F.lit(0))
    return counts.withColumns({"precision": F.round(p, 6), "recall": F.round(r, 6), "f1": F.round(2 * F.col("tp") / F.nullif(2 * F.col("tp") + F.col("fp") + F.col("fn"), F.lit(0)), 6)})


def data_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named checks with the number of offending rows, each an anti-join or a filter."""
    docs, labels, orders, customer, items = (table(spark, sf_dir, t) for t in ("documents", "labels", "orders", "customer", "lineitem"))
    found = [
        ("labels_without_document", labels.join(docs, "doc_id", "left_anti")),
        ("orders_without_customer", orders.join(customer, orders.o_custkey == customer.c_custkey, "left_anti")),
        ("items_without_order", items.join(orders, items.l_orderkey == orders.o_orderkey, "left_anti")),
        ("repeated_doc_ids", docs.groupBy("doc_id").count().where("count > 1")),
        ("wrong_n_chars", docs.where(F.length("text") != F.col("n_chars"))),
        ("negative_quantity", items.where("l_quantity < 0")),
    ]
    out = None
    for name, df in found:
        one = df.agg(F.count("*").alias("n_bad")).select(F.lit(name).alias("check_name"), "n_bad", (F.col("n_bad") == 0).alias("passed"))
        out = one if out is None else out.unionByName(one)
    return out


W = "regexp_extract_all(lower(text), '[a-z]+')"
QUERIES = {f.__name__: f for f in (dedup_topic_stats, dedup_losers, doc_frequency, stand_in_rate, capitalised_share, idf_specificity, examples_one_per_source, distinct_wordings, sentence_positions, word_cooccurrence, last_turn_flag, page_titles, label_precision, data_checks)}

ORACLES = {
    "dedup_topic_stats": """
        WITH kept AS (
          SELECT * FROM documents
          QUALIFY row_number() OVER (PARTITION BY md5(text) ORDER BY n_chars DESC, doc_id) = 1),
        stats AS (
          SELECT lang, source, count(*) AS n_docs, min(n_chars) AS min_chars, max(n_chars) AS max_chars, median(n_chars) AS median_chars
          FROM kept GROUP BY lang, source)
        SELECT *, CAST(row_number() OVER (PARTITION BY lang ORDER BY n_docs DESC, source) AS INTEGER) AS rank_in_lang FROM stats""",
    "dedup_losers": """
        SELECT doc_id, keeper_id FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS keeper_id FROM documents) WHERE doc_id <> keeper_id""",
    "doc_frequency": f"""
        SELECT word, count(DISTINCT doc_id) AS df, count(*) AS uses FROM (SELECT doc_id, unnest({W}) AS word FROM documents) GROUP BY word""",
    "stand_in_rate": f"""
        WITH w AS (SELECT doc_id, {W} AS ws FROM documents),
        p AS (SELECT unnest(ws) AS word, unnest(list_prepend('', ws[:-2])) AS prev FROM w WHERE len(ws) > 0)
        SELECT word, count(*) AS uses, count_if(prev IN {STAND_INS}) AS after_stand_in, round(count_if(prev IN {STAND_INS}) / count(*), 6) AS rate FROM p GROUP BY word""",
    "capitalised_share": """
        WITH w AS (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')[2:]) AS w FROM documents)
        SELECT lower(w) AS word, count(*) AS uses, round(avg(CASE WHEN regexp_matches(w, '^[A-Z]') THEN 1 ELSE 0 END), 6) AS share FROM w GROUP BY 1""",
    "idf_specificity": f"""
        WITH df AS (SELECT word, count(*) AS df FROM (SELECT doc_id, unnest(list_distinct({W})) AS word FROM documents) GROUP BY word),
        items AS (SELECT item_id, unnest(list_distinct({W})) AS word FROM benchmark),
        idf AS (SELECT item_id, ln(greatest((SELECT count(*) FROM documents), 1) / (1 + coalesce(df, 0))) AS idf FROM items LEFT JOIN df USING (word))
        SELECT item_id, round(avg(idf), 6) AS mean_idf, round(max(idf), 6) AS max_idf FROM idf GROUP BY item_id""",
    "examples_one_per_source": """
        WITH best AS (SELECT lang, source, doc_id, n_chars FROM documents QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY n_chars DESC, doc_id) = 1)
        SELECT *, CAST(row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS INTEGER) AS rank FROM best
        QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) <= 4""",
    "distinct_wordings": f"""
        SELECT source, count(*) AS n_docs, count(DISTINCT array_to_string(list_sort(list_distinct({W})), ' ')) AS n_wordings FROM documents GROUP BY source""",
    "sentence_positions": """
        WITH p AS (SELECT lang, string_split(text, '.') AS s FROM documents WHERE length(text) > 0),
        r AS (SELECT lang, len(s) AS m, unnest(s) AS t, unnest(range(len(s))) AS k FROM p)
        SELECT lang, CAST(least(9, floor(k * 10 / m)) AS INTEGER) AS bin, count(*) AS n_sentences, max(length(t)) AS longest FROM r WHERE trim(t) <> '' GROUP BY 1, 2""",
    "word_cooccurrence": f"""
        WITH w AS (SELECT {W} AS ws FROM documents),
        p AS (SELECT unnest(ws[:-2]) AS a, unnest(ws[2:]) AS b FROM w WHERE len(ws) > 1),
        c AS (SELECT a, b, count(*) AS n FROM p WHERE length(a) >= 8 GROUP BY a, b)
        SELECT a, b, n, CAST(row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS INTEGER) AS rank FROM c QUALIFY row_number() OVER (PARTITION BY a ORDER BY n DESC, b) <= 8""",
    "last_turn_flag": "SELECT conv_id, turn, role, turn = max(turn) OVER (PARTITION BY conv_id) AS is_last FROM conversations",
    "page_titles": r"""
        SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title,
          length(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g'))) AS n_plain FROM pages""",
    "label_precision": """
        WITH c AS (SELECT lang, count_if(n_chars >= 1000 AND quality = 1) AS tp, count_if(n_chars >= 1000 AND quality <> 1) AS fp, count_if(n_chars < 1000 AND quality = 1) AS fn
          FROM documents JOIN labels USING (doc_id) GROUP BY lang)
        SELECT *, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1 FROM c""",
    "data_checks": """
        SELECT *, n_bad = 0 AS passed FROM (
          SELECT 'labels_without_document' AS check_name, count(*) AS n_bad FROM labels ANTI JOIN documents USING (doc_id)
          UNION ALL SELECT 'orders_without_customer', count(*) FROM orders ANTI JOIN customer ON o_custkey = c_custkey
          UNION ALL SELECT 'items_without_order', count(*) FROM lineitem ANTI JOIN orders ON l_orderkey = o_orderkey
          UNION ALL SELECT 'repeated_doc_ids', count(*) FROM (SELECT doc_id FROM documents GROUP BY doc_id HAVING count(*) > 1)
          UNION ALL SELECT 'wrong_n_chars', count(*) FROM documents WHERE length(text) <> n_chars
          UNION ALL SELECT 'negative_quantity', count(*) FROM lineitem WHERE l_quantity < 0)""",
}
