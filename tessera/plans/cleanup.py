"""Edits of parts as clues of their shelf (forty parts each): what holds of them, and the counts of orders after them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.cleanup import Checked, cleaned, excluded
from tessera.plans.corpus import table


def shelf_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Tables as `tessera.operators.cleanup` takes them.

    A part's spellings are its name alone, with "kit" and with "set", by line number; questions are orders, in groups by order number.
    Edits go by the part's number modulo 20: chains, a cycle with a tail, targets that are dropped or unknown, labels of several kinds.
    """
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.floor(F.col("p_partkey") / 40).alias("topic"), "p_name", F.lower("p_type").alias("hint"))
    line = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("id"), F.col("l_orderkey").alias("question"), F.get(F.array(F.lit(""), F.lit(" kit"), F.lit(" set")), (F.col("l_linenumber") % 3).cast("int")).alias("tail"))
    uses = line.join(part, "id").select("topic", "id", F.concat("p_name", "tail").alias("spelling"), "question")
    k, m = F.col("id"), F.col("id") % 20
    into = F.when(m.isin(1, 2), k - 1).when(m.isin(4, 5, 6, 8, 9), k + 1).when(m.isin(10, 11), k - 2).when(m == 12, k + 40).when(m == 18, k)
    second = F.get(F.split("p_name", " "), F.lit(1))
    label = F.when(m == 13, F.concat(F.get(F.split("p_name", " "), F.lit(0)), F.lit(" "), F.col("hint"))).when(m == 14, F.concat(F.lit("golden "), F.col("p_name"))).when(m == 15, F.lit(" ")).when(m == 16, F.concat(second, F.lit("x")))
    remove = F.when(m.isin(4, 7), F.array(F.concat("p_name", F.lit(" kit")))).when(m == 17, F.array(*[F.concat("p_name", F.lit(t)) for t in ("", " kit", " set")]))
    action = F.when(m == 0, "drop").when(into.isNotNull(), "merge").when(label.isNotNull(), "rename").otherwise("keep")
    edits = part.select("topic", F.when(F.col("topic") % 2 == 0, k).otherwise(-k).alias("seq"), F.when(m == 19, k + 1_000_000_000).otherwise(k).alias("id"), action.alias("action"), into.alias("into"), label.alias("label"), remove.alias("remove"))
    group = F.when(F.col("question") % 4 == 0, 0).otherwise(F.col("question") % 6)
    category = F.when(F.col("topic") % 2 == 0, "parts").otherwise("tools")
    answer = F.when((F.col("answer_group") == 0) & (F.col("topic") % 3 == 0), F.concat(F.lit("the Shelf "), F.col("topic").cast("string"))).otherwise(F.concat(F.lit("crate "), F.col("answer_group").cast("string")))
    groups = uses.select("topic", "question").distinct().withColumn("answer_group", group).select("topic", "answer_group", answer.alias("answer"), category.alias("category"), "question")
    shelves = part.select("topic").distinct()
    said = shelves.select("topic", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("seq")).where(((F.col("topic") + F.col("seq")) % 2 == 0) | (F.col("topic") % 5 == 0))
    return {
        "clues": part.select("topic", "id", F.col("p_name").alias("label"), F.col("id").alias("rank")),
        "spellings": uses, "sources": uses.select("topic", "id", F.col("spelling").alias("text")).distinct().unionByName(part.select("topic", "id", F.col("hint").alias("text"))),
        "edits": edits, "groups": groups, "topics": shelves.select("topic", F.concat(F.lit("Shelf "), F.col("topic").cast("string"), F.lit(" (parts)")).alias("title"), F.lit("parts").alias("category")),
        "off": said.select("topic", "seq", F.col("seq").cast("long").alias("answer_group")),
    }


def cleanup_recount(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clues that stay with label, counts of distinct orders, clues and spellings, and rank within their shelf."""
    t = shelf_tables(spark, sf_dir)
    checked = Checked(t["clues"], t["spellings"], t["sources"], t["edits"])
    return cleaned(t["clues"], t["spellings"], checked, t["groups"], excluded(t["groups"], t["topics"], t["off"]))


def cleanup_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits that don't hold, and why."""
    t = shelf_tables(spark, sf_dir)
    return Checked(t["clues"], t["spellings"], t["sources"], t["edits"]).notes


def cleanup_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups said to be off the topic: those that go, and why others stay."""
    t = shelf_tables(spark, sf_dir)
    return excluded(t["groups"], t["topics"], t["off"])


QUERIES = {f.__name__: f for f in (cleanup_recount, cleanup_notes, cleanup_groups)}

_TABLES = """WITH RECURSIVE p AS (SELECT p_partkey AS id, p_partkey // 40 AS topic, p_partkey % 20 AS m, p_name, split_part(p_name, ' ', 1) AS one, split_part(p_name, ' ', 2) AS two, lower(p_type) AS hint FROM part),
    u AS (SELECT DISTINCT topic, id, p_name || CASE l_linenumber % 3 WHEN 0 THEN '' WHEN 1 THEN ' kit' ELSE ' set' END AS spelling, l_orderkey AS question FROM lineitem JOIN p ON l_partkey = id),
    g AS (SELECT topic, CASE WHEN question % 4 = 0 THEN 0 ELSE question % 6 END AS answer_group, count(*) AS n FROM (SELECT DISTINCT topic, question FROM u) GROUP BY ALL),
    judged AS (SELECT topic, answer_group, n, answer_group = 0 AND topic % 3 = 0 AS named, topic % 2 = 0 AS own, (topic + answer_group) % 2 = 0 OR topic % 5 = 0 AS said FROM g),
    chosen AS (SELECT *, said AND NOT (named AND own) AS off FROM judged),
    share AS (SELECT *, sum(CASE WHEN off THEN n ELSE 0 END) OVER (PARTITION BY topic ORDER BY n, answer_group DESC ROWS UNBOUNDED PRECEDING) AS upto, sum(n) OVER (PARTITION BY topic) AS total, bool_or(named AND NOT off) OVER (PARTITION BY topic) AS safe FROM chosen),
    gone AS (SELECT topic, answer_group FROM share WHERE off AND (safe OR upto <= 0.5 * total)),
    e AS (SELECT topic, id, CASE WHEN topic % 2 = 0 THEN id ELSE -id END AS seq, CASE WHEN m IN (1, 2) THEN id - 1 WHEN m IN (4, 5, 6, 8, 9) THEN id + 1 WHEN m IN (10, 11) THEN id - 2 END AS into_ FROM p),
    edge AS (SELECT e.* FROM e JOIN p ON e.into_ = p.id AND e.topic = p.topic),
    walk AS (SELECT topic, id, seq, into_ AS at_, CAST([] AS BIGINT[]) AS seqs FROM edge
        UNION ALL SELECT w.topic, w.id, w.seq, x.into_, list_append(w.seqs, x.seq) FROM walk w JOIN edge x ON x.id = w.at_ WHERE len(w.seqs) = 0 OR NOT list_contains(w.seqs, x.seq)),
    done AS (SELECT topic, id, seq, arg_max(at_, len(seqs)) AS last_, list_min(arg_max(seqs, len(seqs))) AS first_ FROM walk GROUP BY ALL),
    home AS (SELECT topic, id, CASE WHEN last_ NOT IN (SELECT id FROM edge) AND last_ % 20 <> 0 THEN last_ WHEN first_ IS NOT NULL AND first_ < seq THEN abs(first_) END AS home FROM done),
"""

ORACLES = {
    "cleanup_recount": _TABLES
    + """h AS (SELECT p.topic, p.id, coalesce(home.home, p.id) AS home FROM p LEFT JOIN home USING (topic, id) WHERE m <> 0),
        taken AS (SELECT DISTINCT u.topic, u.id, spelling FROM u JOIN p USING (id) WHERE m IN (4, 7) AND spelling = p_name || ' kit' AND u.id IN (SELECT id FROM u GROUP BY id HAVING count(DISTINCT spelling) > 1)),
        l AS (SELECT u.topic, u.id, spelling, question, home FROM u JOIN h USING (topic, id) WHERE (u.id, spelling) NOT IN (SELECT (id, spelling) FROM taken) AND (u.topic, CASE WHEN question % 4 = 0 THEN 0 ELSE question % 6 END) NOT IN (SELECT (topic, answer_group) FROM gone)),
        c AS (SELECT topic, home AS id, count(DISTINCT question) AS n_questions, count(DISTINCT (id, spelling)) AS n_spellings FROM l GROUP BY 1, 2),
        s AS (SELECT topic, home AS id, count(*) AS n_clues FROM h GROUP BY 1, 2)
        SELECT topic, id, CASE m WHEN 13 THEN one || ' ' || hint WHEN 16 THEN CASE WHEN length(two) < 4 THEN p_name ELSE two || 'x' END ELSE p_name END AS label, n_questions, n_clues, n_spellings, id AS rank_before, row_number() OVER (PARTITION BY topic ORDER BY n_questions DESC, id) AS rank FROM c JOIN s USING (topic, id) JOIN p USING (topic, id)""",
    "cleanup_notes": _TABLES
    + """n AS (SELECT topic, CASE WHEN topic % 2 = 0 THEN id ELSE -id END AS seq, CASE WHEN m = 19 THEN id + 1000000000 ELSE id END AS id,
          CASE m WHEN 19 THEN 'unknown id' WHEN 12 THEN 'merge into unknown' WHEN 18 THEN 'merge into unknown' WHEN 15 THEN 'label empty or too long' WHEN 14 THEN 'label with words of its own' WHEN 16 THEN CASE WHEN length(two) < 4 THEN 'label with words of its own' END END AS note FROM p)
        SELECT * FROM n WHERE note IS NOT NULL UNION ALL SELECT topic, seq, id, 'target dropped or circular' FROM e JOIN home USING (topic, id) WHERE home IS NULL
        UNION ALL SELECT topic, seq, id, 'merge into unknown' FROM e WHERE into_ IS NOT NULL AND (topic, id) NOT IN (SELECT (topic, id) FROM edge)""",
    "cleanup_groups": _TABLES
    + """o AS (SELECT topic, answer_group, CASE WHEN named AND own THEN 'names the topic in its own subject' WHEN NOT safe AND upto > 0.5 * total THEN 'would leave under half the questions' END AS note FROM share WHERE said)
        SELECT * FROM o UNION ALL SELECT topic, k, 'unknown group' FROM (SELECT DISTINCT topic, unnest(range(7)) AS k FROM g) WHERE ((topic + k) % 2 = 0 OR topic % 5 = 0) AND (topic, k) NOT IN (SELECT (topic, answer_group) FROM g)""",
}
