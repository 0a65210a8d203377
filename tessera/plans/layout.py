"""Questions as sentences of a kind, and what their giveaways say."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import sentences as S
from tessera.plans.corpus import table


def layout(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, sentence, part, kind, text, char_start, char_end, word_start, word_end, position, in_power) of each row's text. No shuffle. Positions are rounded to four digits, halves up.

    Null, empty and blank texts give no rows; equal rows give equal rows. Only ``key`` and ``text`` are read.
    """
    clean = rows.select(F.col(key), S.clean_text(F.col(text)).alias("clean"), S.power_char(F.col(text)).alias("power"))
    found = clean.where("clean <> ''").select(key, "power", F.length("clean").alias("length"), F.explode(S.parts(F.col("clean"))).alias("x"))
    return found.select(
        key, "x.sentence", "x.part", "x.kind", "x.text", "x.char_start", (F.col("x.char_start") + F.length("x.text")).alias("char_end"), "x.word_start", (F.col("x.word_start") + S.n_words(F.col("x.text"))).alias("word_end"),
        F.round(F.col("x.char_start") / F.col("length"), 4).alias("position"), F.coalesce(F.col("x.char_start") < F.col("power"), F.lit(False)).alias("in_power"),
    )


def questions_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions built from documents: a power mark for the first line break, and an ask in the end."""
    text = F.concat(F.regexp_replace("text", r"^([^\n]*)\n", "$1 (*) "), F.lit(" A text in "), F.col("lang"), F.lit(", for 10 points, name this source. Dr. B. Ask wrote it."))
    return table(spark, sf_dir, "documents").select("doc_id", text.alias("question"))


def question_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each clue, giveaway and note of the questions lies, its text by a digest."""
    return layout(questions_of(spark, sf_dir), "doc_id", "question").withColumn("text", F.md5("text"))


def giveaways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What giveaways of the questions say without their frame, with the number of questions that say it."""
    said = layout(questions_of(spark, sf_dir), "doc_id", "question").where("kind = 'giveaway'").select("doc_id", S.giveaway_facts(F.col("text")).alias("facts"))
    return said.where("facts <> ''").groupBy("facts").agg(F.countDistinct("doc_id").alias("n"))


def term_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of the questions' clues and giveaways, whatever their case: sentences that hold them and one spelling. One shuffle, after partial counts."""
    said = layout(questions_of(spark, sf_dir), "doc_id", "question").where("kind <> 'note'").select(F.explode(S.sentence_terms(F.col("text"))).alias("term"))
    return said.groupBy(F.lower("term").alias("key")).agg(F.count("*").alias("n_sentences"), F.min("term").alias("term"))


QUERIES = {f.__name__: f for f in (question_layout, giveaways, term_counts)}

_ARRAY = lambda words: "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"
_LIST = lambda words: "(" + ", ".join(f"'{w}'" for w in words) + ")"
_LAYOUT = rf"""q AS (SELECT doc_id, regexp_replace(text, '^([^\n]*)\n', '\1 (*) ') || ' A text in ' || lang || ', for 10 points, name this source. Dr. B. Ask wrote it.' AS q FROM documents),
f AS (SELECT doc_id, trim(regexp_replace(q, '[\s\x0b\x85\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+', ' ', 'g')) AS f FROM q WHERE q IS NOT NULL),
c AS (SELECT doc_id, trim(regexp_replace(f, '(?: *\(\*\) *)+', ' ', 'g')) AS clean, CASE WHEN contains(f, '(*)') THEN trim(split_part(f, '(*)', 1)) END AS before_ FROM f),
p AS (SELECT doc_id, clean, before_, string_split(regexp_replace(clean, '([.!?]["”’'')\]]*) ', '\1' || chr(1), 'g'), chr(1)) AS l FROM c),
e AS (SELECT doc_id, length(clean) AS len, length(before_) + CASE WHEN before_ <> '' AND length(clean) > length(before_) THEN 1 ELSE 0 END AS power, unnest(l) AS p, unnest(list_append(l[2:], NULL)) AS nxt, unnest(range(len(l))) AS i FROM p),
t AS (SELECT *, right(p, 1) AS last_, lower(regexp_extract(p, '([^ ]*?)[.!?"”’'')]*$', 1)) AS token, lower(regexp_extract(nxt, '^["“''(\[]*([\p{{L}}\p{{N}}_''’]+)', 1)) AS word FROM e),
j AS (SELECT *, CASE WHEN nxt IS NULL THEN 1 WHEN NOT regexp_matches(nxt, '^[\p{{Lu}}\p{{Nd}}"“''(\[]') THEN 0 WHEN last_ IN ('!', '?') THEN 2 WHEN last_ <> '.' THEN 1 WHEN token IN {_LIST(S.ABBREVIATIONS)} THEN 0
  WHEN regexp_matches(token, '^(?:\p{{L}}|[0-9]+|(?:[a-z]\.)+[a-z])$') THEN CAST(word IN {_LIST(S.STARTERS)} AS INTEGER) ELSE 1 END AS sure FROM t),
g AS (SELECT doc_id, list_reduce(list_prepend({{'sure': 0, 's': 0, 'c': 0, 'flags': ''}}, list({{'sure': sure, 's': length(p) - length(replace(p, '"', '')), 'c': length(replace(p, '”', '')) - length(replace(p, '“', '')), 'flags': ''}} ORDER BY i)),
  lambda a, x: CASE WHEN x.sure = 1 OR x.sure = 2 AND (a.s + x.s) % 2 = 0 AND a.c + x.c <= 0 THEN {{'sure': 0, 's': 0, 'c': 0, 'flags': a.flags || '1'}} ELSE {{'sure': 0, 's': a.s + x.s, 'c': a.c + x.c, 'flags': a.flags || '0'}} END).flags AS flags FROM j GROUP BY doc_id),
n AS (SELECT doc_id, len, power, p, i, length(replace(substr(flags, 1, i), '0', '')) AS sentence FROM j JOIN g USING (doc_id)),
s AS (SELECT doc_id, sentence, any_value(len) AS len, any_value(power) AS power, string_agg(p, ' ' ORDER BY i) AS text FROM n GROUP BY doc_id, sentence),
w AS (SELECT *, coalesce(sum(length(text) + 1) OVER o, 0) AS char_start, coalesce(sum(length(text) - length(replace(text, ' ', '')) + 1) OVER o, 0) AS word_start, len(list_filter({_ARRAY(S.NOTE_OPENINGS)}, lambda o: starts_with(lower(text), o))) > 0 AS note, regexp_matches(text, '{S.ASKS}') AS asks
  FROM s WINDOW o AS (PARTITION BY doc_id ORDER BY sentence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
b AS (SELECT *, coalesce(min(sentence) FILTER (asks AND NOT note) OVER d, CASE WHEN count(*) FILTER (NOT note) OVER d > 1 THEN max(sentence) FILTER (NOT note) OVER d END) AS give FROM w WINDOW d AS (PARTITION BY doc_id)),
k AS (SELECT *, CASE WHEN note THEN 'note' WHEN sentence >= give THEN 'giveaway' ELSE 'clue' END AS kind, length(text) - length(replace(text, ' ', '')) + 1 AS words FROM b),
m AS (SELECT *, CASE WHEN kind = 'clue' AND words > {S.LONG_WORDS} THEN list_reduce([x || ';' FOR x IN string_split(text, '; ')], lambda a, x: CASE WHEN length(regexp_extract(a, '[^\x01]*$')) > {S.SHORT_PIECE} THEN a || chr(1) || x ELSE a || ' ' || x END) ELSE text || ';' END AS cut FROM k),
x AS (SELECT *, unnest(string_split(cut[: -2], chr(1))) AS t, unnest(range(len(string_split(cut, chr(1))))) AS part FROM m),
y AS (SELECT *, coalesce(sum(length(t) + 1) OVER u, 0) AS off, coalesce(sum(length(t) - length(replace(t, ' ', '')) + 1) OVER u, 0) AS woff FROM x WINDOW u AS (PARTITION BY doc_id, sentence ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""
ORACLES = {
    "question_layout": rf"""WITH {_LAYOUT}
SELECT doc_id, CAST(sentence AS INTEGER) AS sentence, CAST(part AS INTEGER) AS part, kind, md5(t) AS text, CAST(char_start + off AS INTEGER) AS char_start, CAST(char_start + off + length(t) AS INTEGER) AS char_end, CAST(word_start + woff AS INTEGER) AS word_start,
CAST(word_start + woff + length(t) - length(replace(t, ' ', '')) + 1 AS INTEGER) AS word_end, CAST(((char_start + off) * 20000 + len) // (2 * len) AS BIGINT) / 10000 AS position, coalesce(char_start + off < power, false) AS in_power FROM y""",
    "giveaways": rf"""WITH {_LAYOUT},
h AS (SELECT doc_id, regexp_matches(t, '{S.ASKS}') AS asks, regexp_replace(regexp_extract(t, '(?s)^(.*?){S.ASKS}', 1), '^[ ,;:–—-]+|[ ,;:–—-]+$', '', 'g') AS b, CASE WHEN regexp_matches(t, '{S.ASKS}') THEN regexp_extract(t, '(?s){S.ASKS}(.*)$', 1) ELSE t END AS a FROM y WHERE kind = 'giveaway'),
l AS (SELECT doc_id, trim(b) AS b, string_split(ltrim(a, ' ,;:'), ' ') AS w FROM h),
l1 AS (SELECT *, CASE WHEN lower(w[1]) = 'please' THEN w[2:] ELSE w END AS v FROM l),
l2 AS (SELECT *, CASE WHEN len(v) > 1 AND list_contains({_ARRAY(S.ASK_VERBS)}, lower(v[1])) THEN v[2:] END AS v2 FROM l1),
l3 AS (SELECT *, CASE WHEN len(v2) > 1 AND list_contains({_ARRAY(S.ASKED_FOR)}, lower(v2[1])) THEN v2[2:] ELSE v2 END AS v3 FROM l2),
l4 AS (SELECT *, CASE WHEN len(v3) > 1 AND list_contains({_ARRAY(S.POINTERS)}, lower(v3[1])) THEN v3[2:] ELSE v3 END AS v4 FROM l3),
z AS (SELECT doc_id, b, trim(array_to_string(coalesce(v4, w), ' '), ' ,;:–—-') AS a FROM l4),
z1 AS (SELECT *, string_split(lower(a), ' ') AS w FROM z),
v AS (SELECT doc_id, b, CASE WHEN list_contains({_ARRAY(S.QUESTION_WORDS)}, w[1]) AND len(w) - CASE WHEN len(w) > 2 AND list_contains({_ARRAY(S.BARE_POINTERS)}, w[2]) THEN 1 ELSE 0 END = 2
  AND regexp_full_match(w[-1], '[a-z][\p{{L}}\p{{N}}_-]*\??') THEN '' ELSE trim(rtrim(a, '.')) END AS a FROM z1),
r AS (SELECT doc_id, trim(concat_ws(' ', CASE WHEN length(b) - length(replace(b, ' ', '')) >= 2 THEN b ELSE '' END, CASE WHEN contains(a, ' ') THEN a ELSE '' END)) AS facts FROM v)
SELECT facts, count(DISTINCT doc_id) AS n FROM r WHERE facts <> '' GROUP BY facts""",
}
