"""The numbered operators applied to whole tables, with the columns that their contracts name."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, fingerprints, ftrl, license_scan, manifest, parity_join, pii, resampling, secret_scan, sentencepiece_codec, sharding, token_counts, warc_fixity
from tessera.llm.tables import documents, narrow

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parity_join.link(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


OP1_SQL = r"""
WITH RECURSIVE low AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[s : s + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS s FROM low WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM shingles a JOIN shingles b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * k >= 80 * (x.n + y.n - k)),
reach AS (
  SELECT doc_id AS node, doc_id AS other FROM documents
  UNION
  SELECT reach.node, links.b FROM reach JOIN links ON links.a = reach.other)
SELECT low.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, c.component_id
FROM low LEFT JOIN sizes ON sizes.doc_id = low.doc_id JOIN (SELECT node, min(other) AS component_id FROM reach GROUP BY node) c ON c.node = low.doc_id"""


def op2_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit of a second replica of ``pages``, derived with some damage.

    By crc32 of the page number modulo 97: 1 adds a character, 2 leaves 100 characters of the payload, 3 loses the
    record, 4 brings another record under the number -1 - page_id.
    """
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    fate = F.pmod(F.crc32(F.col("page_id").cast("string")), F.lit(97))
    html = F.when(fate == 1, F.concat("html", F.lit("~"))).when(fate == 2, F.substring("html", 1, 100)).otherwise(F.col("html"))
    extra = pages.where(fate == 4).select((-1 - F.col("page_id")).alias("page_id"), "url", "html")
    replica = pages.where(fate != 3).select("page_id", "url", html.alias("html")).unionByName(extra)
    return warc_fixity.audit(pages, replica)


OP2_SQL = r"""
WITH crc AS (
  SELECT page_id, url, html, (SELECT list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(page_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
    lambda acc, b: list_reduce(list_prepend(xor(acc, b), [CAST(0 AS BIGINT) FOR i IN range(8)]), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END))) AS r
  FROM pages),
fates AS (SELECT page_id, url, coalesce(html, '') AS html, xor(r, 4294967295) % 97 AS fate FROM crc),
copies AS (
  SELECT page_id, url, CASE fate WHEN 1 THEN html || '~' WHEN 2 THEN substring(html, 1, 100) ELSE html END AS html FROM fates WHERE fate <> 3
  UNION ALL SELECT -1 - page_id, url, html FROM fates WHERE fate = 4),
ours AS (SELECT page_id, 'WARC/1.1' || e || 'WARC-Type: response' || e || 'WARC-Record-ID: <urn:page:' || page_id || '>' || e || 'WARC-Target-URI: ' || coalesce(url, '') || e || 'Content-Type: text/html' || e
    || 'Content-Length: ' || octet_length(encode(html)) || e || e || html || e || e AS raw FROM fates, (SELECT chr(13) || chr(10) AS e)),
theirs AS (SELECT page_id, 'WARC/1.1' || e || 'WARC-Type: response' || e || 'WARC-Record-ID: <urn:page:' || page_id || '>' || e || 'WARC-Target-URI: ' || coalesce(url, '') || e || 'Content-Type: text/html' || e
    || 'Content-Length: ' || octet_length(encode(html)) || e || e || html || e || e AS raw FROM copies, (SELECT chr(13) || chr(10) AS e)),
placed AS (
  SELECT page_id, CAST(floor(page_id / 4096) AS BIGINT) AS file, CAST(octet_length(encode(raw)) AS BIGINT) AS length, sha256(raw) AS digest,
    CAST(coalesce(sum(octet_length(encode(raw))) OVER (PARTITION BY floor(page_id / 4096) ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset"
  FROM ours),
found AS (SELECT page_id, sha256(raw) AS found_digest FROM theirs)
SELECT coalesce(file, CAST(floor(f.page_id / 4096) AS BIGINT)) AS file, coalesce(p.page_id, f.page_id) AS page_id, "offset", length, digest, found_digest,
  CASE WHEN f.page_id IS NULL THEN 'missing' WHEN p.page_id IS NULL THEN 'extra' ELSE 'altered' END AS finding
FROM placed p FULL JOIN found f ON p.page_id = f.page_id WHERE digest IS DISTINCT FROM found_digest"""


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = narrow(documents(spark, sf_dir), "doc_id", "text").withColumn("held_out", ftrl.held_out(F.col("doc_id")))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~ftrl.held_out(F.col("doc_id")))
    return ftrl.score(docs, ftrl.train(docs, labels)).select("doc_id", "held_out", "score", "predicted")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(narrow(documents(spark, sf_dir), "doc_id", "text"))
    labels = lambda *spans: F.array_join(F.array_sort(F.array_distinct(F.concat(*[F.col(f"{s}.label") for s in spans]))), ",")
    ends = (F.array_min("base.start").alias("first_word"), F.array_max("base.start").alias("last_word"))
    return found.select("doc_id", "n_words", F.size("base").cast("long").alias("n_base"), *ends, labels("base").alias("base_labels"), labels("base", "found").alias("labels"), "score")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = narrow(documents(spark, sf_dir), "doc_id", "text")
    marked = decontaminate.mark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    items = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return marked.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP5_SQL = r"""
WITH RECURSIVE low AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
windows AS (
  SELECT DISTINCT item_id, n, array_to_string(w[s : s + n - 1], ' ') AS g
  FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS s FROM items WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM windows),
grams AS (
  SELECT doc_id, n, s, array_to_string(w[s : s + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM low, lengths)),
hits AS (SELECT doc_id, s, grams.n AS n, item_id FROM grams JOIN windows USING (g) WHERE grams.n = windows.n),
words AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS k FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM low LEFT JOIN words USING (doc_id) LEFT JOIN found USING (doc_id)"""


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = narrow(documents(spark, sf_dir), "doc_id", "text")
    return token_counts.count_tokens(docs, WORD_BPE).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprints.compare(documents(spark, sf_dir))
    return found.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def _printed(spans, kinds: tuple[str, ...]):
    """kind:start:end by start, then kind as listed, comma-joined."""
    rank = lambda s: F.array_position(F.array(*map(F.lit, kinds)), s["kind"])
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), rank(s).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _of_kind(kind: str):
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(narrow(documents(spark, sf_dir), "doc_id", "text"))
    counts = [_of_kind(k).alias(f"n_{k}") for k in secret_scan.KINDS[:3]]
    return found.select("doc_id", *counts, F.sha2(_printed(F.col("base"), secret_scan.KINDS), 256).alias("base_sha256"), _printed(F.concat("base", "found"), secret_scan.KINDS).alias("spans"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.annotate(narrow(documents(spark, sf_dir), "doc_id", "text"))
    counts = [_of_kind(k).alias(f"n_{k}") for k in pii.BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(_printed(F.col("base"), pii.KINDS), 256).alias("base_sha256"), _printed(F.concat("base", "found"), pii.KINDS).alias("spans"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = narrow(documents(spark, sf_dir), "doc_id", "text")
    return sentencepiece_codec.encode(docs, PIECE_BPE).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


#: Steps of crc32 by bytes, and the bytes of a text, as SQL. The table of 256 is made by the rule.
CRC_TABLE = r"""crc_table AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, [CAST(0 AS BIGINT) FOR k IN range(8)]), lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END) AS v FROM range(256) r(i)))"""


def _crc_sql(text: str) -> str:
    octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: CAST('0x' || h AS BIGINT))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {octets}), lambda c, b: xor(c // 256, t[xor(c, b) % 256 + 1])), 4294967295)"


def op11_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of near equal bytes, by the law 'bytes'."""
    cut = sharding.shard(documents(spark, sf_dir), 24)
    return cut.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


OP11_SQL = rf"""
WITH {CRC_TABLE},
sized AS (SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) + 8 AS BIGINT) AS size, {_crc_sql("coalesce(text, '')")} AS text_crc32 FROM documents, crc_table),
placed AS (SELECT *, CAST(sum(size) OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS before, CAST(sum(size) OVER () AS BIGINT) AS whole FROM sized),
cut AS (SELECT *, CAST((24 * (2 * before + size)) // (2 * whole) AS INTEGER) AS shard FROM placed)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY before) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM cut"""


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A draw of a tenth of the documents towards the words of ``benchmark``."""
    drawn = resampling.resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


OP12_SQL = rf"""
WITH {CRC_TABLE},
both_words AS (
  SELECT doc_id, false AS wanted, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM documents
  UNION ALL
  SELECT NULL, true, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark),
hashed AS (SELECT w, {_crc_sql("w")} % 10000 AS bucket FROM (SELECT DISTINCT w FROM both_words), crc_table),
counts AS (SELECT bucket, count(*) FILTER (NOT wanted) AS s, count(*) FILTER (wanted) AS t FROM both_words JOIN hashed USING (w) GROUP BY bucket),
sums AS (SELECT coalesce(sum(s), 0) AS big_s, coalesce(sum(t), 0) AS big_t FROM counts),
gains AS (SELECT bucket, CAST(floor(1000 * ln((CAST(t + 1 AS DOUBLE) * CAST(big_s + 10000 AS DOUBLE)) / (CAST(s + 1 AS DOUBLE) * CAST(big_t + 10000 AS DOUBLE)))) AS BIGINT) AS gain FROM counts, sums),
weights AS (SELECT doc_id, count(*) AS n, CAST(sum(gain) AS BIGINT) AS weight FROM both_words JOIN hashed USING (w) JOIN gains USING (bucket) WHERE NOT wanted GROUP BY doc_id),
scored AS (
  SELECT d.doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST(CAST('0x' || substr(sha256('2024:' || d.doc_id), 1, 8) AS BIGINT) AS DOUBLE) + 0.5) / 4294967296))) AS BIGINT) AS score
  FROM documents d LEFT JOIN weights USING (doc_id)),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS fit FROM scored WHERE n_features >= 20)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score, CASE WHEN r <= 10 * fit // 100 THEN r END AS rank FROM scored LEFT JOIN ranked USING (doc_id)"""

MANIFEST_FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of all documents by language, and which rows verify after n_chars was raised in about a seventh of them."""
    docs = documents(spark, sf_dir)
    fields = {c: F.col(c) for c in MANIFEST_FIELDS}
    altered = manifest.leaf(*(fields | {"n_chars": F.col("n_chars") + 1}).values())
    tampered = F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 0, altered)
    built = manifest.build(docs.select(*MANIFEST_FIELDS, tampered.alias("tampered")), MANIFEST_FIELDS, keep=("doc_id", "tampered"))
    checked = built.withColumn("folded_root", manifest.fold(F.coalesce("tampered", "leaf"), F.col("path")))
    return checked.select("doc_id", "leaf", "subroot", "root", F.sha2(manifest.siblings(F.col("path")), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _leaf_sql(n_chars: str) -> str:
    printed = lambda c: f"coalesce(octet_length(encode(CAST({c} AS VARCHAR))) || ':' || CAST({c} AS VARCHAR), '-')"
    return "sha256(" + " || ".join(printed(c) for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"


OP13_SQL = rf"""
WITH RECURSIVE {CRC_TABLE},
leaves AS (
  SELECT doc_id, lang, {_leaf_sql("n_chars")} AS leaf, CASE WHEN {_crc_sql("CAST(doc_id AS VARCHAR)")} % 7 = 0 THEN {_leaf_sql("(n_chars + 1)")} END AS tampered FROM documents, crc_table),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaves),
levels AS (
  SELECT lang, 0 AS level, list(leaf ORDER BY pos) AS nodes FROM placed GROUP BY lang
  UNION ALL
  SELECT lang, level + 1, list_transform(range((len(nodes) + 1) // 2), lambda i: sha256(nodes[2 * i + 1] || coalesce(nodes[2 * i + 2], ''))) FROM levels WHERE len(nodes) > 1),
subroots AS (SELECT lang, nodes[1] AS subroot, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS g FROM levels WHERE len(nodes) = 1),
uppers AS (
  SELECT 0 AS level, list(subroot ORDER BY g) AS nodes FROM subroots
  UNION ALL
  SELECT level + 1, list_transform(range((len(nodes) + 1) // 2), lambda i: sha256(nodes[2 * i + 1] || coalesce(nodes[2 * i + 2], ''))) FROM uppers WHERE len(nodes) > 1),
steps AS (
  SELECT p.doc_id, p.lang, p.pos, level, CASE WHEN (p.pos // (CAST(1 AS BIGINT) << level)) % 2 = 1 THEN 'L' || nodes[p.pos // (CAST(1 AS BIGINT) << level)] ELSE 'R' || coalesce(nodes[p.pos // (CAST(1 AS BIGINT) << level) + 2], '') END AS step
  FROM placed p JOIN levels l ON l.lang IS NOT DISTINCT FROM p.lang WHERE len(nodes) > 1
  UNION ALL
  SELECT p.doc_id, p.lang, p.pos, 1000 + level, CASE WHEN (g // (CAST(1 AS BIGINT) << level)) % 2 = 1 THEN 'L' || nodes[g // (CAST(1 AS BIGINT) << level)] ELSE 'R' || coalesce(nodes[g // (CAST(1 AS BIGINT) << level) + 2], '') END
  FROM placed p JOIN subroots s ON s.lang IS NOT DISTINCT FROM p.lang, uppers WHERE len(nodes) > 1),
proofs AS (SELECT lang, pos, list(step ORDER BY level) AS path FROM steps GROUP BY lang, pos),
folded AS (
  SELECT p.*, coalesce(path, []) AS path,
    list_reduce(list_prepend(coalesce(tampered, leaf), coalesce(path, [])), lambda d, s: sha256(CASE WHEN s[1] = 'L' THEN s[2:] || d ELSE d || s[2:] END)) AS folded_root
  FROM placed p LEFT JOIN proofs q ON q.lang IS NOT DISTINCT FROM p.lang AND q.pos = p.pos)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda s: s[2:]), '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM folded f JOIN subroots s ON s.lang IS NOT DISTINCT FROM f.lang, (SELECT nodes[1] AS root FROM uppers WHERE len(nodes) = 1)"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_jaccard_join": op1_jaccard_join,
    "op2_warc_fixity": op2_warc_fixity,
    "op3_toxicity": op3_toxicity,
    "op4_license_scan": op4_license_scan,
    "op5_decontaminate": op5_decontaminate,
    "op6_token_counts": op6_token_counts,
    "op7_fingerprints": op7_fingerprints,
    "op8_secret_scan": op8_secret_scan,
    "op9_pii": op9_pii,
    "op10_sentencepiece": op10_sentencepiece,
    "op11_byte_shards": op11_byte_shards,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_merkle_manifest": op13_merkle_manifest,
}

ORACLES: dict[str, str] = {"op1_jaccard_join": OP1_SQL, "op2_warc_fixity": OP2_SQL, "op5_decontaminate": OP5_SQL, "op11_byte_shards": OP11_SQL, "op12_importance_resampling": OP12_SQL, "op13_merkle_manifest": OP13_SQL}
