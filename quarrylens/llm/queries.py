"""One query per operator, over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.llm import (
    bpe,
    hilbert_ann,
    line_dedup,
    minhash_dedup,
    packing,
    periodic_runs,
    pitman_yor,
    quality_rules,
    secret_scan,
    simhash_dedup,
    token_counts,
    warc,
    whitening,
)
from quarrylens.llm.shared import ORACLES, QUERIES, query, table

__all__ = ["ORACLES", "QUERIES"]


@query("op2_packing")
def op2_packing(spark: SparkSession, root: str) -> DataFrame:
    return packing.pack_documents(table(spark, root, "documents"))


@query("op5_token_counts")
def op5_token_counts(spark: SparkSession, root: str) -> DataFrame:
    return token_counts.token_counts(table(spark, root, "documents"))


@query("op10_forced_boundary_bpe")
def op10_forced_boundary_bpe(spark: SparkSession, root: str) -> DataFrame:
    return bpe.encoding_digests(table(spark, root, "documents"))


OP8_SQL = f"""
WITH parts AS (
  SELECT doc_id, coalesce(text, '') AS body,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM documents),
runs AS (
  SELECT doc_id, p, words[p] || chr(32) || words[p + 1] || chr(32) || words[p + 2] AS w
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS p FROM parts)),
twice AS (SELECT doc_id, p FROM runs QUALIFY count(*) OVER (PARTITION BY doc_id, w) > 1),
covered AS (SELECT doc_id, count(DISTINCT p + k) AS n FROM twice, (SELECT unnest(range(3)) AS k) GROUP BY doc_id),
counts AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda w: length(w))), 0)::BIGINT AS word_chars,
         len(regexp_extract_all(body, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_word_lines,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         len(list_filter(words, lambda w: list_contains({sorted({w for ws in quality_rules.STOP_WORDS.values() for w in ws})}, lower(w))))::BIGINT AS n_stop_words,
         coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM parts LEFT JOIN covered USING (doc_id)),
judged AS (
  SELECT *, n_words < {quality_rules.MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         {" AND ".join(
             f"({r.below} = 0 OR (" + " AND ".join(
                 ([f"{r.above} >= {r.lowest}::DOUBLE * {r.below}"] if r.lowest is not None else [])
                 + ([f"{r.above} <= {r.highest}::DOUBLE * {r.below}"] if r.highest is not None else [])) + "))"
             for r in quality_rules.RULES)} AS within
  FROM counts)
SELECT doc_id, n_words, word_chars, n_symbols, n_word_lines, n_dup_lines, n_stop_words, n_repeat_words, base_failed,
       NOT base_failed AND within AS kept
FROM judged
"""


@query("op8_quality_rules", OP8_SQL)
def op8_quality_rules(spark: SparkSession, root: str) -> DataFrame:
    return quality_rules.quality_verdicts(table(spark, root, "documents")).drop("broken_rules")


@query("op9_secret_scans")
def op9_secret_scans(spark: SparkSession, root: str) -> DataFrame:
    return secret_scan.secret_report(table(spark, root, "documents"))


_STRIP = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
OP6_SQL = f"""
WITH lines AS (
  SELECT doc_id, p, line,
         translate(trim(line, {_STRIP}), '{line_dedup.UPPER}', '{line_dedup.LOWER}') AS key
  FROM (SELECT doc_id, generate_subscripts(ls, 1) AS p, unnest(ls) AS line
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))),
keys AS (
  SELECT key, max(doc_id) AS last_doc FROM lines WHERE length(key) >= {line_dedup.LEAST_CHARS}
  GROUP BY key HAVING count(DISTINCT doc_id) >= {line_dedup.LEAST_DOCS}),
judged AS (
  SELECT doc_id, p, line, coalesce(doc_id < last_doc, false) AS gone FROM lines LEFT JOIN keys USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE gone))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""


@query("op6_line_dedup", OP6_SQL)
def op6_line_dedup(spark: SparkSession, root: str) -> DataFrame:
    done = line_dedup.line_dedup(table(spark, root, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP1_SQL = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{line_dedup.UPPER}', '{line_dedup.LOWER}'),
                                                   '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
  FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS met
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * met >= {minhash_dedup.SHARE} * (x.n + y.n - met)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT doc_id AS a, doc_id AS c FROM documents
  UNION SELECT e.b, r.c FROM reach r JOIN edges e ON e.a = r.a)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, c AS component_id, d.doc_id = c AS kept
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN (SELECT a, min(c) AS c FROM reach GROUP BY a) r ON r.a = d.doc_id
"""


@query("op1_minhash_dedup", OP1_SQL)
def op1_minhash_dedup(spark: SparkSession, root: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, root, "documents"))


_BITS = "('0x' || substr(h, {at}, 5))::BIGINT"
_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((({_BITS.format(at=5 * k + 1)}) >> {shift}) & 31)::INT + 1, 1)" for k in range(8) for shift in (15, 10, 5, 0)
)
OP4_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
q AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS last FROM p)
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, {_BASE32} AS payload_digest,
       CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < last THEN last END AS refers_to
FROM q
"""


@query("op4_warc", OP4_SQL)
def op4_warc(spark: SparkSession, root: str) -> DataFrame:
    read = warc.warc_round_trip(table(spark, root, "pages").select("page_id", "url", "html"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op7_hilbert_ann")
def op7_hilbert_ann(spark: SparkSession, root: str) -> DataFrame:
    return hilbert_ann.nearest_neighbours(table(spark, root, "embeddings"))


@query("op3_pitman_yor")
def op3_pitman_yor(spark: SparkSession, root: str) -> DataFrame:
    return pitman_yor.score_documents(table(spark, root, "documents"))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id, text: a tenth of the documents, chosen by their ids, repeat a passage to their end."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    rows = docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    chosen = rows.withColumn("words", F.when(F.col("h") % 10 == 0, words)).withColumn("n", F.size("words"))
    g = F.floor(F.col("h") / 10)
    placed = chosen.withColumn("a", F.when(F.col("n") > 0, F.pmod(g, F.col("n"))))
    placed = placed.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.pmod(g, F.lit(8)))))
    source = lambda i: F.when(i >= F.col("a"), F.col("a") + F.pmod(i - F.col("a"), F.col("p"))).otherwise(i).cast("int")
    repeated = F.array_join(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.get("words", source(i))), " ")
    return placed.select("doc_id", F.when(F.col("n") > 0, repeated).otherwise(F.col("text")).alias("text"))


@query("op11_periodic_runs")
def op11_periodic_runs(spark: SparkSession, root: str) -> DataFrame:
    planted = with_planted_runs(table(spark, root, "documents").select("doc_id", "text"))
    return periodic_runs.run_digests(periodic_runs.periodic_runs(planted))


@query("op12_simhash_dedup")
def op12_simhash_dedup(spark: SparkSession, root: str) -> DataFrame:
    return simhash_dedup.near_duplicates(table(spark, root, "documents"))


@query("op13_whitening")
def op13_whitening(spark: SparkSession, root: str) -> DataFrame:
    return whitening.whiten(table(spark, root, "embeddings"))
