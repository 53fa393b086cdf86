"""Queries over blocks and chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.functions.text import point_id, token_count, tokenize, strip
from quarrylens.operators import blocks as B
from quarrylens.operators import chunking as C
from quarrylens.operators.html import explode_pages, first_heading
from quarrylens.sources.tables import spread
from quarrylens.operators.unfold import unfold
from quarrylens.plans.catalog import documents, long, query, sql_strip, sql_token_count, sql_tokens, table

# The texts have no headings or lists.  For the block queries a line that opens
# with a two-letter word becomes a heading, with a three-letter word an item,
# and full stops at line ends go, so that all block types occur.
_MARKS = (
    (r"(\A|\n)([A-Z][a-z]) ", "# "),
    (r"(\A|\n)([A-Z][a-z]{2}) ", "- "),
)


def marked(text: Column) -> Column:
    for pattern, mark in _MARKS:
        text = F.regexp_replace(text, pattern, f"$1{mark}$2 ")
    return F.regexp_replace(text, r"\.(\n|\z)", "$1")


_SQL_MARKED = "text"
for _pattern, _mark in _MARKS:
    _SQL_MARKED = f"regexp_replace({_SQL_MARKED}, '{_pattern}', '\\1{_mark}\\2 ', 'g')"
_SQL_MARKED = f"regexp_replace({_SQL_MARKED}, '\\.(\\n|\\z)', '\\1', 'g')"



def _sql_lines(text: str) -> str:
    """Trimmed, non-empty lines of a text as (doc_id, pos, p)."""
    return f"""
lines AS (
  SELECT doc_id, list_filter(list_transform(regexp_split_to_array({text}, '\\n+'), lambda p: {sql_strip('p')}), lambda p: p <> '') ps
  FROM documents),
paras AS (SELECT doc_id, unnest(ps) p, generate_subscripts(ps, 1) - 1 pos FROM lines)"""


_SQL_HEADING = (
    r"(length(p) <= 120 AND NOT ends_with(p, '.') AND "
    r"regexp_matches(p, '^(?:(?:\d+[.\d]*\s+)?[A-Z][A-Z\s\-/]{3,}(?m:$)|#{1,4}\s)'))"
)
_SQL_TYPE = rf"CASE WHEN {_SQL_HEADING} THEN 'heading' WHEN regexp_matches(p, '^(?:[*-]|\d+[.)]\s)') THEN 'list_item' ELSE 'prose' END"


@query("tokenize", f"SELECT doc_id, len(t)::BIGINT n_tokens, len(list_distinct(t))::BIGINT n_distinct FROM (SELECT doc_id, {sql_tokens('text')} t FROM documents)")
def tokens(spark: SparkSession, root: str) -> DataFrame:
    rows = documents(spark, root).select("doc_id", tokenize(F.col("text")).alias("t"))
    return rows.select("doc_id", long(F.size("t")).alias("n_tokens"), long(F.size(F.array_distinct("t"))).alias("n_distinct"))


@query("token_count", f"SELECT doc_id, {sql_token_count('text')}::BIGINT n_tokens FROM documents")
def token_counts(spark: SparkSession, root: str) -> DataFrame:
    return documents(spark, root).select("doc_id", long(token_count(F.col("text"))).alias("n_tokens"))


@query(
    "chunk_uuid",
    """WITH h AS (SELECT doc_id, sha1(from_hex('6ba7b8109dad11d180b400c04fd430c8') || encode(doc_id::VARCHAR || '::0::0')) d FROM documents)
    SELECT doc_id, concat_ws('-', substr(d,1,8), substr(d,9,4), '5' || substr(d,14,3),
      translate(substr(d,17,1), '0123456789abcdef', '89ab89ab89ab89ab') || substr(d,18,3), substr(d,21,12)) point_id FROM h""",
)
def chunk_uuid(spark: SparkSession, root: str) -> DataFrame:
    key = F.concat(F.col("doc_id").cast("string"), F.lit("::0::0"))
    return documents(spark, root).select("doc_id", point_id(key).alias("point_id"))


@query(
    "para_split",
    f"WITH {_sql_lines('text')} SELECT doc_id, pos::BIGINT pos, length(p)::BIGINT n_chars, md5(p) digest FROM paras",
)
def para_split(spark: SparkSession, root: str) -> DataFrame:
    doubled = F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n"))
    rows = unfold(documents(spark, root), ["doc_id"], B.paragraphs(doubled), "p", "pos")
    return rows.select("doc_id", long("pos").alias("pos"), long(F.length("p")).alias("n_chars"), F.md5(F.encode("p", "UTF-8")).alias("digest"))


@query("heading_flag", f"WITH {_sql_lines(_SQL_MARKED)} SELECT doc_id, pos::BIGINT pos, {_SQL_HEADING} is_heading FROM paras")
def heading_flag(spark: SparkSession, root: str) -> DataFrame:
    rows = unfold(documents(spark, root), ["doc_id"], B.paragraphs(marked(F.col("text")), every_line=True), "p", "pos")
    return rows.select("doc_id", long("pos").alias("pos"), B.is_heading(F.col("p")).alias("is_heading"))


def _marked_blocks(spark: SparkSession, root: str) -> DataFrame:
    return B.explode_blocks(documents(spark, root), "doc_id", B.text_blocks(marked(F.col("text")), every_line=True))


@query("block_typing", f"WITH {_sql_lines(_SQL_MARKED)} SELECT doc_id, pos::BIGINT pos, {_SQL_TYPE} block_type FROM paras")
def block_typing(spark: SparkSession, root: str) -> DataFrame:
    return _marked_blocks(spark, root).select("doc_id", long("block_index").alias("pos"), "block_type")


@query(
    "section_ffill",
    f"""WITH {_sql_lines(_SQL_MARKED)}, typed AS (SELECT *, {_SQL_TYPE} t FROM paras)
    SELECT doc_id, pos::BIGINT pos, last_value(CASE WHEN t = 'heading' THEN p END IGNORE NULLS)
      OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) section FROM typed""",
)
def section_ffill(spark: SparkSession, root: str) -> DataFrame:
    return _marked_blocks(spark, root).select("doc_id", long("block_index").alias("pos"), F.col("section_header").alias("section"))


@query(
    "block_numbering",
    """SELECT user_id AS doc_id, event_id AS pos, row_number() OVER w - 1 AS block_index,
      CASE WHEN event_type = 'view' THEN (count(*) FILTER (event_type = 'view') OVER w) - 1 END AS table_index,
      last_value(CASE WHEN event_type = 'click' THEN props END IGNORE NULLS) OVER w AS section
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)""",
)
def block_numbering(spark: SparkSession, root: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "view", "table").when(F.col("event_type") == "click", "heading").otherwise("prose")
    rows = table(spark, root, "events").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("pos"), kind.alias("kind"), "props")
    numbered = B.number_blocks(rows, "doc_id", "pos", "kind", "props")
    return numbered.select("doc_id", "pos", long("block_index").alias("block_index"), long("table_index").alias("table_index"), F.col("section_header").alias("section"))


@query(
    "block_struct",
    f"""WITH {_sql_lines(_SQL_MARKED)}, typed AS (SELECT *, {_SQL_TYPE} t FROM paras)
    SELECT doc_id::VARCHAR doc_id, pos::BIGINT block_index, t block_type, 'pdf' doc_type, 1::BIGINT page_number, length(p)::BIGINT n_chars FROM typed""",
)
def block_struct(spark: SparkSession, root: str) -> DataFrame:
    rows = _marked_blocks(spark, root).withColumn("doc_id", F.col("doc_id").cast("string"))
    nested = rows.select(B.block_record().alias("b"))
    return nested.select(
        "b.metadata.doc_id", long("b.metadata.block_index").alias("block_index"), "b.block_type", "b.metadata.doc_type",
        long("b.metadata.page_number").alias("page_number"), long(F.length("b.content")).alias("n_chars"),
    )


def _line_table(text: Column) -> Column:
    """A document as a two-column table: line number and line."""
    head = F.array(F.array(F.lit("line"), F.lit("text")))
    return F.concat(head, F.transform(F.split(text, "\n"), lambda l, i: F.array((i + 1).cast("string"), l)))


_SQL_CELL = f"replace({sql_strip('replace(l, chr(124), chr(92) || chr(124))')}, chr(10), ' ')"
_SQL_TABLE_LINES = f"list_transform(string_split(text, chr(10)), lambda l, i: '| ' || i || ' | ' || {_SQL_CELL} || ' |')"
_SQL_TABLE = f"""'| line | text |' || chr(10) || '| --- | --- |' || chr(10) || array_to_string({_SQL_TABLE_LINES}, chr(10))"""


@query("table_serialize", f"SELECT doc_id, md5({_SQL_TABLE}) digest, length({_SQL_TABLE})::BIGINT n_chars FROM documents")
def table_serialize(spark: SparkSession, root: str) -> DataFrame:
    rows = documents(spark, root).select("doc_id", B.serialize_table(_line_table(F.col("text"))).alias("m"))
    return rows.select("doc_id", F.md5(F.encode("m", "UTF-8")).alias("digest"), long(F.length("m")).alias("n_chars"))


@query(
    "md_table_parse",
    f"""SELECT doc_id, 1 + len(string_split(text, chr(10)))::BIGINT n_rows, 2::BIGINT n_cols,
      4 + 4 + list_sum(list_transform(string_split(text, chr(10)), lambda l, i: length(i::VARCHAR) + length({sql_strip('l')})))::BIGINT cell_chars,
      md5(array_to_string(['line', 'text'] || flatten(list_transform(string_split(text, chr(10)), lambda l, i: [i::VARCHAR, {sql_strip('l')}])), chr(1))) digest
    FROM documents""",
)
def md_table_parse(spark: SparkSession, root: str) -> DataFrame:
    rows = documents(spark, root).select("doc_id", B.parse_markdown_table(B.serialize_table(_line_table(F.col("text")))).alias("t"))
    chars = F.aggregate("t", F.lit(0), lambda n, r: n + F.aggregate(r, F.lit(0), lambda m, c: m + F.length(c)))
    width = F.array_max(F.transform("t", lambda r: F.size(r)))
    return rows.select(
        "doc_id", long(F.size("t")).alias("n_rows"), long(width).alias("n_cols"), long(chars).alias("cell_chars"),
        F.md5(F.encode(F.array_join(F.flatten("t"), "\x01"), "UTF-8")).alias("digest"),
    )


# Greedy cuts in SQL: from each start, the last row whose running size fits.
_SQL_TABLE_CUTS = f"""
WITH RECURSIVE cells AS (
  SELECT doc_id, i, length(i::VARCHAR) + length({_SQL_CELL}) + 8 AS w
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) l, generate_subscripts(string_split(text, chr(10)), 1) i, length({_SQL_TABLE}) // 4 + 1 tokens FROM documents)
  WHERE tokens > 750),
pre AS (SELECT doc_id, i, sum(w) OVER (PARTITION BY doc_id ORDER BY i) s, max(i) OVER (PARTITION BY doc_id) n FROM cells),
cuts(doc_id, lo, hi, base, n) AS (
  SELECT doc_id, 0::BIGINT, 0::BIGINT, 0::HUGEINT, max(n) FROM pre GROUP BY doc_id
  UNION ALL
  SELECT c.doc_id, c.hi + 1, max(p.i), max_by(p.s, p.i), c.n FROM cuts c JOIN pre p ON p.doc_id = c.doc_id
  WHERE c.hi < c.n AND p.i > c.hi AND (p.i = c.hi + 1 OR (29 + p.s - c.base) // 4 + 1 <= 750)
  GROUP BY c.doc_id, c.hi, c.n)
SELECT c.doc_id, (row_number() OVER (PARTITION BY c.doc_id ORDER BY c.lo) - 1)::BIGINT chunk_pos,
  (29 + c.base - coalesce(lag(c.base) OVER (PARTITION BY c.doc_id ORDER BY c.lo), 0))::BIGINT n_chars,
  md5('| line | text |' || chr(10) || '| --- | --- |' || chr(10) || array_to_string({_SQL_TABLE_LINES}[c.lo:c.hi], chr(10))) digest
FROM cuts c JOIN documents USING (doc_id) WHERE c.lo > 0
UNION ALL
SELECT doc_id, 0, length({_SQL_TABLE}), md5({_SQL_TABLE}) FROM documents WHERE length({_SQL_TABLE}) // 4 + 1 <= 750"""


def _with_digest(rows: DataFrame) -> DataFrame:
    digest = F.md5(F.encode("t", "UTF-8"))
    return rows.select("doc_id", long("chunk_pos").alias("chunk_pos"), long(F.length("t")).alias("n_chars"), digest.alias("digest"))


@query("table_split", _SQL_TABLE_CUTS)
def table_split(spark: SparkSession, root: str) -> DataFrame:
    markdown = B.serialize_table(_line_table(F.col("text")))
    rows = unfold(documents(spark, root).select("doc_id", markdown.alias("m")), ["doc_id"], C.table_split(F.col("m")), "t", "chunk_pos")
    return _with_digest(rows)


def _sql_word_cuts(words: str, weight: str, fits: str, size: str, glue: str) -> str:
    """Greedy packing of ``words`` per document by recursive cuts."""
    return f"""
WITH RECURSIVE parts AS (SELECT doc_id, unnest({words}) w, generate_subscripts({words}, 1) i FROM documents),
pre AS (SELECT doc_id, i, sum({weight}) OVER (PARTITION BY doc_id ORDER BY i) s, sum(length(w)) OVER (PARTITION BY doc_id ORDER BY i) c, max(i) OVER (PARTITION BY doc_id) n FROM parts),
cuts(doc_id, lo, hi, base, chars, n) AS (
  SELECT doc_id, 0::BIGINT, 0::BIGINT, 0::HUGEINT, 0::HUGEINT, max(n) FROM pre GROUP BY doc_id
  UNION ALL
  SELECT c.doc_id, c.hi + 1, max(p.i), max_by(p.s, p.i), max_by(p.c, p.i), c.n FROM cuts c JOIN pre p ON p.doc_id = c.doc_id
  WHERE c.hi < c.n AND p.i > c.hi AND (p.i = c.hi + 1 OR {fits})
  GROUP BY c.doc_id, c.hi, c.n)
SELECT doc_id, (row_number() OVER w - 1)::BIGINT chunk_pos, ({size})::BIGINT n_chars,
  md5(array_to_string(({words})[lo:hi], '{glue}')) digest
FROM cuts JOIN documents USING (doc_id) WHERE lo > 0 WINDOW w AS (PARTITION BY doc_id ORDER BY lo)"""


@query(
    "hard_split",
    _sql_word_cuts(
        "string_split(text, ' ')", "(length(w) + 1) // 4 + 1", "p.s - c.base <= 600",
        "chars - coalesce(lag(chars) OVER w, 0) + hi - lo", " ",
    ),
)
def hard_split(spark: SparkSession, root: str) -> DataFrame:
    rows = unfold(documents(spark, root), ["doc_id"], C.hard_split(F.col("text"), 600), "t", "chunk_pos")
    return _with_digest(rows)


@query(
    "greedy_merge",
    _sql_word_cuts(
        "list_filter(string_split(text, '. '), lambda x: x <> '')", "length(w) + 2", "(p.s - c.base - 2) // 4 + 1 <= 600",
        "chars - coalesce(lag(chars) OVER w, 0) + 2 * (hi - lo)", ". ",
    ),
)
def greedy_merge(spark: SparkSession, root: str) -> DataFrame:
    parts = F.array_remove(F.split(F.col("text"), r"\. "), "")
    rows = unfold(documents(spark, root), ["doc_id"], C.greedy_merge(parts, ". ", 600), "t", "chunk_pos")
    return _with_digest(rows)


def _sql_level(level: int, source: str, cond: str, sep: str, weight: str, fits: str, swallow: bool = True) -> str:
    """One pass of the cascade: pieces of ``source`` meeting ``cond`` are cut
    at ``sep`` and packed greedily, the others pass.  Pieces are (k, ord, p).
    ``swallow`` skips empty parts at the start of a pack."""
    start = "CASE WHEN w <> '' THEN i END" if swallow else "i"
    return f"""
p{level} AS (
  SELECT k, ord, unnest(string_split(p, {sep})) w, generate_subscripts(string_split(p, {sep}), 1) i FROM {source} WHERE {cond}),
s{level} AS (
  SELECT k, ord, i, {weight} wt, sum({weight}) OVER x s, max(i) OVER (PARTITION BY k, ord) n,
    min({start}) OVER (PARTITION BY k, ord ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) nxt
  FROM p{level} WINDOW x AS (PARTITION BY k, ord ORDER BY i)),
c{level}(k, ord, lo, hi, n) AS (
  SELECT k, ord, 0::BIGINT, 0::BIGINT, max(n) FROM s{level} GROUP BY k, ord
  UNION ALL
  SELECT c.k, c.ord, b.i, max(e.i), c.n FROM c{level} c JOIN s{level} a ON a.k = c.k AND a.ord = c.ord AND a.i = c.hi + 1
    JOIN s{level} b ON b.k = a.k AND b.ord = a.ord AND b.i = a.nxt
    JOIN s{level} e ON e.k = a.k AND e.ord = a.ord AND e.i >= b.i AND (e.i = b.i OR {fits})
  WHERE c.hi < c.n GROUP BY c.k, c.ord, b.i, c.n),
o{level} AS (
  SELECT k, ord, p FROM {source} WHERE NOT ({cond})
  UNION ALL
  SELECT c.k, list_append(c.ord, c.lo) ord, string_agg(w, {sep} ORDER BY p.i) FROM c{level} c JOIN p{level} p ON p.k = c.k AND p.ord = c.ord AND p.i BETWEEN c.lo AND c.hi
  WHERE c.lo > 0 GROUP BY c.k, c.ord, c.lo)"""


def _sql_cascade(source: str) -> str:
    """All separators, then words.  The result is ``pieces`` (k, pos, p)."""
    seps = ["chr(10) || chr(10)", "chr(10)", "'. '", "'! '", "'? '", "' '"]
    gaps = [2, 1, 2, 2, 2, 1]
    big = "(length(p) // 4 + 1 > 800)"
    levels, last = [], source
    for n, (sep, gap) in enumerate(zip(seps, gaps)):
        fits = f"(e.s - b.s + b.wt - {gap}) // 4 + 1 <= 600"
        levels.append(_sql_level(n, last, f"{big} AND contains(p, {sep})", sep, f"(length(w) + {gap})", fits))
        last = f"o{n}"
    levels.append(_sql_level(6, last, big, "' '", "((length(w) + 1) // 4 + 1)", "e.s - b.s + b.wt <= 600", swallow=False))
    levels.append(f"""
pieces AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY ord) - 1 pos, q.p p FROM (SELECT k, ord, {sql_strip('p')} p FROM o6) q WHERE q.p <> '')""")
    return ",".join(levels)


@query(
    "recursive_chunks",
    f"""WITH RECURSIVE src AS (SELECT doc_id k, []::BIGINT[] ord, text p FROM documents), {_sql_cascade('src')}
    SELECT k doc_id, pos::BIGINT chunk_pos, {sql_token_count('p')}::BIGINT token_count, md5(p) digest FROM pieces""",
)
def recursive_chunks(spark: SparkSession, root: str) -> DataFrame:
    rows = unfold(documents(spark, root), ["doc_id"], C.recursive_split(strip(F.col("text"))), "t", "chunk_pos")
    return rows.select(
        "doc_id", long("chunk_pos").alias("chunk_pos"), long(token_count(F.col("t"))).alias("token_count"), F.md5(F.encode("t", "UTF-8")).alias("digest")
    )


def semantic_chunk_rows(spark: SparkSession, root: str) -> DataFrame:
    return C.chunk_documents(documents(spark, root), "doc_id", B.text_blocks(marked(F.col("text")), every_line=True))


def plain_chunk_rows(spark: SparkSession, root: str) -> DataFrame:
    """Ids, texts and types of the same chunks."""
    return C.plain_chunks(documents(spark, root), "doc_id", B.text_blocks(marked(F.col("text")), every_line=True))


SQL_CHUNKS = f"""WITH RECURSIVE {_sql_lines(_SQL_MARKED)}, typed AS (SELECT *, {_SQL_TYPE} t FROM paras),
blocks AS (SELECT *, last_value(CASE WHEN t = 'heading' THEN p END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) s FROM typed),
src AS (SELECT {{'d': doc_id, 'b': pos}} k, []::BIGINT[] ord, p FROM blocks), {_sql_cascade('src')},
chunks AS (
  SELECT b.doc_id, b.pos block_index, c.pos chunk_index, count(*) OVER (PARTITION BY k) total, t, s, c.p p FROM pieces c JOIN blocks b ON b.doc_id = k.d AND b.pos = k.b),
flagged AS (
  SELECT *, coalesce(t IN ('prose', 'list_item') AND lag(t) OVER w IN ('prose', 'list_item') AND s IS NOT DISTINCT FROM lag(s) OVER w
    AND (length(string_split(lag(p) OVER w, ' ')[-1]) + 1) // 4 + 1 <= 100, false) has_overlap
  FROM chunks WINDOW w AS (PARTITION BY doc_id ORDER BY block_index, chunk_index))"""


@query(
    "semantic_chunks",
    f"""{SQL_CHUNKS} SELECT doc_id || '::' || block_index || '::' || chunk_index chunk_id, md5(p) digest, s section_header, t content_type, total::BIGINT total_chunks,
      has_overlap, {sql_token_count('p')}::BIGINT token_count FROM flagged""",
)
def semantic_chunks(spark: SparkSession, root: str) -> DataFrame:
    return semantic_chunk_rows(spark, root).select(
        "chunk_id", F.md5(F.encode("content", "UTF-8")).alias("digest"), "section_header", "content_type", long("total_chunks").alias("total_chunks"),
        "has_overlap", long("token_count").alias("token_count"),
    )


@query(
    "chunk_struct",
    f"""{SQL_CHUNKS} SELECT doc_id || '::' || block_index || '::' || chunk_index chunk_id, p content, doc_id::VARCHAR doc_id, 'pdf' doc_type, t content_type,
      {sql_token_count('p')}::BIGINT token_count FROM flagged""",
)
def chunk_struct(spark: SparkSession, root: str) -> DataFrame:
    nested = semantic_chunk_rows(spark, root).select(C.chunk_record().alias("r"))
    return nested.select("r.chunk_id", "r.content", "r.metadata.doc_id", "r.metadata.doc_type", "r.metadata.content_type", long("r.metadata.token_count").alias("token_count"))


@query(
    "overlap_flags",
    f"""WITH {_sql_lines(_SQL_MARKED)}, typed AS (SELECT *, {_SQL_TYPE} t FROM paras),
    sec AS (SELECT *, last_value(CASE WHEN t = 'heading' THEN p END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) s FROM typed)
    SELECT doc_id, pos::BIGINT pos, coalesce(t IN ('prose', 'list_item') AND lag(t) OVER w IN ('prose', 'list_item')
      AND s IS NOT DISTINCT FROM lag(s) OVER w, false) eligible
    FROM sec WINDOW w AS (PARTITION BY doc_id ORDER BY pos)""",
)
def overlap_flags(spark: SparkSession, root: str) -> DataFrame:
    blocks = B.text_blocks(marked(F.col("text")), every_line=True)
    named = F.transform(blocks, lambda b: F.struct(b["block_type"].alias("content_type"), b["section_header"].alias("section_header")))
    rows = documents(spark, root).select("doc_id", named.alias("bs"))
    flags = F.transform(
        "bs", lambda b, i: F.coalesce(C.may_overlap(b, F.get(F.col("bs"), i - 1)) & (i > 0), F.lit(False))
    )
    return unfold(rows, ["doc_id"], flags, "eligible", "pos").select("doc_id", long("pos").alias("pos"), "eligible")


@query(
    "overlap_tail",
    f"""WITH {_sql_lines('text')},
    w AS (SELECT doc_id, pos, unnest(string_split(p, ' ')) w, generate_subscripts(string_split(p, ' '), 1) i FROM paras),
    back AS (SELECT *, sum((length(w) + 1) // 4 + 1) OVER (PARTITION BY doc_id, pos ORDER BY i DESC) s FROM w)
    SELECT doc_id, pos::BIGINT pos, coalesce(count(*) FILTER (s <= 100), 0)::BIGINT n_words,
      (coalesce(sum(length(w)) FILTER (s <= 100), 0) + greatest(count(*) FILTER (s <= 100) - 1, 0))::BIGINT n_chars,
      md5(coalesce(string_agg(w, ' ' ORDER BY i) FILTER (s <= 100), '')) digest
    FROM back GROUP BY doc_id, pos""",
)
def overlap_tail(spark: SparkSession, root: str) -> DataFrame:
    paras = B.paragraphs(F.col("text"), every_line=True)
    rows = unfold(documents(spark, root), ["doc_id"], paras, "p", "pos").select("doc_id", "pos", C.overlap_tail(F.col("p")).alias("t"))
    words = F.when(F.col("t") == "", 0).otherwise(F.size(F.split("t", " ")))
    return rows.select("doc_id", long("pos").alias("pos"), long(words).alias("n_words"), long(F.length("t")).alias("n_chars"), F.md5(F.encode("t", "UTF-8")).alias("digest"))


@query("strip_overlap", "SELECT doc_id, md5(text) digest, length(text)::BIGINT n_chars FROM documents")
def strip_overlap(spark: SparkSession, root: str) -> DataFrame:
    joined = F.concat(C.overlap_tail(F.col("text")), F.lit(C.OVERLAP_SENTINEL), F.col("text"))
    rows = documents(spark, root).select("doc_id", C.strip_overlap(joined).alias("t"))
    return rows.select("doc_id", F.md5(F.encode("t", "UTF-8")).alias("digest"), long(F.length("t")).alias("n_chars"))


@query("src_pages", "SELECT page_id, length(html)::BIGINT n_chars, url, md5(html) digest FROM pages")
def src_pages(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "pages").select("page_id", long(F.length("html")).alias("n_chars"), "url", F.md5(F.encode("html", "UTF-8")).alias("digest"))


_SQL_H1 = "regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]*>', '', 'g')"


@query("html_h1", f"SELECT page_id, {sql_strip(_SQL_H1)} title FROM pages")
def html_h1(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "pages").select("page_id", strip(first_heading(F.col("html"))).alias("title"))


@query("html_blocks")
def html_blocks(spark: SparkSession, root: str) -> DataFrame:
    return explode_pages(spread(table(spark, root, "pages")), "page_id", "html")
