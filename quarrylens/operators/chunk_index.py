"""A stored index over chunks: postings in blocks, hashed term vectors, segments.

Layout below ``path``, all of it tables that Spark writes and reads::

    versions/<n>                one row: segments and statistics of version n
    segments/<name>/docs        doc_no, id, content and the columns kept for filters
    segments/<name>/terms       part, term, df (negative for what a segment takes away)
    segments/<name>/blocks      part, term, span, places, tfs, dls, impacts, df and tokens (counts of the block)
    segments/<name>/vectors     doc_no, embedding; not in an index of postings alone
    segments/<name>/gone        doc_no of replaced and deleted chunks of earlier segments

Documents are numbered in the order of their ids.  A block holds the postings of
one term in one span of numbers (see ``span_for``), so no term has a row that
grows with the corpus.  Blocks are laid out by (part, term, span), part being a hash of
the term and a folder: a search opens the folders of its terms only.

The texts of a span meet in one task, which finds their words, once, and makes
its blocks: postings are never rows of their own.  Everything else follows from
the blocks.  Terms and lengths are sums over them, and vectors are made span by
span of the blocks and the weights of their terms: frequent ones, whose number
is bounded, are shipped to every task, all others meet their blocks in a join.

Search is exact and prunes by blocks.  A block's ``impacts`` are its pairs of
frequency and length that no other pair of it beats on both, so the best score a
term can give in a span is known from them at any average length.  Summed over
a query's terms they bound every span; the spans with the best bounds are scored
first, and of the others only those are read whose bound reaches the score of
the k-th hit found so far.

An upsert writes a segment of new chunks and the numbers of those they replace;
earlier segments stay as they are.  Statistics are merged over segments: they
equal those of an index built anew.  ``compact`` builds one segment out of all.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.functions.text import tokenize
from quarrylens.functions.tokens import words_of
from quarrylens.operators import fusion
from quarrylens.operators.dense import dense_topk, dense_topk_by_id
from quarrylens.operators.numbering import is_whole, numbered, settled
from quarrylens.operators.ranking import SCORE_DECIMALS, settle, top_k
from quarrylens.operators.sizing import fetch_by_key, settle_small_side
from quarrylens.operators.sparse_index import B, K1, NEGATIVE_IDF_SHARE, query_terms, raw_idf
from quarrylens.session import shared_dir

# Numbers of one block, unless told otherwise: as many as have some tokens at their mean length and leave some spans.
LEAST_SPAN, MOST_SPAN, TOKENS_A_SPAN, SPANS = 1024, 4096, 1 << 20, 64
# The same bounds of a wide block, for batches of queries that meet nearly every span.
WIDE_SPAN, TOKENS_A_WIDE_SPAN = 1 << 14, 1 << 22
# Folders of terms: a function of the tokens of the first segment; tasks that write one folder.
TOKENS_A_PART, LEAST_PARTS, MOST_PARTS, TASKS_A_PART = 4_000_000, 8, 4096, 8
# By which the tokens of texts are estimated before they are counted; only the layout follows from it.
BYTES_A_TOKEN = 6
# Terms whose weights may be shipped to every task, at most.
FREQUENT_TERMS = 200_000
# Spans of each query that are scored before any is left out.
FIRST_SPANS = 4
DIMENSIONS = 64
# Scores are compared at nine decimals; a bound may fall short by rounding.
SLACK = 1e-8


def slot(term: Column) -> Column:
    """The dimension of a term: a value of its digest."""
    return F.pmod(F.conv(F.substring(F.md5(F.encode(term, "UTF-8")), 1, 4), 16, 10).cast("int"), F.lit(DIMENSIONS))


def sign(term: Column) -> Column:
    return F.when(F.conv(F.substring(F.md5(F.encode(term, "UTF-8")), 5, 1), 16, 10).cast("int") < 8, 1.0).otherwise(-1.0)


def hashed_vectors(counts: DataFrame, key: str, weight: Column) -> DataFrame:
    """(key, embedding) from (key, term, weight): weights are added up, with a sign, in the dimension of their term.

    Rows are placed by key once; both sums need no further exchange.
    """
    rows = counts.select(key, slot(F.col("term")).alias("slot"), (sign(F.col("term")) * weight).alias("value")).repartition(key)
    sums = rows.groupBy(key, "slot").agg(F.sum("value").alias("value"))
    cells = F.map_from_entries(F.collect_list(F.struct("slot", "value")))
    filled = F.transform(F.sequence(F.lit(0), F.lit(DIMENSIONS - 1)), lambda s: F.coalesce(F.element_at("cells", s), F.lit(0.0)))
    return sums.groupBy(key).agg(cells.alias("cells")).select(key, filled.alias("embedding"))


def at_once(spark: SparkSession, *legs: Callable[[], DataFrame]) -> list[DataFrame]:
    """Results of functions that run Spark jobs, in threads that keep the caller's job properties."""
    with ThreadPoolExecutor(len(legs)) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(leg)) for leg in legs]]


@dataclass
class ChunkIndex:
    """One version of a stored index."""

    spark: SparkSession
    path: str
    version: int
    id: str
    parts: int
    segments: list[str]
    next_no: int
    n_docs: int
    n_tokens: int
    n_terms: int
    mean_idf: float
    # Weights of the vectors: segment, size and mean of the last full build.
    base: dict = field(default_factory=dict)
    span: int = 0
    dense: bool = True
    k1: float = K1
    b: float = B

    # Writing ------------------------------------------------------------

    @classmethod
    def build(
        cls, chunks: DataFrame, id: str, text: str, path: str | None = None, keep: list[str] | None = None, span: int | None = None, dense: bool = True, wide: bool = False
    ) -> ChunkIndex:
        """Index every row of ``chunks``; ids are unique.  ``keep`` names columns for filters and hits.

        Without ``dense`` it is an index of postings alone: no vectors are made, and a dense search raises.
        Shorter spans have closer bounds and more rows; by default they follow from the size of the corpus,
        and are up to four times as long in a ``wide`` index, which is cheaper to make.
        """
        spark = chunks.sparkSession
        path = path or f"{shared_dir(spark)}/chunk-index-{uuid.uuid4().hex}"
        # Numbering reads the chunks twice; making them may be costly.
        named = settled(chunks.select(F.col(id), F.col(text).alias("content"), *(keep or [])), "chunks")
        index = cls(spark, path, -1, id, 0, [], 0, 0, 0, 0, 0.0, span=span or 0, dense=dense)
        return index._with_segment(named, None, fresh=True, wide=wide)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> ChunkIndex:
        """The latest version; a missing index raises."""
        rows = spark.read.schema("version int, state string").json(f"{path}/versions/*").orderBy(F.desc("version")).head(1)
        if not rows:
            raise ValueError(f"no index at {path}")
        return cls(spark, path, rows[0]["version"], **json.loads(rows[0]["state"]))

    def upsert(self, chunks: DataFrame, text: str = "content") -> ChunkIndex:
        """The next version, with these chunks instead of those of the same id."""
        docs = self._table("docs")
        others = [c for c in docs.columns if c not in (self.id, "content", "doc_no")]
        fresh = settled(chunks.select(self.id, F.col(text).alias("content"), *others), "upsert")
        return self._with_segment(fresh, fresh.select(self.id))

    def delete(self, ids: DataFrame) -> ChunkIndex:
        """The next version, without the chunks of these ids."""
        return self._with_segment(None, ids.select(self.id).distinct())

    def compact(self) -> ChunkIndex:
        """The next version, with one segment of all live chunks and renewed weights."""
        live = self.docs().drop("doc_no")
        return self._with_segment(live, None, fresh=True)

    def _with_segment(self, chunks: DataFrame | None, replaced: DataFrame | None, fresh: bool = False, wide: bool = False) -> ChunkIndex:
        spark, name = self.spark, uuid.uuid4().hex
        folder = f"{self.path}/segments/{name}"
        segments, first = ([], 0) if fresh else (self.segments, self.next_no)
        gone = None
        if replaced is not None:
            gone = settled(self._live(self._table("docs")).join(replaced, self.id, "left_semi").select("doc_no", "content"), "replaced")
            gone.select("doc_no").write.parquet(f"{folder}/gone")
        docs, added, guess, next_no = None, 0, 0, first
        if chunks is not None:
            numbered(chunks, self.id, "doc_no", first).write.parquet(f"{folder}/docs")
            docs = spark.read.parquet(f"{folder}/docs")
            if docs.groupBy(self.id).count().filter("count > 1").head(1):
                raise ValueError(f"{self.id} is not unique")
            added, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("content").cast("long")), F.lit(0))).first()
            guess = size // BYTES_A_TOKEN
            self.span = self.span or (span_for(added, guess, WIDE_SPAN, TOKENS_A_WIDE_SPAN) if wide else span_for(added, guess))
            next_no = first + -(-added // self.span) * self.span
        taken = (0, 0)
        if gone is not None:
            taken = gone.agg(F.count("*"), F.coalesce(F.sum(F.size(tokenize(F.coalesce("content", F.lit(""))))), F.lit(0))).first()
        n_docs = (0 if fresh else self.n_docs) + added - taken[0]
        if not n_docs:
            raise ValueError("cannot index an empty corpus")
        parts = self.parts if not fresh else min(MOST_PARTS, max(LEAST_PARTS, guess // TOKENS_A_PART))
        n_tokens, blocks = (0 if fresh else self.n_tokens) - taken[1], None
        if docs is not None:
            _write_blocks(folder, parts, self.span, docs)
            blocks = spark.read.parquet(f"{folder}/blocks")
            n_tokens += blocks.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
        self._write_terms(folder, parts, blocks, gone)
        out = ChunkIndex(spark, self.path, self.version + 1, self.id, parts, [*segments, name], next_no, n_docs, n_tokens, 0, 0.0, self.base, self.span, self.dense, self.k1, self.b)
        live = out.terms().agg(F.count("*"), F.avg(raw_idf(F.col("df"), n_docs))).first()
        out.n_terms, out.mean_idf = live[0], live[1] or 0.0
        if fresh:
            out.base = {"segment": name, "n_docs": n_docs, "mean_idf": out.mean_idf, "frequent": frequent_from(out.terms(), FREQUENT_TERMS)}
        if docs is not None and self.dense:
            out._vectors_of(blocks).write.parquet(f"{folder}/vectors")
        state = {k: v for k, v in vars(out).items() if k not in ("spark", "path", "version")}
        row = spark.createDataFrame([(out.version, json.dumps(state))], "version int, state string")
        # A second writer of the same version fails here and has changed nothing.
        row.coalesce(1).write.mode("errorifexists").json(f"{self.path}/versions/{out.version}")
        return out

    @staticmethod
    def _write_terms(folder: str, parts: int, blocks: DataFrame | None, gone: DataFrame | None) -> None:
        changes = []
        if blocks is not None:
            changes.append(blocks.groupBy("term").agg(F.sum("df").alias("df")))
        if gone is not None:
            words = gone.select(F.explode_outer(F.array_distinct(tokenize(F.coalesce("content", F.lit(""))))).alias("term")).filter("term is not null")
            changes.append(words.groupBy("term").agg((-F.count("*")).alias("df")))
        terms = changes[0] if len(changes) == 1 else changes[0].unionByName(changes[1]).groupBy("term").agg(F.sum("df").alias("df"))
        rows = terms.filter("df != 0").select(part_of(F.col("term"), parts).alias("part"), "term", "df")
        rows.repartition("part").sortWithinPartitions("part", "term").write.partitionBy("part").parquet(f"{folder}/terms")

    def _vectors_of(self, blocks: DataFrame) -> DataFrame:
        """(doc_no, embedding) of a segment's chunks that have a token; spans meet in one task each."""
        weights = self._vector_weights(kept=["df"])
        parted = lambda idf: (slot(F.col("term")).alias("slot"), (sign(F.col("term")) * idf).alias("value"))
        shipped = F.broadcast(settled(weights.filter(F.col("df") >= self.base["frequent"]).select("term", *parted(F.col("idf"))), "frequent"))
        blocks = blocks.select("term", "span", "places", "tfs")
        rare = blocks.join(shipped.select("term"), "term", "left_anti").join(weights.filter(F.col("df") < self.base["frequent"]), "term", "left")
        cells = ("span", "slot", "value", "places", "tfs")
        rows = blocks.join(shipped, "term").select(*cells)
        rows = rows.unionByName(rare.select("span", "places", "tfs", *parted(F.coalesce("idf", F.lit(self._unseen())))).select(*cells))
        width = self.span

        def add(cells: pa.Table) -> pa.Table:
            return span_vectors(cells, width)

        return rows.groupBy("span").applyInArrow(add, "doc_no long, embedding array<double>")

    # Reading ------------------------------------------------------------

    def _table(self, name: str) -> DataFrame:
        """A table of all segments that have it."""
        frames = []
        for segment in self.segments:
            if self._has(segment, name):
                frames.append(self.spark.read.parquet(f"{self.path}/segments/{segment}/{name}"))
        out = frames[0]
        for frame in frames[1:]:
            out = out.unionByName(frame)
        return out

    def _has(self, segment: str, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/segments/{segment}/{name}/_SUCCESS")
        return path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(path)

    def _has_gone(self) -> bool:
        return any(self._has(segment, "gone") for segment in self.segments)

    def _live(self, rows: DataFrame) -> DataFrame:
        """Rows by doc_no without those that a later segment took away."""
        if not self._has_gone():
            return rows
        gone, small = settle_small_side(self._table("gone"))
        return rows.join(F.broadcast(gone) if small else gone, "doc_no", "left_anti")

    def docs(self) -> DataFrame:
        """doc_no, id, content and the kept columns of all live chunks."""
        return self._live(self._table("docs"))

    def vectors(self) -> DataFrame:
        if not self.dense:
            raise ValueError(f"no vectors in the index at {self.path}")
        return self._live(self._table("vectors"))

    def terms(self, asked: list[int] | None = None) -> DataFrame:
        """(term, df) over all segments; ``asked`` names the folders to read."""
        rows = self._table("terms")
        rows = rows if asked is None else rows.filter(F.col("part").isin(asked))
        rows = rows.select("term", "df")
        return rows if len(self.segments) == 1 else rows.groupBy("term").agg(F.sum("df").alias("df")).filter("df > 0")

    def __len__(self) -> int:
        return self.n_docs

    def _idf(self, terms: DataFrame, n_docs: int, mean: float, kept: list[str] | None = None) -> DataFrame:
        raw = raw_idf(F.col("df"), n_docs)
        return terms.select("term", *(kept or []), F.when(raw < 0, F.lit(NEGATIVE_IDF_SHARE * mean)).otherwise(raw).alias("idf"))

    def _vector_weights(self, asked: list[int] | None = None, kept: list[str] | None = None) -> DataFrame:
        """Weights as of the last full build, so that vectors of all segments agree."""
        rows = self.spark.read.parquet(f"{self.path}/segments/{self.base['segment']}/terms")
        rows = rows if asked is None else rows.filter(F.col("part").isin(asked))
        return self._idf(rows.select("term", "df"), self.base["n_docs"], self.base["mean_idf"], kept)

    def _unseen(self) -> float:
        return math.log(self.base["n_docs"] + 0.5) - math.log(0.5)

    def _asked(self, queries: DataFrame, query_id: str, query_text: str) -> tuple[DataFrame, bool, list[int] | None]:
        """Query terms, whether they are few, and the folders that hold them."""
        asked, small = settle_small_side(query_terms(queries, query_id, query_text))
        if not small:
            return asked, False, None
        folders = asked.select(part_of(F.col("term"), self.parts).alias("part")).distinct().collect()
        return asked, True, sorted(r["part"] for r in folders)

    # Searching ----------------------------------------------------------

    def bounds(self, blocks: DataFrame, weights: DataFrame) -> DataFrame:
        """(query_id, span, bound): no chunk of the span can score more for the query."""
        best = F.array_max(F.transform("impacts", lambda i: i["tf"] / (i["tf"] + self._norm(i["dl"]))))
        heads = blocks.select("term", "span", "impacts").join(weights, "term")
        return heads.groupBy("query_id", "span").agg(F.sum(F.greatest("weight", F.lit(0.0)) * best).alias("bound")).filter("bound > 0")

    def _norm(self, dl: Column) -> Column:
        return F.lit(self.k1) * (1 - self.b + self.b * dl / F.lit(self.n_tokens / self.n_docs))

    def _scores(self, blocks: DataFrame, weights: DataFrame, few: bool, spans: DataFrame, few_spans: bool, k: int, where: Column | None) -> DataFrame:
        """Scores of the chunks of the given (query_id, span, floor), at least of the best ``k`` of each that reach the floor, if any."""
        if few:
            return self._span_scores(blocks, weights, spans, few_spans, k, where)
        near = F.broadcast(spans) if few_spans else spans
        met = blocks.select("term", "span", "places", "tfs", "dls").join(weights, "term").join(near.select("query_id", "span"), ["query_id", "span"])
        rows = met.select("query_id", "span", "weight", F.explode(F.arrays_zip("places", "tfs", "dls")).alias("p"))
        part = F.col("weight") * F.col("p.tfs") / (F.col("p.tfs") + self._norm(F.col("p.dls")))
        scored = rows.groupBy("query_id", "span", F.col("p.places").alias("place")).agg(F.sum(part).alias("raw"))
        hits = scored.filter("raw > 0").select("query_id", (F.col("span") * self.span + F.col("place")).alias("doc_no"), settle(F.col("raw")).alias("score"))
        hits = self._live(hits)
        return hits if where is None else hits.join(self._table("docs").filter(where).select("doc_no"), "doc_no", "left_semi")

    def _span_scores(self, blocks: DataFrame, weights: DataFrame, spans: DataFrame, few_spans: bool, k: int, where: Column | None) -> DataFrame:
        """As above, with the weights in every task: a span's blocks meet once, whatever the number of queries.

        A group is one span: a block for each asked term in it, the queries that
        ask for it, and, if only some chunks count, the places of these.  Blocks of
        other terms, most of those in the opened folders, stay where they are.
        Hits below a query's ``floor`` are left out.
        """
        shipped = self.spark.sparkContext.broadcast((uuid.uuid4().hex, weights.select("query_id", "term", "weight").toArrow()))
        kind = weights.schema["query_id"].dataType.simpleString()
        wanted = spans.select("span").distinct()
        asked = blocks.select("term", "span", "places", "tfs", "dls").join(F.broadcast(weights.select("term").distinct()), "term", "left_semi")
        found = asked.join(F.broadcast(wanted) if few_spans else wanted, "span", "left_semi")
        asking = spans.select("span", "query_id", "floor", F.lit(None).cast("array<int>").alias("only"))
        limited = where is not None or self._has_gone()
        if limited:
            docs = self._table("docs") if where is None else self._table("docs").filter(where)
            places = self._live(docs.select("doc_no")).groupBy(F.floor(F.col("doc_no") / self.span).alias("span")).agg(F.collect_list(F.pmod("doc_no", F.lit(self.span)).cast("int")).alias("only"))
            asking = asking.unionByName(places.select("span", F.lit(None).cast(kind).alias("query_id"), F.lit(None).cast("double").alias("floor"), "only"))
        width, mean, k1, b = self.span, self.n_tokens / self.n_docs, self.k1, self.b

        def score(block: pa.Table, asks: pa.Table) -> pa.Table:
            return span_hits(block, asks, _by_query(shipped), width, lambda dl: k1 * (1 - b + b * dl / mean), limited, k)

        return found.groupBy("span").cogroup(asking.groupBy("span")).applyInArrow(score, f"query_id {kind}, doc_no long, score double")

    def sparse_topk(
        self, queries: DataFrame, query_id: str, query_text: str, k: int = 25, where: Column | None = None, report: dict | None = None
    ) -> DataFrame:
        """Best ``k`` chunks of every query by BM25: query_id, doc_no, score, rank.

        ``report`` receives the numbers of (query, span) meetings that were bounded and scored.
        """
        asked, small, folders = self._asked(queries, query_id, query_text)
        marked = lambda side, few: F.broadcast(side) if few else side
        weighted = self._idf(self.terms(folders), self.n_docs, self.mean_idf).join(marked(asked, small), "term")
        weights, few = settle_small_side(weighted.select("term", "query_id", (F.col("qtf") * F.col("idf") * (self.k1 + 1)).alias("weight")))
        blocks = self._table("blocks")
        blocks = blocks if folders is None else blocks.filter(F.col("part").isin(folders))

        bounds = settled(self.bounds(blocks, marked(weights, few)), "bounds")
        order = [F.desc("score"), F.asc("doc_no")]
        first = top_k(bounds, ["query_id"], [F.desc("bound"), F.asc("span")], FIRST_SPANS).select("query_id", "span", F.lit(True).alias("done"), F.lit(None).cast("double").alias("floor"))
        first, first_few = settle_small_side(first)
        found = settled(top_k(self._scores(blocks, weights, few, first, first_few, k, where), ["query_id"], order, k), "first-hits")
        floors = found.filter(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
        open_spans = bounds.join(marked(first.drop("floor"), first_few), ["query_id", "span"], "left").filter("done is null").join(floors, "query_id", "left")
        rest, rest_few = settle_small_side(open_spans.filter(F.col("floor").isNull() | (F.col("bound") + SLACK >= F.col("floor"))).select("query_id", "span", "floor"))
        if report is not None:
            report |= {"bounded": bounds.count(), "scored": first.count() + rest.count(), "folders": None if folders is None else len(folders)}
        others = self._scores(blocks, weights, few, rest, rest_few, k, where)
        return top_k(found.select("query_id", "doc_no", "score").unionByName(others), ["query_id"], order, k)

    def query_vectors(self, queries: DataFrame, query_id: str, query_text: str) -> DataFrame:
        """(query_id, embedding) of query texts; a query without a known term has none."""
        asked, small, folders = self._asked(queries, query_id, query_text)
        known = self._vector_weights(folders).join(F.broadcast(asked) if small else asked, "term")
        return hashed_vectors(known, "query_id", F.col("qtf") * F.col("idf"))

    def dense_topk(self, queries: DataFrame, query_id: str, query_text: str, k: int = 25, where: Column | None = None) -> DataFrame:
        """Best ``k`` chunks of every query by the cosine of hashed term vectors: query_id, doc_no, score, rank."""
        asked = self.query_vectors(queries, query_id, query_text)
        vectors = self.vectors()
        if where is not None:
            vectors = vectors.join(self._table("docs").filter(where).select("doc_no"), "doc_no", "left_semi")
        near = dense_topk if is_whole(asked, "query_id") else dense_topk_by_id
        if near is dense_topk:
            asked = asked.withColumn("query_id", F.col("query_id").cast("long"))
        hits = near(vectors.select(F.col("doc_no").alias("vec_id"), "embedding"), asked, k)
        return hits.select("query_id", F.col("vec_id").alias("doc_no"), "score", "rank")

    def fused(self, queries: DataFrame, query_id: str, query_text: str, k: int = fusion.CANDIDATES, where: Column | None = None) -> DataFrame:
        """Both legs, searched at the same time, and their fusion; doc_id is the chunk's number."""

        def leg(search: Callable[..., DataFrame]) -> Callable[[], DataFrame]:
            return lambda: settled(search(queries, query_id, query_text, k, where).select("query_id", F.col("doc_no").alias("doc_id"), "rank"), "leg")

        return fusion.rrf_fuse(*at_once(self.spark, leg(self.dense_topk), leg(self.sparse_topk)), k)

    def hybrid(
        self, queries: DataFrame, query_id: str, query_text: str, top_k_retrieve: int = fusion.CANDIDATES, top_k_rerank: int = fusion.FINAL_K,
        scorer: str | fusion.Scorer = "lexical", where: Column | None = None,
    ) -> DataFrame:
        """Dense and sparse search, fusion and rerank; the hits have their chunk's id and columns."""
        best = self.fused(queries, query_id, query_text, top_k_retrieve, where)
        asked = queries.select(F.col(query_id).alias("query_id"), F.col(query_text).alias("query"))
        docs = self._table("docs")
        own = F.struct(*[c for c in docs.columns if c not in ("doc_no", "content")])
        docs = docs.select(F.col("doc_no").alias("doc_id"), "content", own.alias("chunk"))
        hits = fusion.rerank(best, asked, docs, top_k_rerank, scorer)
        return hits.select("chunk.*", *[c for c in hits.columns if c not in ("chunk", "doc_id")])

    def named(self, hits: DataFrame, columns: list[str] | None = None) -> DataFrame:
        """Hits by doc_no with their chunk's id and the given columns; only the hits' rows are fetched."""
        docs = self._table("docs").select("doc_no", self.id, *(columns or []))
        return fetch_by_key(hits, docs, "doc_no").drop("doc_no")


_WEIGHTS: dict[str, dict] = {}


def _by_query(shipped: Broadcast) -> dict[object, tuple[list[str], list[float]]]:
    """Terms and weights of each query, laid out once in a Python worker."""
    key, table = shipped.value
    if key not in _WEIGHTS:
        _WEIGHTS.clear()
        out: dict[object, tuple[list[str], list[float]]] = {}
        for query, term, weight in zip(*(table.column(c).to_pylist() for c in ("query_id", "term", "weight"))):
            terms, weights = out.setdefault(query, ([], []))
            terms.append(term)
            weights.append(weight)
        _WEIGHTS[key] = out
    return _WEIGHTS[key]


def span_hits(
    block: pa.Table, asks: pa.Table, queries: dict, width: int, norm: Callable[[np.ndarray], np.ndarray], limited: bool, k: int
) -> pa.Table:
    """The best ``k`` of one span, not below the floor, for each of the queries that ask for it; ties go to the smaller place."""
    schema = pa.schema([asks.schema.field("query_id"), ("doc_no", pa.int64()), ("score", pa.float64())])
    if not block.num_rows:
        return schema.empty_table()
    flat = lambda name: block.column(name).combine_chunks().flatten().to_numpy()
    places, tfs = flat("places"), flat("tfs")
    impacts = tfs / (tfs + norm(flat("dls")))
    ends = np.cumsum(pc.list_value_length(block.column("places")).to_numpy())
    rows = {term: (a, b) for term, a, b in zip(block.column("term").to_pylist(), [0, *ends[:-1].tolist()], ends.tolist())}
    counts = np.full(width, not limited)
    if limited:
        for only in asks.column("only").to_pylist():
            counts[only or []] = True
    span = int(block.column("span")[0].as_py())
    ids, at, scores = [], [], []
    for query, floor in zip(asks.column("query_id").to_pylist(), asks.column("floor").to_pylist()):
        if query is None:
            continue
        met = [(*rows[t], w) for t, w in zip(*queries[query]) if t in rows]
        if not met:
            continue
        where = np.concatenate([places[a:b] for a, b, _ in met])
        raw = np.bincount(where, np.concatenate([impacts[a:b] * w for a, b, w in met]), width)
        least = 0.0 if floor is None else floor - SLACK
        hits = np.flatnonzero((raw > max(least, 0.0)) & counts)
        if len(hits) > k:
            # Only what may tie with the k-th is put in order.
            hits = hits[raw[hits] >= np.partition(raw[hits], len(hits) - k)[len(hits) - k] - SLACK]
        score = np.round(raw[hits], SCORE_DECIMALS)
        best = np.lexsort((hits, -score))[:k]
        ids += [query] * len(best)
        at.append(hits[best] + span * width)
        scores.append(score[best])
    if not ids:
        return schema.empty_table()
    return pa.table([pa.array(ids, schema.field(0).type), pa.array(np.concatenate(at)), pa.array(np.concatenate(scores))], schema=schema)


def span_for(n_docs: int, n_tokens: int, longest: int = MOST_SPAN, tokens: int = TOKENS_A_SPAN) -> int:
    """Numbers of one block: a power of two, larger for many short documents, bounded in tokens."""
    most = min(longest, n_docs // SPANS, tokens * n_docs // max(1, n_tokens))
    return max(LEAST_SPAN, 1 << max(0, most.bit_length() - 1))


def frequent_from(terms: DataFrame, most: int) -> int:
    """A document frequency, 2 at least, that at most ``most`` terms reach; steps of a quarter octave are counted."""
    steps = terms.groupBy(F.floor(4 * F.log2("df")).alias("step")).count().collect()
    held = 0
    for row in sorted(steps, key=lambda r: -r["step"]):
        held += row["count"]
        if held > most:
            return max(2, math.ceil(2 ** ((row["step"] + 1) / 4)))
    return 2


def part_of(term: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(parts)).cast("int")


def _write_blocks(folder: str, parts: int, span: int, docs: DataFrame) -> None:
    """Postings as one row for each term and span, laid out by part, term and span."""

    def make(texts: pa.Table) -> pa.Table:
        return span_blocks(texts, span)

    kind = "term string, span long, places array<int>, tfs array<int>, dls array<int>, impacts array<struct<tf:int,dl:int>>, df long, tokens long"
    texts = docs.select(F.floor(F.col("doc_no") / span).alias("span"), "doc_no", F.lower("content").alias("text"))
    blocks = texts.groupBy("span").applyInArrow(make, kind)
    # A frequent term spreads over tasks.
    dealt = blocks.withColumn("part", part_of(F.col("term"), parts)).repartition("part", F.pmod("span", F.lit(TASKS_A_PART)))
    dealt.sortWithinPartitions("part", "term", "span").write.partitionBy("part").parquet(f"{folder}/blocks")


def span_blocks(texts: pa.Table, width: int) -> pa.Table:
    """The blocks of one span from the lower-cased texts of its documents."""
    words, lengths = words_of(texts.column("text"))
    words = words.dictionary_encode()
    terms, codes = words.dictionary.cast(pa.string()), words.indices.to_numpy()
    numbers = texts.column("doc_no").to_numpy()
    at = numbers % width
    cells, tfs = np.unique(codes.astype(np.int64) * width + np.repeat(at, lengths), return_counts=True)
    term, places = np.divmod(cells, width)
    length_at = np.zeros(width, np.int64)
    length_at[at] = lengths
    dls = length_at[places]
    # The shortest document of each frequency, where no higher frequency has a shorter one.
    order = np.lexsort((dls, -tfs, term))
    falling = dls[order] - term[order] * (int(dls.max(initial=0)) + 1)
    least = np.minimum.accumulate(falling)
    best = order[np.append(True, falling[1:] < least[:-1])[: len(order)]]
    ends = lambda of: pa.array(np.searchsorted(of, np.arange(len(terms) + 1)), pa.int32())
    count = lambda held=None: pa.array(np.bincount(term, held, len(terms)).astype(np.int64))
    ints = lambda values: pa.array(values, pa.int32())
    lists = [pa.ListArray.from_arrays(ends(term), ints(values)) for values in (places, tfs, dls)]
    pairs = pa.StructArray.from_arrays([ints(tfs[best]), ints(dls[best])], ["tf", "dl"])
    span = pa.array(np.full(len(terms), numbers[0] // width), pa.int64())
    columns = [terms, span, *lists, pa.ListArray.from_arrays(ends(term[best]), pairs), count(), count(tfs)]
    return pa.table(columns, ["term", "span", "places", "tfs", "dls", "impacts", "df", "tokens"])


def span_vectors(cells: pa.Table, width: int) -> pa.Table:
    """Vectors of one span from its blocks, each with the dimension and the signed weight of its term."""
    flat = lambda name: cells.column(name).combine_chunks().flatten().to_numpy()
    counts = pc.list_value_length(cells.column("places")).to_numpy()
    slots, values = (np.repeat(cells.column(c).to_numpy(), counts) for c in ("slot", "value"))
    places = flat("places").astype(np.int64)
    # Without a cell, bincount returns whole numbers.
    sums = np.bincount(places * DIMENSIONS + slots, flat("tfs") * values, width * DIMENSIONS).astype(np.float64).reshape(width, DIMENSIONS)
    some = np.unique(places)
    vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1) * DIMENSIONS, pa.int32()), pa.array(sums[some].ravel()))
    return pa.table([pa.array(cells.column("span")[0].as_py() * width + some), vectors], ["doc_no", "embedding"])
