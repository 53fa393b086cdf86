"""Scores of texts under a hierarchical Pitman-Yor model of word pairs.

Every context, a frequent word or one of two shared ones (a rare word, the
start of a text), is a restaurant whose dishes are the next symbols; all
restaurants share one parent over symbols, which falls back on the uniform
distribution.  Symbols are the frequent words, the end of a text, and one for
all rare words, whose own share follows their counts.  A word is frequent when
it makes up at least ``FREQUENT`` of the training tokens, so there are at most
1 / FREQUENT of them whatever the corpus.  All counts cover all training texts.

Seating is sampled by Gibbs in rounds, each a sweep over all customers of all
pairs.  The driver draws the parent's probabilities and, for every context, a
gamma variable of its number of tables; given these, the pairs are independent,
whatever shard they lie in, and each draws its number of tables from its exact
conditional, in which the seats of all its customers are summed out.  So a
round needs no seats of the round before, only the table counts of contexts and
dishes, added up over all shards.  The first ``BURN_IN`` rounds are dropped; the
predictive probability of a pair is the mean over the samples of the others.

Data moves in blocks of numbers: a task sends each shard the pairs of its
documents, sorted and written as differences, and gets sums for each document
back.  A frequent context is spread over shards by dish, so no shard holds more
than its share of the distinct pairs, and a pair's own occurrences arrive as
one entry for each document.

A null or empty text has its end token alone.  Rows are scored one by one;
rows that repeat a doc_id are scored each, and train each.  A null doc_id
counts as held out.  Without training texts all probabilities are those of
the unseen.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.llm.minhash_dedup import _runs
from quarrylens.llm.shared import settle, tasks
from quarrylens.llm.shingles import joined, mixed, slices, word_hashes

FREQUENT = 2.0**-20
SMOOTH = 0.1
STRENGTH = 1.0
ROOT_DISCOUNT, ROOT_STRENGTH = 0.5, 1.0
# Rounds, those of them that are dropped, and sweeps in a round: one, as what is
# drawn for it holds for all shards.
ROUNDS, BURN_IN, STEPS = 10, 6, 1
# Customers up to which the laws of table numbers are listed.
LISTED = 1024
# Numbers of tables whose chances are held at a time.
CELLS = 1 << 16
# Points of an integral.
NODES = 32
# Documents and bytes of text of a block, and bytes of text for each shard.
TEXTS, TEXT_BYTES = 8192, 4 << 20
SHARD_BYTES = 16 << 20
# Bytes of rows handed to Python together.
BATCH_BYTES = 2 << 20
# Rare words are fewer than pairs; their shards are larger by this factor.
RARE_SHARE = 8
END = np.uint64(0x9D5C7A1E33F04B27)
_WORD_BITS = np.uint64(21)
_WORD_MASK = np.uint64((1 << 21) - 1)


def packed(values: np.ndarray) -> bytes:
    """Ascending 64-bit integers as differences, byte planes apart, so that they compress."""
    steps = np.diff(values.astype(np.uint64), prepend=np.uint64(0))
    return steps.view(np.uint8).reshape(-1, 8).T.tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def packed_counts(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values.astype("<u4")).view(np.uint8).reshape(-1, 4).T.tobytes()


def unpacked_counts(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with their summed counts."""
    key = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
    count = np.concatenate(counts) if counts else np.zeros(0, np.int64)
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(count, first) if len(key) else count


def text_tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of texts, an end after each, and where each text begins."""
    raw, offsets = joined(texts)
    starts, words = word_hashes(raw)
    bounds = np.searchsorted(starts, offsets)
    ends = bounds[1:] + np.arange(len(texts))
    tokens = np.full(len(words) + len(texts), END, dtype=np.uint64)
    plain = np.ones(len(tokens), dtype=bool)
    plain[ends] = False
    tokens[plain] = words
    return tokens, bounds + np.arange(len(texts) + 1)


@dataclass(frozen=True)
class Symbols:
    """Frequent words in hash order, with what all tasks need to know of the corpus."""

    words: np.ndarray
    counts: np.ndarray
    tokens: int
    distinct: int
    rare_tokens: int
    rare_distinct: int

    @property
    def rare(self) -> int:
        return len(self.words)

    @property
    def start(self) -> int:
        return len(self.words) + 1

    def numbers(self, tokens: np.ndarray) -> np.ndarray:
        """Symbol of every token; the rare one for all words not listed."""
        if not len(self.words):
            return np.zeros(len(tokens), np.int64)
        at = np.minimum(np.searchsorted(self.words, tokens), len(self.words) - 1)
        return np.where(self.words[at] == tokens, at, self.rare)

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + SMOOTH) / (self.tokens + SMOOTH * (self.distinct + 1)))

    def among_rare(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + SMOOTH) / (self.rare_tokens + SMOOTH * (self.rare_distinct + 1)))


@dataclass
class Root:
    """The parent restaurant over symbols in one sample."""

    tables: np.ndarray  # tables of each context
    customers: np.ndarray  # of each dish: the tables of all contexts
    prob: np.ndarray
    # Drawn for the next sweep, the same for all shards.
    base: np.ndarray | None = None  # the parent's probabilities
    mass: np.ndarray | None = None  # of each context
    own: np.ndarray | None = None  # the parent's own tables of each dish


def context_mass(tables: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Gamma variables that make the dishes of a context independent.

    The product of STRENGTH + discount * k over k tables is a moment of them.
    """
    return rng.gamma(STRENGTH / discount + tables)


def root_of(tables: np.ndarray, customers: np.ndarray, discount: float, rng: np.random.Generator, before: np.ndarray | None = None) -> Root:
    """Seats the parent's customers, and returns its predictive probabilities and what the next sweep needs.

    ``before`` holds the parent's own tables of the round before.  They are
    drawn like those of any context; the base is uniform.
    """
    n = max(1, len(customers) - 1)  # the start of a text is never a dish
    own = np.minimum(customers, 1) if before is None else before
    rate = ROOT_DISCOUNT * rng.gamma(ROOT_STRENGTH / ROOT_DISCOUNT + own.sum()) / n
    own = drawn_tables(customers.astype(np.int64), np.full(len(customers), rate), ROOT_DISCOUNT, rng)
    mass = (ROOT_STRENGTH + ROOT_DISCOUNT * own.sum()) / n
    weights = customers - ROOT_DISCOUNT * own + mass
    prob = weights / (ROOT_STRENGTH + customers.sum())
    prob[-1] = 0.0
    base = rng.gamma(weights)
    base /= base.sum()
    return Root(tables.astype(np.float64), customers.astype(np.float64), prob, base, context_mass(tables, discount, rng), own)


@lru_cache(maxsize=4)
def listed_ways(discount: float) -> np.ndarray:
    """Logs of the generalized Stirling numbers: all seatings of c customers at t tables, each by its weight."""
    ways = np.full((LISTED + 1, LISTED + 1), -np.inf)
    ways[1, 1] = 0.0
    t = np.arange(1, LISTED + 1)
    for c in range(1, LISTED):
        ways[c + 1, 1 : c + 2] = np.logaddexp(ways[c, : c + 1], np.log(np.maximum(c - discount * t[: c + 1], 1e-300)) + ways[c, 1 : c + 2])
    return ways


def _picked(logs: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A position in each row, by logs of weights."""
    chances = np.exp(logs - logs.max(axis=1, keepdims=True)).cumsum(axis=1)
    return (chances < rng.random((len(logs), 1)) * chances[:, -1:]).sum(axis=1)


def _solved(rising, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Where conditions that hold for small positive arguments end, by bisection of the logs."""
    low, high = np.log(low), np.log(high)
    for _ in range(60):
        middle = (low + high) / 2
        holds = rising(np.exp(middle))
        low, high = np.where(holds, middle, low), np.where(holds, high, middle)
    return np.exp(low)


def likely_tables(counts: np.ndarray, rates: np.ndarray, discount: float) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the numbers of tables of large pairs: eight deviations around the likeliest, and 16 more."""
    c, full = counts.astype(np.float64), np.full(len(counts), 60.0)

    def steep(v: np.ndarray) -> np.ndarray:
        return np.log(rates * discount) + (discount - 1) * np.log(-np.expm1(-v)) - v > np.log(c)

    # Rates so low that no such point can be told from 0 have few tables.
    v = _solved(steep, np.full(len(c), 1e-300), full)
    middle = np.minimum(rates * (1 - (-np.expm1(-v)) ** discount), c)
    spread = 8 * np.sqrt(middle) + 16
    return np.maximum(1, np.floor(middle - spread)).astype(np.int64), np.minimum(c, np.ceil(middle + spread)).astype(np.int64)


def log_sums(c: np.ndarray, n: np.ndarray, discount: float) -> np.ndarray:
    """Logs of the chances that n Sibuya numbers add up to c, for large c.

    Their generating function is 1 - (1 - x)**discount; times c! / (n! *
    discount**n) these are the numbers of ``listed_ways``.  The coefficient is
    integrated through the saddle point, along a parabola around the cut where
    the point is near it, else along a circle.
    """
    c, n = c.astype(np.float64), n.astype(np.float64)

    def steep(v: np.ndarray) -> np.ndarray:
        z = -np.expm1(-v)
        return n * discount * np.exp(-v + (discount - 1) * np.log(z)) > c * (1 - z**discount)

    v = np.clip(_solved(steep, 1e-9 / c, np.full(len(n), 60.0)), 2.0 / c, 8.0)
    log_one = lambda v: n * np.log1p(-((-np.expm1(-v)) ** discount))
    bend = np.maximum(log_one(1.001 * v) - 2 * log_one(v) + log_one(0.999 * v), 1e-30) / (1e-3 * v) ** 2
    near, circle = v < 0.5, np.minimum(np.pi, 9 / np.sqrt(bend))
    reach = np.where(near, np.where(c * v > 20, np.sqrt(60 / (c * v)), 1.5 * np.sqrt(1 + 37 / (c * v))), circle)
    x = reach[:, None] * np.linspace(0, 1, NODES)
    step = np.where(near[:, None], 2 * v[:, None] * (1 + 1j * x), 1.0)
    at = np.where(near[:, None], v[:, None] * (1 + 1j * x) ** 2, v[:, None] + 1j * x)
    logs = c[:, None] * at + n[:, None] * np.log(1 - (1 - np.exp(-at)) ** discount)
    top = logs.real.max(axis=1)
    values = (np.exp(logs - top[:, None]) * step).real
    values[:, [0, -1]] /= 2
    return top + np.log(np.maximum(values.sum(axis=1) * x[:, 1] / np.pi, 1e-300))


def log_weights(c: np.ndarray, n: np.ndarray, rates: np.ndarray, discount: float) -> np.ndarray:
    """Logs of the weights of n tables, but for what depends on c alone; rates are over the discount."""
    sums = [log_sums(c[k : k + CELLS // NODES], n[k : k + CELLS // NODES], discount) for k in range(0, len(n), CELLS // NODES)]
    factorials = np.array([math.lgamma(x + 1) for x in n.tolist()])
    return n * np.log(np.maximum(rates, 1e-300)) - factorials + np.concatenate(sums)


def drawn_tables(counts: np.ndarray, rates: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Numbers of tables of pairs, by rates**t times the ways to seat their customers at t tables."""
    tables = np.minimum(counts, 1).astype(np.int64)
    log_rates = np.log(np.maximum(rates, 1e-300))
    ways = listed_ways(discount)
    some = np.flatnonzero((counts > 1) & (counts <= LISTED))
    some = some[np.argsort(counts[some], kind="stable")]
    cuts = np.flatnonzero(np.diff(counts[some], prepend=-1)).tolist()
    for a, b in zip(cuts, [*cuts[1:], len(some)]):
        c = int(counts[some[a]])
        for k in range(a, b, max(1, CELLS // c)):
            part = some[k : min(b, k + max(1, CELLS // c))]
            tables[part] = 1 + _picked(log_rates[part][:, None] * np.arange(1, c + 1) + ways[c, 1 : c + 1], rng)
    # The rest have a window of numbers around the likeliest one each.
    big = np.flatnonzero(counts > LISTED)
    if not len(big):
        return tables
    low, high = likely_tables(counts[big], rates[big] / discount, discount)
    order = np.argsort(high - low, kind="stable")
    rows = CELLS // NODES
    done = 0
    while done < len(order):
        widths = (high - low + 1)[order[done : done + rows]]
        part = order[done : done + max(1, int((widths * np.arange(1, len(widths) + 1) <= rows).sum()))]
        n = low[part][:, None] + np.arange((high - low)[part].max() + 1)
        logs = np.full(n.shape, -np.inf)
        used = n <= high[part][:, None]
        of = np.broadcast_to(big[part][:, None], n.shape)[used]
        logs[used] = log_weights(counts[of], n[used], rates[of] / discount, discount)
        tables[big[part]] = low[part] + _picked(logs, rng)
        done += len(part)
    return tables


def seat_pairs(pairs: np.ndarray, counts: np.ndarray, start: np.ndarray, root: Root, discount: float, steps: int, seed: list[int]) -> np.ndarray:
    """Numbers of tables of all pairs after ``steps`` Gibbs sweeps.

    ``start`` holds the numbers of tables that ``root`` counts for them.  The
    first sweep uses what was drawn for all shards; further ones draw the mass
    of contexts anew, by this shard's own moves.
    """
    rng = np.random.default_rng(seed)
    tables = start.astype(np.int64)
    context, dish = (pairs >> _WORD_BITS).astype(np.int64), (pairs & _WORD_MASK).astype(np.int64)
    parent = np.maximum(root.prob if root.base is None else root.base, 1e-12)
    held = root.tables.astype(np.float64)
    for step in range(steps):
        mass = root.mass if step == 0 and root.mass is not None else context_mass(held, discount, rng)
        after = drawn_tables(counts, discount * mass[context] * parent[dish], discount, rng)
        if step + 1 < steps:
            held = held + np.bincount(context, weights=after - tables, minlength=len(held))
        tables = after
    return tables


def _dealt(keys: np.ndarray, shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Positions of the keys of each shard, in key order."""
    order = np.lexsort((keys, shard))
    cuts = np.flatnonzero(np.diff(shard[order], prepend=-1))
    for k, a in enumerate(cuts.tolist()):
        b = cuts[k + 1] if k + 1 < len(cuts) else len(order)
        yield int(shard[order[a]]), order[a:b]


def _counted_words(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 0, TEXTS, TEXT_BYTES):
            tokens, _ = text_tokens(batch.column(0).to_pylist())
            words, counts = np.unique(tokens, return_counts=True)
            rows = [(s, packed(words[i]), packed_counts(counts[i])) for s, i in _dealt(words, (mixed(words) % np.uint64(shards)).astype(np.int64))]
            yield _rows(rows, [pa.int32(), pa.binary(), pa.binary()], ["shard", "keys", "counts"])

    return run


def parts_of(spark: SparkSession, shards: int) -> int:
    """Partitions of a shuffle by shard, two for each: they follow the bytes of text and are not merged again."""
    return max(tasks(spark), 2 * shards)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Rows that hold large blocks reach Python a few at a time."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def _each(batch: pa.RecordBatch) -> Iterator[dict]:
    """Rows one at a time: they hold large blocks."""
    for k in range(batch.num_rows):
        yield batch.slice(k, 1).to_pylist()[0]


def _rows(rows: list[tuple], types: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)


def _merge_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each shard with all its distinct keys."""
    for run in _runs(batches, 1):
        keys, counts = merged([unpacked(x) for x in run.column("keys").to_pylist()], [unpacked_counts(x) for x in run.column("counts").to_pylist()])
        row = (run.column("shard")[0].as_py(), packed(keys), packed_counts(counts), len(keys), int(counts.sum()))
        yield _rows([row], [pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64()], ["shard", "keys", "counts", "distinct", "total"])


_SENT = "shard int, keys binary, counts binary"
_HELD = "shard int, keys binary, counts binary, distinct long, total long"


def _gathered(sent: DataFrame, label: str, shards: int) -> DataFrame:
    return settle(sent.repartition(parts_of(sent.sparkSession, shards), "shard").sortWithinPartitions("shard").mapInArrow(_merge_shards, _HELD), label)


def frequent_words(unigrams: DataFrame, share: float = FREQUENT) -> Symbols:
    """The symbols of a corpus; at most 1 / share words reach the driver."""
    total, distinct = unigrams.agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()
    least = max(1, int(np.ceil(total * share)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words, n = unpacked(keys), unpacked_counts(counts)
                kept = (n >= least) | (words == END)
                yield _rows([(packed(words[kept]), n[kept].astype("<i8").tobytes())], [pa.binary(), pa.binary()], ["keys", "counts"])

    rows = unigrams.select("keys", "counts").mapInArrow(run, "keys binary, counts binary").collect()
    words = np.concatenate([np.zeros(0, np.uint64), *[unpacked(bytes(r.keys)) for r in rows]])
    counts = np.concatenate([np.zeros(0, np.int64), *[np.frombuffer(bytes(r.counts), "<i8") for r in rows]])
    order = np.argsort(words)
    return Symbols(words[order], counts[order], total, distinct, total - int(counts.sum()), distinct - len(words))


def text_pairs(texts: list[str | None], symbols: Symbols) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens, their symbols, the pairs with their contexts, and where texts begin."""
    tokens, bounds = text_tokens(texts)
    number = symbols.numbers(tokens)
    context = np.concatenate(([symbols.start], number[:-1])) if len(number) else number
    context[bounds[:-1]] = symbols.start
    return tokens, number, (context.astype(np.uint64) << _WORD_BITS) | number.astype(np.uint64), bounds


def pair_shards(pairs: np.ndarray, shards: int) -> np.ndarray:
    """Pairs of one context and a stretch of dishes stay together."""
    return (mixed(pairs >> np.uint64(9)) % np.uint64(shards)).astype(np.int64)


def _counted_pairs(symbols, shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 0, TEXTS, TEXT_BYTES):
            pairs, counts = np.unique(text_pairs(batch.column(0).to_pylist(), symbols.value)[2], return_counts=True)
            rows = [(s, packed(pairs[i]), packed_counts(counts[i])) for s, i in _dealt(pairs, pair_shards(pairs, shards))]
            yield _rows(rows, [pa.int32(), pa.binary(), pa.binary()], ["shard", "keys", "counts"])

    return run


def _parts(total: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Equal stretches of flat sums that hold more than zeros."""
    flat, stretch = total.ravel(), 1 << 13
    for k in range(0, len(flat), stretch):
        if flat[k : k + stretch].any() or not k:
            yield k // stretch, flat[k : k + stretch].tobytes()


def _ends(pairs: np.ndarray) -> list[np.ndarray]:
    return [(pairs >> _WORD_BITS).astype(np.int64), (pairs & _WORD_MASK).astype(np.int64)]


def _added(parts: DataFrame, shape: tuple[int, ...]) -> np.ndarray:
    """Sums of (part, values) of all tasks.

    Equal stretches of symbols are added up.  The result, a few numbers for
    each of at most 1 / FREQUENT symbols, reaches the driver.
    """

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _runs(batches, 1):
            values = np.sum([np.frombuffer(x, np.float64) for x in run.column("values").to_pylist()], axis=0)
            yield _rows([(run.column("part")[0].as_py(), values.tobytes())], [pa.int32(), pa.binary()], ["part", "values"])

    total = np.zeros(int(np.prod(shape)))
    for row in parts.repartition("part").sortWithinPartitions("part").mapInArrow(join, "part int, values binary").collect():
        values = np.frombuffer(bytes(row["values"]), np.float64)
        total[row["part"] << 13 : (row["part"] << 13) + len(values)] = values
    return total.reshape(shape)


def _summed(counted: DataFrame, width: int) -> np.ndarray:
    """By context and by dish, how many pairs there are and how often they occur."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 2, width))
        for batch in batches:
            for row in _each(batch):
                counts = unpacked_counts(row["counts"])
                for k, end in enumerate(_ends(unpacked(row["keys"]))):
                    total[0, k] += np.bincount(end, minlength=width)
                    total[1, k] += np.bincount(end, weights=counts, minlength=width)
        yield _rows(list(_parts(total)), [pa.int32(), pa.binary()], ["part", "values"])

    return _added(counted.select("keys", "counts").mapInArrow(add, "part int, values binary"), (2, 2, width))


def count_discount(counted: DataFrame) -> float:
    """Discount from how many pairs occur once and twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(int((n == 1).sum()), int((n == 2).sum())) for n in map(unpacked_counts, batch.column(0).to_pylist())]
            yield _rows(rows, [pa.int64(), pa.int64()], ["once", "twice"])

    once, twice = counted.select("counts").mapInArrow(run, "once long, twice long").agg(F.sum("once"), F.sum("twice")).first()
    return min(0.95, max(0.05, once / (once + 2 * twice))) if once else 0.5


@dataclass(frozen=True)
class Model:
    """A trained model: bounded arrays, and tables of the shards."""

    symbols: Symbols
    discount: float
    totals: np.ndarray  # tokens after each context
    roots: list[Root]
    pairs: DataFrame  # shard, keys, counts
    seats: DataFrame  # shard, one column of table numbers for each sample
    unigrams: DataFrame
    shards: int
    rare_shards: int


def train(docs: DataFrame, share: float = FREQUENT, rounds: int = ROUNDS, burn_in: int = BURN_IN, seed: int = 1) -> Model:
    """Trains on every row of (text)."""
    spark = docs.sparkSession
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    shards = max(4, -(-size // SHARD_BYTES))
    rare_shards = max(1, -(-shards // RARE_SHARE))
    texts = docs.select("text")
    unigrams = _gathered(texts.mapInArrow(_counted_words(rare_shards), _SENT), "words", rare_shards)
    symbols = frequent_words(unigrams, share)
    shipped = spark.sparkContext.broadcast(symbols)
    pairs = _gathered(texts.mapInArrow(_counted_pairs(shipped, shards), _SENT), "pairs", shards)
    discount = count_discount(pairs)
    width = len(symbols.words) + 2
    sums = _summed(pairs, width)
    rng = np.random.default_rng(seed)
    root = root_of(sums[0, 0], sums[0, 1], discount, rng)
    roots: list[Root] = []
    seats = None
    for turn in range(rounds):
        given = spark.sparkContext.broadcast((root.base, root.mass))

        def run(batches: Iterator[pa.RecordBatch], given=given, turn=turn) -> Iterator[pa.RecordBatch]:
            types, names = [pa.int32(), pa.binary(), pa.int32(), pa.binary()], ["shard", "tables", "part", "values"]
            base, mass = given.value
            here = Root(mass, base, base, base, mass)
            total = np.zeros((2, width))
            for batch in batches:
                for row in _each(batch):
                    keys, counts = unpacked(row["keys"]), unpacked_counts(row["counts"])
                    after = seat_pairs(keys, counts, np.ones(len(keys), np.int64), here, discount, STEPS, [seed, turn, row["shard"]])
                    for k, end in enumerate(_ends(keys)):
                        total[k] += np.bincount(end, weights=after, minlength=width)
                    if turn >= burn_in:
                        yield _rows([(row["shard"], packed_counts(after), None, None)], types, names)
            yield _rows([(None, None, *part) for part in _parts(total)], types, names)

        drawn = pairs.select("shard", "keys", "counts").mapInArrow(run, "shard int, tables binary, part int, values binary")
        if turn >= burn_in:
            drawn = settle(drawn, "seats")
        held, customers = _added(drawn.filter("part is not null").select("part", "values"), (2, width))
        given.unpersist()
        root = root_of(held, customers, discount, rng, root.own)
        if turn < burn_in:
            continue
        sample = drawn.filter("part is null").select("shard", F.col("tables").alias(f"t{len(roots)}"))
        seats = sample if seats is None else seats.join(sample, "shard")
        roots.append(root)
    # Scores need no more of them.
    roots = [Root(r.tables, r.customers, r.prob) for r in roots]
    return Model(symbols, discount, sums[1, 0], roots, pairs, seats, unigrams, shards, rare_shards)


def pair_scores(pairs: np.ndarray, counts: np.ndarray, tables: list[np.ndarray], model_parts: tuple) -> np.ndarray:
    """log10 of the mean predictive probability of each pair."""
    discount, totals, roots = model_parts
    context, dish = (pairs >> _WORD_BITS).astype(np.int64), (pairs & _WORD_MASK).astype(np.int64)
    mean = np.zeros(len(pairs))
    for root, t in zip(roots, tables):
        own = np.maximum(counts - discount * t, 0.0)
        mean += (own + (STRENGTH + discount * root.tables[context]) * root.prob[dish]) / (STRENGTH + totals[context])
    return np.log10(mean / len(roots))


_EVENT = "kind int, shard int, block long, keys binary, sizes binary, docs binary, times binary"
_EVENT_TYPES = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
_EVENT_NAMES = [x.split(" ")[0] for x in _EVENT.split(", ")]


def _events(kind: int, block: int, keys: np.ndarray, doc: np.ndarray, shard_of) -> list[tuple]:
    """Occurrences for each shard: distinct keys, documents of each, times in each document."""
    if not len(keys):
        return []
    order = np.lexsort((doc, keys))
    keys, doc = keys[order], doc[order]
    new = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1]))))
    times = np.diff(np.concatenate((new, [len(keys)])))
    keys, doc = keys[new], doc[new]
    rows = []
    for shard, i in _dealt(keys, shard_of(keys)):
        i = np.sort(i)  # by key, then document
        first = np.flatnonzero(np.concatenate(([True], keys[i][1:] != keys[i][:-1])))
        sizes = np.diff(np.concatenate((first, [len(i)])))
        rows.append((kind, shard, block, packed(keys[i][first]), packed_counts(sizes), doc[i].astype("<u2").tobytes(), packed_counts(times[i])))
    return rows


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, base_score, score of every row of (doc_id, held_out, text)."""
    spark = docs.sparkSession
    symbols = spark.sparkContext.broadcast(model.symbols)
    parts = spark.sparkContext.broadcast((model.discount, model.totals, model.roots))
    shards, rare_shards = model.shards, model.rare_shards

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = symbols.value
        context = TaskContext.get()
        number = (context.partitionId() if context else 0) << 32
        for batch in slices(batches, 2, TEXTS, TEXT_BYTES):
            tokens, symbol, pairs, bounds = text_pairs(batch.column(2).to_pylist(), known)
            n = batch.num_rows
            doc = np.repeat(np.arange(n), np.diff(bounds))
            rare = symbol == known.rare
            listed = np.flatnonzero(~rare)
            base = np.bincount(doc[listed], weights=known.base(known.counts[symbol[listed]]), minlength=n) if len(listed) else np.zeros(n)
            seen = np.bincount(doc[listed], minlength=n)
            rows = _events(0, number, pairs, doc, lambda k: pair_shards(k, shards))
            rows += _events(1, number, tokens[rare], doc[rare], lambda k: (mixed(k) % np.uint64(rare_shards)).astype(np.int64))
            head = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["doc_id", "held_out"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, head.schema) as stream:
                stream.write_batch(head)
            numbers = np.stack([np.diff(bounds).astype(np.float64), seen.astype(np.float64), base, np.zeros(n)])
            rows.append((2, -1, number, sink.getvalue().to_pybytes(), b"", b"", numbers.tobytes()))
            yield _rows(rows, _EVENT_TYPES, _EVENT_NAMES)
            number += 1

    asked = docs.select("doc_id", "held_out", "text").mapInArrow(ask, _EVENT)
    samples = len(model.roots)
    none = F.lit(None).cast("binary")
    # What a shard knows comes before what it is asked: block -1.
    stored = model.pairs.select("shard", "keys", "counts").join(model.seats, "shard")
    joined_seats = F.concat(*[F.col(f"t{k}") for k in range(samples)])
    known_pairs = stored.select(F.lit(0).alias("kind"), "shard", F.lit(-1).cast("long").alias("block"), "keys", F.col("counts").alias("sizes"), joined_seats.alias("docs"), none.alias("times"))
    known_words = model.unigrams.select(F.lit(1).alias("kind"), "shard", F.lit(-1).cast("long").alias("block"), "keys", F.col("counts").alias("sizes"), none.alias("docs"), none.alias("times"))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here: tuple | None = None
        keys, values, extra = np.zeros(0, np.uint64), np.zeros(0), np.zeros(0)
        for batch in batches:
            for row in _each(batch):
                if row["kind"] == 2:
                    yield _rows([(row["block"], 0, row["keys"], row["times"])], [pa.int64(), pa.int32(), pa.binary(), pa.binary()], ["block", "kind", "docs", "sums"])
                    continue
                if row["block"] < 0:
                    here = (row["kind"], row["shard"])
                    keys, counts = unpacked(row["keys"]), unpacked_counts(row["sizes"])
                    if row["kind"] == 0:
                        size = len(row["docs"]) // samples
                        tables = [unpacked_counts(row["docs"][k * size : (k + 1) * size]) for k in range(samples)]
                        values = pair_scores(keys, counts, tables, parts.value)
                    else:
                        values = counts.astype(np.float64)
                    continue
                if here != (row["kind"], row["shard"]):
                    here, keys, values = (row["kind"], row["shard"]), np.zeros(0, np.uint64), np.zeros(0)
                asks = unpacked(row["keys"])
                at = np.minimum(np.searchsorted(keys, asks), max(len(keys) - 1, 0))
                hit = keys[at] == asks if len(keys) else np.zeros(len(asks), bool)
                sizes = unpacked_counts(row["sizes"])
                doc, times = np.frombuffer(row["docs"], "<u2").astype(np.int64), unpacked_counts(row["times"]).astype(np.float64)
                if row["kind"] == 0:
                    worth = np.empty(len(asks))
                    if len(keys):
                        worth[hit] = values[at[hit]]
                    miss = asks[~hit]
                    worth[~hit] = pair_scores(miss, np.zeros(len(miss)), [np.zeros(len(miss))] * samples, parts.value)
                    columns = [np.zeros(len(asks)), np.zeros(len(asks)), np.zeros(len(asks)), worth]
                else:
                    counts = np.zeros(len(asks))
                    if len(keys):
                        counts[hit] = values[at[hit]]
                    columns = [np.zeros(len(asks)), (counts > 0).astype(np.float64), symbols.value.base(counts), symbols.value.among_rare(counts)]
                present, inverse = np.unique(doc, return_inverse=True)
                sums = [np.bincount(inverse, weights=np.repeat(c, sizes) * times, minlength=len(present)) for c in columns[1:]]
                kind = 1 if row["kind"] == 0 else 2
                sent = np.stack(sums[2:] if kind == 1 else sums)
                yield _rows([(row["block"], kind, present.astype("<u2").tobytes(), sent.tobytes())], [pa.int64(), pa.int32(), pa.binary(), pa.binary()], ["block", "kind", "docs", "sums"])

    # Heads of blocks are spread by their block; they need no shard.
    spread = F.when(F.col("kind") == 2, F.col("block")).otherwise(F.col("shard").cast("long"))
    rows = asked.unionByName(known_pairs).unionByName(known_words)
    parts_asked = parts_of(spark, shards + rare_shards)
    rows = rows.repartition(parts_asked, "kind", spread).sortWithinPartitions("kind", "shard", "block")
    answered = rows.mapInArrow(answer, "block long, kind int, docs binary, sums binary")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _runs(batches, 1):
            head, sums = None, np.zeros((4, 0))
            for kind, docs_raw, raw in zip(*[run.column(c).to_pylist() for c in ("kind", "docs", "sums")]):
                got = np.frombuffer(raw, np.float64)
                if kind == 0:
                    head = pa.ipc.open_stream(docs_raw).read_all()
                    sums = got.reshape(4, -1).copy()
                    continue
                doc = np.frombuffer(docs_raw, "<u2").astype(np.int64)
                if kind == 1:
                    sums[3, doc] += got
                else:
                    sums[1:, doc] += got.reshape(3, -1)
            if head is not None and head.num_rows:
                whole = [pa.array(sums[k].round().astype(np.int64)) for k in (0, 1)]
                columns = [head.column(0).combine_chunks(), head.column(1).combine_chunks(), *whole, pa.array(sums[2]), pa.array(sums[3])]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    kind = docs.select("doc_id").schema[0].dataType.simpleString()
    back = answered.repartition(parts_asked, "block").sortWithinPartitions("block", "kind")
    return back.mapInArrow(gather, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double")


def split_held_out(docs: DataFrame) -> DataFrame:
    """doc_id, text, held_out: whether the checksum of the id ends the tenth."""
    rest = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(10))
    return docs.select("doc_id", "text", F.coalesce(rest == 0, F.lit(True)).alias("held_out"))


def score_documents(docs: DataFrame) -> DataFrame:
    """Scores of all documents by a model of those not held out."""
    rows = split_held_out(docs)
    with small_batches(docs.sparkSession):
        model = train(rows.filter("not held_out"))
        scores = settle(score(rows, model), "scores")
    return scores.withColumn("train_tokens", F.lit(model.symbols.tokens).cast("long"))


def perplexity(scores: DataFrame) -> DataFrame:
    """Perplexity for each token of the held-out and the training texts, with that of the base."""
    per = lambda c: F.pow(F.lit(10.0), -F.sum(c) / F.sum("n_tokens"))
    return scores.groupBy("held_out").agg(per("score").alias("perplexity"), per("base_score").alias("base_perplexity"), F.sum("n_tokens").alias("n_tokens"))
