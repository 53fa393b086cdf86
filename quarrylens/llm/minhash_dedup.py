"""Near-duplicate documents by MinHash.

1. Each document gets the minima of ``BANDS * ROWS`` universal hashes over its
   set of five-word shingles; four minima make a band.
2. Documents with equal sets are one class, represented by the smallest id.
3. Representatives that share a band meet in blocks of bounded size.  There
   the signatures are compared, and the links of a maximum spanning forest are
   proposed: what they join needs no further link.
4. Proposed links are confirmed on the full sets, and components are found by
   alternating large-star and small-star.
5. A link of a forest may fail where another would have held.  So for every
   member of a bucket, all members of other components that its signature does
   not rule out are listed, and the lists are worked off on the full sets, best
   first; what a confirmed link has joined needs no further one.

A bucket that holds many documents is dealt over blocks by hash; in step 5,
members outside the bucket's main component meet all of its blocks.  No group
is ever held whole, and links are never cut off.

A pair of Jaccard similarity 0.75 shares no band with probability 5e-6, and
its signatures fall under ``LEAST_ESTIMATE`` with a similar one.

Null and empty texts have no shingles and are linked with nothing.  Rows that
repeat a doc_id are one document, linked with what any of them is linked with.
Rows without doc_id are linked with nothing and kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.llm.components import components
from quarrylens.llm.shared import settle
from quarrylens.llm.shingles import mixed, shingle_sets, slices

BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
# Links: 100 * intersection >= SHARE * union.
SHARE = 75
PROPOSED_ESTIMATE = SHARE / 100
LEAST_ESTIMATE = 0.58
# Members of a bucket that meet in one block.
BLOCK = 1024
# Sets that meet in one cell, from either side.
CELL = 256
# Ids that are shipped to every task instead of being joined by a shuffle.
SHIPPED_IDS = 2_000_000
# Texts, and bytes of them, whose shingles are hashed together.
TEXTS, TEXT_BYTES = 256, 2 << 20

_drawn = np.random.default_rng(20240229)
_FACTORS = (_drawn.integers(1 << 31, size=HASHES, dtype=np.int64) * 2 + 1).astype(np.uint32)
_SHIFTS = _drawn.integers(1 << 32, size=HASHES, dtype=np.int64).astype(np.uint32)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, HASHES) minima of a * x + b modulo 2**32; empty sets get zeros."""
    out = np.zeros((HASHES, len(sets)), dtype=np.uint32)
    filled = [k for k, s in enumerate(sets) if len(s)]
    if not filled:
        return out.T
    items = (np.concatenate([sets[k] for k in filled]) >> np.uint64(32)).astype(np.uint32)
    starts = np.cumsum([0, *[len(sets[k]) for k in filled[:-1]]])
    values = np.empty_like(items)
    for h in range(HASHES):
        np.multiply(items, _FACTORS[h], out=values)
        np.add(values, _SHIFTS[h], out=values)
        out[h, filled] = np.minimum.reduceat(values, starts)
    return out.T


def band_keys(minima: np.ndarray) -> np.ndarray:
    """(sets, BANDS) keys: the hash of a band's minima and its number."""
    rows = minima.reshape(len(minima), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), rows.shape[:2]).copy()
    for r in range(ROWS):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, :, r])
    return key.view(np.int64)


def document_signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set_digest, bands, signature of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, TEXTS, TEXT_BYTES):
            sets = shingle_sets(batch.column(1).to_pylist())
            minima = signatures(sets)
            digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            keys = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS), pa.array(band_keys(minima).ravel()))
            short = [row.tobytes() for row in minima.astype(np.uint8)]
            columns = [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), keys, pa.array(short, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "set_digest", "bands", "signature"])

    schema = "doc_id long, n_shingles long, set_digest binary, bands array<long>, signature binary"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Rows of equal leading columns, of batches sorted by them, as one table each."""
    rest: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [np.asarray(batch.column(k)) for k in range(keys)]
        change = np.zeros(batch.num_rows, dtype=bool)
        for column in columns:
            change[1:] |= column[1:] != column[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            key = tuple(column[a] for column in columns)
            if last is not None and key != last:
                yield pa.Table.from_batches(rest)
                rest = []
            last = key
            rest.append(batch.slice(a, b - a))
    if rest:
        yield pa.Table.from_batches(rest)


def _signature_rows(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, HASHES)


def estimates(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Shares of equal minima."""
    out = np.empty((len(left), len(right)), dtype=np.float32)
    for a in range(0, len(left), 16):
        out[a : a + 16] = (left[a : a + 16, None, :] == right[None, :, :]).mean(axis=2, dtype=np.float32)
    return out


def spanning_forest(weights: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Links of a maximum spanning forest of the pairs of at least that weight."""
    n = len(weights)
    best = np.full(n, -1.0, dtype=np.float32)
    source = np.zeros(n, dtype=np.int64)
    out = []
    for _ in range(n):
        node = int(best.argmax())
        if best[node] >= least:
            out.append((int(source[node]), node))
        elif best[node] < -1.5:
            break
        best[node] = -2.0
        open_nodes = best > -1.5
        nearer = open_nodes & (weights[node] > best) & (weights[node] >= least)
        best[nearer] = weights[node][nearer]
        source[nearer] = node
    return out


def _pair_batch(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    array = np.array(pairs, dtype=np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(array.min(axis=1)), pa.array(array.max(axis=1))], ["a", "b"])


def _propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Forest links of every block; columns key, block, id, signature."""
    out: list[tuple[int, int]] = []
    for block in _runs(batches, 2):
        if block.num_rows < 2:
            continue
        ids = block.column("id").to_pylist()
        rows = _signature_rows(block.column("signature"))
        out.extend((ids[i], ids[j]) for i, j in spanning_forest(estimates(rows, rows), PROPOSED_ESTIMATE))
        if len(out) > 10_000:
            yield _pair_batch(out)
            out = []
    yield _pair_batch(out)


_ASKED = "cell long, kind int, id long, component long, others array<long>, components array<long>"
_ASKED_NAMES = [x.split(" ")[0] for x in _ASKED.split(", ")]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What to confirm in a block and a chunk of one bucket.

    Columns key, block, chunk, side, id, component, signature, bands.  Gives a
    row (kind 1) for each member of the block with all members of the chunk
    that lie in another component and are not ruled out, best first, and a row
    (kind 0) for each member whose set is needed.  A pair that shares several
    bands is asked for in the bucket of the first one only.
    """
    for cell in _runs(batches, 3):
        side = np.asarray(cell.column("side"))
        if side.all() or not side.any():
            continue
        ids, comps = np.asarray(cell.column("id")), np.asarray(cell.column("component"))
        rows = _signature_rows(cell.column("signature"))
        bands = np.asarray(cell.column("bands").combine_chunks().flatten()).reshape(-1, BANDS)
        key = cell.column("key")[0].as_py()
        here = int(np.flatnonzero(bands[0] == key)[0])
        one, two = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        needed: set[int] = set()
        asked = []
        for at in range(0, len(one), 64):
            part = one[at : at + 64]
            near = estimates(rows[part], rows[two])
            found = (near >= LEAST_ESTIMATE) & (comps[part][:, None] != comps[two][None, :])
            for k in np.flatnonzero(found.any(axis=1)).tolist():
                at_two = np.flatnonzero(found[k])
                if here:
                    at_two = at_two[~(bands[two[at_two], :here] == bands[part[k], :here]).any(axis=1)]
                if not len(at_two):
                    continue
                best = two[at_two[np.argsort(-near[k, at_two], kind="stable")]]
                asked.append((int(ids[part[k]]), int(comps[part[k]]), ids[best].tolist(), comps[best].tolist()))
                needed.add(asked[-1][0])
                needed.update(asked[-1][2])
        if not asked:
            continue
        place = mixed(np.array([key, cell.column("block")[0].as_py(), cell.column("chunk")[0].as_py()]).astype(np.uint64))
        number = int((place * np.array([1, 3, 5], dtype=np.uint64)).sum().astype(np.int64))
        lines = [(number, 0, i, None, None, None) for i in sorted(needed)]
        lines += [(number, 1, *line) for line in asked]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*lines), kinds)], _ASKED_NAMES)


def _joined_small(many: DataFrame, few: DataFrame, key: str) -> DataFrame:
    """Inner join with a settled table of keys: broadcast up to ``SHIPPED_IDS`` rows, shuffled beyond."""
    return many.join(F.broadcast(few) if few.count() <= SHIPPED_IDS else few, key)


def placed_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(cell, id, items): the shingle set of every wanted doc_id, in each of its cells."""
    wanted = settle(wanted.groupBy("doc_id").agg(F.collect_set("cell").alias("cells")), "wanted")
    texts = _joined_small(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), wanted, "doc_id")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, TEXTS, TEXT_BYTES):
            sets = [s.tobytes() for s in shingle_sets(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary()), batch.column(2)], ["id", "items", "cells"])

    sets = texts.select("doc_id", "text", "cells").mapInArrow(spread, "id long, items binary, cells array<long>")
    return sets.select(F.explode_outer("cells").alias("cell"), "id", "items")


def _confirm(share: int):
    """Links of a cell: sets first (kind 0), then what to confirm (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in _runs(batches, 1):
            held: dict[int, list[np.ndarray]] = {}
            up: dict[int, int] = {}

            def root(x: int) -> int:
                while x in up:
                    x = up[x]
                return x

            found = []
            for kind, a, ca, others, comps, items in zip(*[cell.column(c).to_pylist() for c in (*_ASKED_NAMES[1:], "items")]):
                if kind == 0:
                    held.setdefault(a, []).append(np.frombuffer(items, np.uint64))
                    continue
                for b, cb in zip(others, comps):
                    # What is joined by now needs no further link.
                    if root(ca) != root(cb) and any(similar(x, y, share) for x in held.get(a, ()) for y in held.get(b, ())):
                        found.append((a, b))
                        up[root(ca)] = root(cb)
            if found:
                yield _pair_batch(found)

    return run


def confirmed(docs: DataFrame, asked: DataFrame, share: int = SHARE) -> DataFrame:
    """Links (a, b) between components, each confirmed on the full sets.

    ``asked`` is a settled table like that of ``_compare``.  Of the links that
    would join the same components within a cell, one is returned.
    """
    wanted = asked.filter("kind = 0").select("cell", F.col("id").alias("doc_id"))
    none = F.lit(None)
    sets = placed_sets(docs, wanted).select(
        "cell",
        F.lit(0).alias("kind"),
        "id",
        none.cast("long").alias("component"),
        none.cast("array<long>").alias("others"),
        none.cast("array<long>").alias("components"),
        "items",
    )
    lines = asked.filter("kind = 1").withColumn("items", none.cast("binary"))
    rows = sets.unionByName(lines).repartition("cell").sortWithinPartitions("cell", "kind")
    return rows.mapInArrow(_confirm(share), "a long, b long")


def gathered_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b) as rows to confirm, each end its own component.

    They are gathered in cells by the smallest neighbour of their ends, so
    that a set travels to few cells; a busy neighbour has a grid of cells.
    """
    ends = pairs.select(F.col("a").alias("id"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("id"), F.col("a").alias("other")))
    near = ends.groupBy("id").agg(F.min("other").alias("other")).select("id", F.least("id", "other").alias("near"))
    labelled = pairs.join(near.select(F.col("id").alias("a"), F.col("near").alias("na")), "a").join(
        near.select(F.col("id").alias("b"), F.col("near").alias("nb")), "b"
    )
    labelled = labelled.select("a", "b", F.least("na", "nb").alias("hub"))
    grids = labelled.groupBy("hub").agg(F.ceil(F.count("*") / CELL).alias("grid"))
    cell = F.xxhash64("hub", F.pmod(F.xxhash64("a"), "grid"), F.pmod(F.xxhash64("b"), "grid"))
    placed = settle(labelled.join(grids, "hub").select("a", "b", cell.alias("cell")), "placed")
    none = F.lit(None)
    needed = placed.select("cell", F.explode(F.array("a", "b")).alias("id")).distinct()
    lines = placed.select(
        "cell", F.lit(1).alias("kind"), F.col("a").alias("id"), F.col("a").alias("component"), F.array("b").alias("others"), F.array("b").alias("components")
    )
    sets = needed.select(
        "cell", F.lit(0).alias("kind"), "id", none.cast("long").alias("component"), none.cast("array<long>").alias("others"), none.cast("array<long>").alias("components")
    )
    return settle(sets.unionByName(lines), "asked")


def similar(x: np.ndarray, y: np.ndarray, share: int) -> bool:
    """100 * intersection >= share * union, for sorted sets without repeats."""
    if not len(x) or not len(y) or 100 * min(len(x), len(y)) < share * max(len(x), len(y)):
        return False
    both = np.concatenate([x, y])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= share * (len(both) - common)


def near_duplicates(docs: DataFrame, share: int = SHARE) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    if share < SHARE:
        raise ValueError(f"bands and estimates are made for a share of {SHARE} or more, not {share}")
    signed = settle(document_signatures(docs), "signatures")
    filled = signed.filter("n_shingles > 0 and doc_id is not null")
    classes = settle(filled.groupBy("set_digest").agg(F.min("doc_id").alias("id")), "classes")
    # The representative's own row only: both keys together are held once.
    picked = filled.join(classes.withColumnRenamed("set_digest", "digest"), (F.col("doc_id") == F.col("id")) & (F.col("set_digest") == F.col("digest")))
    first = picked.select("id", "digest", "bands", "signature").groupBy("id", "digest", "bands", "signature").count().drop("count")
    # A doc_id on rows of different sets may represent each of them.
    keys = first.select("id", "digest", F.explode_outer("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    members = settle(keys.join(shared, "key"), "members")
    signs = first.select("id", "digest", "signature")

    dealt = members.select("key", F.pmod(F.xxhash64("id", "key"), F.ceil(F.col("n") / BLOCK)).alias("block"), "id", "digest")
    blocks = dealt.join(signs, ["id", "digest"]).select("key", "block", "id", "signature")
    blocks = blocks.repartition("key", "block").sortWithinPartitions("key", "block", "id")
    proposed = settle(blocks.mapInArrow(_propose, "a long, b long").filter("a != b").distinct(), "proposed")
    links = settle(confirmed(docs, gathered_pairs(proposed), share), "links")
    found = settle(components(links.select(F.col("a").alias("u"), F.col("b").alias("v"))), "components")

    labelled = members.join(found, "id", "left").select("key", "id", "digest", F.coalesce("component", "id").alias("component"))
    sizes = labelled.groupBy("key", "component").agg(F.count("*").alias("n"))
    split = sizes.groupBy("key").agg(
        F.max_by("component", F.struct("n", -F.col("component"))).alias("main"), F.sum("n").alias("n"), F.max("n").alias("most"), F.count("*").alias("kinds")
    )
    split = split.filter("kinds > 1").select("key", "main", F.ceil(F.col("n") / BLOCK).alias("blocks"), F.ceil((F.col("n") - F.col("most")) / BLOCK).alias("chunks"))
    rest = labelled.join(split, "key")
    all_of = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    one = rest.select("key", F.pmod(F.xxhash64("id", "key"), "blocks").alias("block"), all_of("chunks").alias("chunk"), F.lit(0).alias("side"), "id", "digest", "component")
    two = rest.filter("component != main").select(
        "key", all_of("blocks").alias("block"), F.pmod(F.xxhash64("key", "id"), "chunks").alias("chunk"), F.lit(1).alias("side"), "id", "digest", "component"
    )
    cells = one.unionByName(two).join(first.select("id", "digest", "signature", "bands"), ["id", "digest"])
    cells = cells.select("key", "block", "chunk", "side", "id", "component", "signature", "bands")
    cells = cells.repartition("key", "block", "chunk").sortWithinPartitions("key", "block", "chunk")
    asked = settle(cells.mapInArrow(_compare, _ASKED), "asked")
    more = settle(confirmed(docs, asked, share), "links")

    # A doc_id on rows of different sets ties their classes together.
    placed = filled.select("doc_id", "set_digest").join(classes, "set_digest")
    tied = placed.groupBy("doc_id").agg(F.min("id").alias("u"), F.max("id").alias("v")).filter("u != v")
    edges = found.select(F.col("id").alias("u"), F.col("component").alias("v"))
    edges = edges.unionByName(more.select(F.col("a").alias("u"), F.col("b").alias("v")))
    for end in ("u", "v"):
        edges = edges.unionByName(tied.select(F.col("doc_id").alias("u"), F.col(end).alias("v")))
    final = settle(components(edges), "components")

    rows = signed.select("doc_id", "n_shingles", "set_digest").join(classes, "set_digest", "left")
    rows = rows.join(final, "id", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "id", "doc_id"))
    return rows.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one_of_each(docs: DataFrame, share: int = SHARE) -> DataFrame:
    """The documents that name their component; of rows that repeat a kept doc_id, all."""
    gone = near_duplicates(docs, share).filter("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
