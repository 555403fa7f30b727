"""Most similar vectors by multiprobe p-stable hashing.

A table hashes a vector x to the ``width`` M integers floor((a x + b) / w) with
normal a: near vectors fall into the same bucket or into one beside it.  Every
vector is kept in its own bucket of each table.  A query looks into its own
bucket and then into the buckets reached by moving some coordinates by one, in the
order of their estimated chance to hold a near vector: a move is likelier the
closer the query lies to that border.  The order of the sets of moves, expressed
in ranks of border distances, is the same for all queries and worked out once.
The candidates of all tables are merged and ranked by exact distance.

The vectors have length one, so the squared distance is 2 - 2 cos.

Where all near pairs are sought, a first layer brings near vectors together before
they are hashed: cells around a few centres, each with the vectors that lie so close
to its border that a partner may lie beyond it.  A vector is moved about once, and its
tables, probes and candidates stay within the task that holds its cell.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindrift.llm.vectors import matrix, unit_rows
from spindrift.session import cut

#: Rows of one side that a task compares at once.
BLOCK_ROWS = 8192

#: Vectors that meet a block of queries at once where these are compared with all vectors.
SCAN_ROWS = 65_536

#: Rows of a cell that meet each other in one place while pairs are searched; a larger
#: cell is cut into parts, each of which meets every other.
PAIR_BLOCK_ROWS = 131_072

#: Rows that the centres of the cells come from, about.
SAMPLE_ROWS = 4096

#: Cells at most, and rows that a vector may become on average (itself and its copies beyond borders).
MOST_CELLS, MOST_COPIES = 512, 1.25


@dataclass(frozen=True)
class HashParams:
    """``tables`` L, hashes per table M, slot width w, extra probes per table T."""

    tables: int
    hashes: int
    slot: float
    probes: int
    seed: int = 7


#: For pairs at cosine 0.992 and above (distance 0.1265 and below): of 20,000 random
#: pairs at that bound 99 % meet in some table.  Wider slots find more of them, but fill
#: the buckets with pairs that are merely of one kind.
NEAR = HashParams(tables=5, hashes=14, slot=0.75, probes=8)

#: For the k nearest of all vectors, at distances up to 0.5.
WIDE = HashParams(tables=6, hashes=8, slot=1.0, probes=24)

#: Least cosine (distance 0.5) of a k-th neighbour that is taken from buckets alone.
WITHIN_COS = 0.875

#: A candidate pair is dropped unread if the signs of 64 projections differ in more
#: places than those of all but one in a million pairs at the bound.
_LOST = 1e-6

#: Candidate pairs whose signs are compared at once, and pairs found that are held at once.
_PAIRS_AT_ONCE, _PAIRS_HELD = 1 << 18, 1 << 21

#: Candidates that cost as much as a comparison of all vectors of a block, per pair of it.
_DENSE = 1 / 3


def projections(dim: int, p: HashParams) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(p.seed)
    return rng.normal(size=(dim, p.tables * p.hashes)), rng.uniform(0, p.slot, size=p.tables * p.hashes)


def probe_sets(hashes: int, probes: int) -> list[tuple[int, ...]]:
    """The first sets of moves by expected score, as ranks 0..2M-1 of border distances.

    Rank j and rank 2M-1-j are the two borders of one coordinate, so a set holds at
    most one of them.  The expected squared distance of a rank is that of order
    statistics of uniform values.
    """
    m = hashes
    score = [(j * (j + 1)) / (4 * (m + 1) * (m + 2)) if j <= m else 1 - (2 * m + 1 - j) / (m + 1) + (2 * m + 1 - j) * (2 * m + 2 - j) / (4 * (m + 1) * (m + 2)) for j in range(1, 2 * m + 1)]
    heap: list[tuple[float, tuple[int, ...]]] = [(score[0], (0,))]
    out: list[tuple[int, ...]] = []
    while heap and len(out) < probes:
        s, ranks = heapq.heappop(heap)
        if not any(2 * m - 1 - r in ranks for r in ranks):
            out.append(ranks)
        last = ranks[-1]
        if last + 1 < 2 * m:
            heapq.heappush(heap, (s - score[last] + score[last + 1], (*ranks[:-1], last + 1)))
            heapq.heappush(heap, (s + score[last + 1], (*ranks, last + 1)))
    return out


def _mix(slots: np.ndarray, table: np.ndarray) -> np.ndarray:
    """One 64-bit key for the slots of a table; ``slots`` is (..., M) of int64."""
    with np.errstate(over="ignore"):
        key = (table.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        for j in range(slots.shape[-1]):
            key = (key ^ slots[..., j].astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
            key ^= key >> np.uint64(29)
    return key.astype(np.int64)


def bucket_keys(x: np.ndarray, p: HashParams, probes: bool) -> np.ndarray:
    """(n, L) keys of the vectors' own buckets, or (n, L, 1 + T) with those to probe after it."""
    a, b = projections(x.shape[1], p)
    at = (x.astype(np.float64) @ a + b) / p.slot
    slots = np.floor(at).astype(np.int64)
    n, m = len(x), p.hashes
    slots = slots.reshape(n, p.tables, m)
    table = np.broadcast_to(np.arange(p.tables), (n, p.tables))
    own = _mix(slots, table)
    if not probes:
        return own
    low = (at - np.floor(at)).reshape(n, p.tables, m)
    border = np.concatenate([low, 1 - low], axis=2)
    order = np.argsort(border, axis=2, kind="stable")
    keys = [own]
    for ranks in probe_sets(m, p.probes):
        moved = slots.copy()
        for r in ranks:
            which = order[:, :, r : r + 1]
            coord, step = which % m, np.where(which < m, -1, 1)
            np.put_along_axis(moved, coord, np.take_along_axis(moved, coord, axis=2) + step, axis=2)
        keys.append(_mix(moved, table))
    return np.stack(keys, axis=2)


def hashed(vectors: DataFrame, p: HashParams, probes: bool) -> DataFrame:
    """(bucket, id): one row per table, and per probed bucket if ``probes``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("id").to_numpy(zero_copy_only=False)
            for lo in range(0, len(ids), 2048):
                x = matrix(b.column("vec").slice(lo, 2048))
                keys = bucket_keys(x, p, probes).reshape(len(x), -1)
                yield pa.record_batch({"bucket": pa.array(keys.ravel()), "id": pa.array(np.repeat(ids[lo : lo + 2048], keys.shape[1]))})

    return vectors.select("id", "vec").mapInArrow(run, "bucket long, id long")


def one_vector(rows: DataFrame) -> tuple[DataFrame, int]:
    """The rows (id, vec) with one vector for each id, still repeated where the same was delivered again, and their number.

    Only hashes are moved to tell which ids come with several vectors; of those the
    first in the order of the arrays is taken.
    """
    each = rows.select("id", F.xxhash64("vec").alias("h")).groupBy("id").agg(F.min("h").alias("low"), F.max("h").alias("high"), F.count(F.lit(1)).alias("n"))
    told = each.agg(F.sum("n").alias("n"), F.count_if(F.col("low") != F.col("high")).alias("several")).first()
    n = told["n"] or 0
    if not told["several"]:
        return rows, n
    unclear = cut(each.where("low != high").select("id"), "unclear")
    chosen = rows.join(unclear, "id", "left_semi").groupBy("id").agg(F.min("vec").alias("vec"))
    return rows.join(unclear, "id", "left_anti").unionByName(chosen), n


def cells_of(x: np.ndarray, centres: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """(home, near): the cell of the nearest centre, and for each cell whether a vector belongs to it.

    A vector belongs to the cells whose border with its own is at most half of
    ``reach`` away.  The line between two vectors of different homes crosses the
    border of these, so one of two that lie within ``reach`` belongs to the home of
    the other: no pair is lost between cells.
    """
    if len(centres) == 1:
        return np.zeros(len(x), np.int64), np.ones((len(x), 1), bool)
    size = (centres**2).sum(axis=1)
    far = size - 2 * x.astype(np.float64) @ centres.T
    home = far.argmin(axis=1)
    between = np.sqrt(np.maximum(size[:, None] + size[None, :] - 2 * centres @ centres.T, 0))
    near = far - far[np.arange(len(x)), home][:, None] <= reach * between[home]
    near[np.arange(len(x)), home] = True
    return home, near


def cell_centres(x: np.ndarray, reach: float) -> np.ndarray:
    """Centres of as many cells as keep the average vector of ``x`` in at most MOST_COPIES cells; one cell always does.

    For several least cosines to the first of a group: the means of the groups, moved once to the means of their cells.
    """
    best = x.mean(axis=0, keepdims=True)
    for least in np.arange(0.1, 0.95, 0.05):
        means, left = [], x
        while len(left) and len(means) <= MOST_CELLS:
            mine = left @ left[0] >= least
            mine[0] = True
            means.append(left[mine].mean(axis=0))
            left = left[~mine]
        if len(means) > MOST_CELLS:
            break
        home, _ = cells_of(x, np.stack(means), reach)
        centres = np.stack([x[home == c].mean(axis=0) for c in np.unique(home)])
        if len(centres) > len(best) and cells_of(x, centres, reach)[1].sum() <= MOST_COPIES * len(x):
            best = centres
    return best


def _in_cells(rows: DataFrame, centres: np.ndarray, parts: np.ndarray, reach: float) -> DataFrame:
    """(block, kind, id, vec): each row once for each block of a cell that it belongs to.

    The block of the parts i < j of a cell holds i as kind 0 and j as kind 1, that of one part kind 0 only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 4096):
                ids, vec = b.column("id").slice(lo, 4096), b.column("vec").slice(lo, 4096)
                row, cell = np.nonzero(cells_of(unit_rows(matrix(vec)), centres, reach)[1])
                mixed = ids.to_numpy(zero_copy_only=False)[row].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                mine = ((mixed >> np.uint64(32)) % parts[cell].astype(np.uint64)).astype(np.int64)
                for other in range(int(parts[cell].max(initial=0))):
                    at = np.flatnonzero(other < parts[cell])
                    i, j = np.minimum(mine[at], other), np.maximum(mine[at], other)
                    block = (cell[at].astype(np.int64) << 40) | (i << 20) | j
                    yield pa.record_batch({"block": pa.array(block), "kind": pa.array((mine[at] > other).astype(np.int32)), "id": ids.take(pa.array(row[at])), "vec": vec.take(pa.array(row[at]))})

    return rows.select("id", "vec").mapInArrow(run, f"block long, kind int, id long, vec {rows.schema['vec'].dataType.simpleString()}")


def _groups(kind: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, order, starts): of the equal vectors of a kind one row, all rows group by group, and where each group starts."""
    words = np.ascontiguousarray(x, np.float32).view(np.uint32).astype(np.uint64)
    odd = np.random.default_rng(11).integers(1, 1 << 63, size=x.shape[1], dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    with np.errstate(over="ignore"):
        key = (words * odd).sum(axis=1, dtype=np.uint64) * np.uint64(2) + kind.astype(np.uint64)
    _, first, group = np.unique(key, return_index=True, return_inverse=True)
    alike = (kind == kind[first[group]]) & (x == x[first[group]]).all(axis=1)
    group[~alike] = len(first) + np.arange((~alike).sum())
    order = np.argsort(group, kind="stable")
    starts = np.flatnonzero(np.diff(group[order], prepend=-1))
    return order[starts], order, np.append(starts, len(order))


def most_signs(share: np.ndarray) -> np.ndarray:
    """Of 64 signs, each differing with probability ``share``, as many differ at most but for one case in a million."""
    grid = np.arange(257) / 256
    below = np.cumsum([[math.comb(64, k) * q**k * (1 - q) ** (64 - k) for k in range(65)] for q in grid], axis=1)
    return (below < 1 - _LOST).sum(axis=1).clip(max=64)[np.ceil(share * 256).astype(int)]


def _signs(x: np.ndarray, min_cos: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(signs, most): 64 signs of projections of each vector around the mean, and in how many those of a near vector may differ.

    A vector within ``reach`` is seen from the mean under at most the angle whose sine is reach / distance.
    """
    g = np.random.default_rng(seed + 1).normal(size=(x.shape[1], 64))
    y = x.astype(np.float64) - x.mean(axis=0, dtype=np.float64)
    signs = np.packbits(y @ g > 0, axis=1).view(np.uint64).ravel()
    sine = reach_of(min_cos) / np.maximum(np.linalg.norm(y, axis=1), 1e-12)
    return signs, np.where(sine < 1, most_signs(np.arcsin(np.minimum(sine, 1)) / np.pi), 64).astype(np.uint8)


def reach_of(min_cos: float) -> float:
    """Distance of unit vectors at ``min_cos``, with room for single precision."""
    return math.sqrt(max(0.0, 2 - 2 * min_cos)) + 1e-3


def _meeting(x: np.ndarray, kind: np.ndarray, min_cos: float, p: HashParams) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(a, b, cos): rows of distinct unit vectors that meet in a bucket and lie near each other, a < b; between kinds if there are two.

    If a block is so dense that most of it would meet in the buckets, all its vectors are compared.
    """
    n = len(x)
    if n < 2:
        return
    two = bool(kind.any()) and not kind.all()
    own = np.concatenate([bucket_keys(x[lo : lo + 2048], p, probes=False) for lo in range(0, n, 2048)])
    order = np.argsort(own, axis=0, kind="stable")
    buckets = [np.unique(own[order[:, t], t], return_index=True) for t in range(p.tables)]
    begins = np.zeros((n, p.tables, 1 + p.probes), np.int32)
    counts = np.zeros_like(begins)
    for lo in range(0, n, 2048):
        keys = bucket_keys(x[lo : lo + 2048], p, probes=True)
        for t, (known, at) in enumerate(buckets):
            place = np.minimum(np.searchsorted(known, keys[:, t]), len(known) - 1)
            begins[lo : lo + 2048, t] = at[place]
            counts[lo : lo + 2048, t] = np.where(known[place] == keys[:, t], np.append(at, n)[place + 1] - at[place], 0)

    def exactly(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        cos = np.einsum("ij,ij->i", x[a].astype(np.float64), x[b].astype(np.float64))
        near = cos >= min_cos
        return a[near], b[near], cos[near]

    if counts.sum(dtype=np.int64) > _DENSE * n * n:
        for lo in range(0, n, 512):
            for by in range(lo, n, 8192):
                a, b = np.nonzero(x[lo : lo + 512] @ x[by : by + 8192].T >= min_cos - 1e-4)
                a, b = a + lo, b + by
                keep = (a < b) & ((not two) | (kind[a] != kind[b]))
                yield exactly(a[keep], b[keep])
        return
    signs, most = _signs(x, min_cos, p.seed)
    held: list[np.ndarray] = []

    def once() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        code = np.unique(np.concatenate(held)) if held else np.zeros(0, np.int64)
        held.clear()
        return exactly(code // n, code % n)

    for t in range(p.tables):
        sorted_signs = signs[order[:, t]]
        which = np.flatnonzero(counts[:, t].ravel())
        each, begin, query = counts[:, t].ravel()[which], begins[:, t].ravel()[which], which // (1 + p.probes)
        upto = np.cumsum(each, dtype=np.int64)
        lo = 0
        while lo < len(which):
            hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + _PAIRS_AT_ONCE, side="right")))
            c, q = each[lo:hi], query[lo:hi]
            place = np.arange(c.sum()) + np.repeat(begin[lo:hi] - (np.cumsum(c) - c), c)
            few = np.flatnonzero(np.bitwise_count(sorted_signs[place] ^ np.repeat(signs[q], c)) <= np.repeat(most[q], c))
            left, right = np.repeat(q, c)[few], order[place[few], t]
            keep = (left != right) & ((not two) | (kind[left] != kind[right]))
            left, right = left[keep], right[keep]
            for i in range(0, len(left), 16_384):
                a, b = left[i : i + 16_384], right[i : i + 16_384]
                near = np.einsum("ij,ij->i", x[a], x[b]) >= min_cos - 1e-4
                a, b = a[near].astype(np.int64), b[near].astype(np.int64)
                held.append(np.minimum(a, b) * n + np.maximum(a, b))
            if sum(map(len, held)) > _PAIRS_HELD:
                yield once()
            lo = hi
    yield once()


def _pairs_in(kind: np.ndarray, ids: np.ndarray, x: np.ndarray, min_cos: float, p: HashParams) -> Iterator[pa.RecordBatch]:
    """The near pairs of a block, as ids; of each id and of each vector one row is searched, its copies are added to what it meets."""

    def batch(a: np.ndarray, b: np.ndarray, cos: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch({"id_a": pa.array(np.minimum(a, b)), "id_b": pa.array(np.maximum(a, b)), "cos": pa.array(cos)})

    ids, at = np.unique(ids, return_index=True)
    kind, x = kind[at], unit_rows(x[at])
    first, order, starts = _groups(kind, x)
    member, size = ids[order], np.diff(starts)
    if not kind.any() or kind.all():  # copies of one vector
        for n in np.unique(size[size > 1]):
            of_size = member[starts[:-1][size == n][:, None] + np.arange(n)]
            for i in range(1, n):
                for lo in range(0, len(of_size), max(1, _PAIRS_HELD // n)):
                    some = of_size[lo : lo + max(1, _PAIRS_HELD // n)]
                    yield batch(np.repeat(some[:, i], i), some[:, :i].ravel(), np.ones(len(some) * i))
    for a, b, cos in _meeting(x[first], kind[first], min_cos, p):
        n = size[a] * size[b]
        upto = np.cumsum(n)
        lo = 0
        while lo < len(a):
            hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + _PAIRS_HELD, side="right")))
            pair = np.repeat(np.arange(lo, hi), n[lo:hi])
            k = np.arange(len(pair)) - np.repeat(upto[lo:hi] - n[lo:hi] - (upto[lo - 1] if lo else 0), n[lo:hi])
            yield batch(member[starts[a[pair]] + k // size[b[pair]]], member[starts[b[pair]] + k % size[b[pair]]], cos[pair])
            lo = hi


def near_pairs(vectors: DataFrame, min_cos: float, p: HashParams = NEAR) -> DataFrame:
    """(id_a, id_b, cos), id_a < id_b: pairs of vectors (id, vec) with a cosine of at least ``min_cos``.

    Vectors of any length but 0; rows of an id may repeat.  A vector is moved to its
    cell, and to those beyond a border close by; there it is scaled, hashed and
    compared, so neither its buckets nor its candidates leave the task, and what is
    moved afterwards are the pairs of the result.  Centres come from about
    SAMPLE_ROWS rows; they decide where vectors meet, not whether.  Equal vectors are
    searched as one.  Empty tables give no pairs.
    """
    rows, n = one_vector(vectors)
    reach = reach_of(min_cos)
    drawn = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 40)) < F.lit(min(1 << 40, (SAMPLE_ROWS << 40) // max(n, 1))))
    drawn = drawn.groupBy("id").agg(F.first("vec").alias("vec")).limit(4 * SAMPLE_ROWS).toArrow().sort_by("id")
    x = unit_rows(matrix(drawn.column("vec"))).astype(np.float64) if drawn.num_rows else np.zeros((1, 1))
    centres = cell_centres(x, reach)
    met = cells_of(x, centres, reach)[1].sum(axis=0)
    share = np.minimum(1, (met + 2 * np.sqrt(met) + 4) / len(x))
    parts = np.ceil(share * n / PAIR_BLOCK_ROWS).astype(np.int64).clip(1, (1 << 20) - 1)
    blocks = _in_cells(rows, centres, parts, reach).repartition("block").sortWithinPartitions("block")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kind, ids, x in _blocks(batches):
            yield from _pairs_in(kind, ids, x, min_cos, p)

    found = blocks.mapInArrow(search, "id_a long, id_b long, cos double")
    # A pair of vectors beside a border may be found in both cells.
    return found.groupBy("id_a", "id_b").agg(F.min("cos").alias("cos"))


def _ranked(rows: DataFrame, k: int) -> DataFrame:
    """(id, neighbour, cos): the k nearest rows (kind 1) of each query (kind 0) within each block of (block, kind, id, vec)."""
    rows = rows.repartition("block").sortWithinPartitions("block", "kind")

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kinds, ids, x in _blocks(batches):
            nq = int((kinds == 0).sum())
            qid, vid, y = ids[:nq], ids[nq:], x[nq:]
            for lo in range(0, nq if len(vid) else 0, 512):
                cos = x[lo : min(lo + 512, nq)] @ y.T
                cos[qid[lo : lo + 512, None] == vid[None, :]] = -2
                top = min(k, len(vid))
                best = np.argpartition(-cos, top - 1, axis=1)[:, :top]
                near = np.take_along_axis(cos, best, axis=1)
                keep = near > -2
                mine = np.broadcast_to(qid[lo : lo + 512, None], best.shape)
                yield pa.record_batch({"id": pa.array(mine[keep]), "neighbour": pa.array(vid[best][keep]), "cos": pa.array(near[keep].astype(np.float64))})

    return rows.mapInArrow(rank, "id long, neighbour long, cos double")


def hashed_nearest(vectors: DataFrame, queries: DataFrame, k: int, p: HashParams = WIDE) -> DataFrame:
    """(id, neighbour, cos, rank): the k most similar candidates that each query (id, vec) meets in its buckets.

    A bucket's vectors are brought to its queries in blocks of bounded size: a
    bucket that holds a third of all vectors is many groups, each with a copy of the
    bucket's queries, which again are split into blocks.  Every block keeps the k
    best of each query, so what is shuffled afterwards is bounded by k rows per
    query and block.  A query with fewer than k candidates has fewer rows.  Ties
    are ordered by id.
    """
    index = hashed(vectors, p, probes=False).select("bucket", "id")
    asked = cut(hashed(queries, p, probes=True).select("bucket", "id").distinct(), "asked")
    # Only buckets that a query looks into are kept, with the numbers of their blocks.
    wanted = asked.groupBy("bucket").agg(F.count(F.lit(1)).alias("nq"))
    index = cut(index.join(wanted.select("bucket"), "bucket", "left_semi"), "index")
    sizes = index.groupBy("bucket").agg(F.count(F.lit(1)).alias("nv")).join(wanted, "bucket")
    sizes = cut(sizes.select("bucket", F.ceil(F.col("nv") / BLOCK_ROWS).cast("int").alias("bv"), F.ceil(F.col("nq") / BLOCK_ROWS).cast("int").alias("bq")), "sizes")
    rows = index.join(sizes, "bucket").select("bucket", "id", F.pmod(F.xxhash64("id"), "bv").cast("int").alias("v"), F.explode(F.sequence(F.lit(0), F.col("bq") - 1)).alias("q"), F.lit(1).alias("kind"))
    ask = asked.join(sizes, "bucket").select("bucket", "id", F.pmod(F.xxhash64("id", F.lit(1)), "bq").cast("int").alias("q"), F.explode(F.sequence(F.lit(0), F.col("bv") - 1)).alias("v"), F.lit(0).alias("kind"))
    columns = [F.xxhash64("bucket", "v", "q").alias("block"), "kind", "id", "vec"]
    return _best(_ranked(rows.join(vectors, "id").select(columns).unionByName(ask.join(queries, "id").select(columns)), k), k)


def _best(found: DataFrame, k: int) -> DataFrame:
    once = found.groupBy("id", "neighbour").agg(F.max("cos").alias("cos"))
    w = Window.partitionBy("id").orderBy(F.desc("cos"), "neighbour")
    return once.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def scanned_nearest(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(id, neighbour, cos, rank): exactly, by comparing each query with all vectors, block by block.

    A block of vectors meets a block of queries as two matrices and keeps the k best of each query.
    """
    bq = max(1, math.ceil(queries.count() / BLOCK_ROWS))
    bv = max(1, math.ceil(vectors.count() / SCAN_ROWS))
    all_q, all_v = F.explode(F.sequence(F.lit(0), F.lit(bq - 1))), F.explode(F.sequence(F.lit(0), F.lit(bv - 1)))
    rows = vectors.select("id", "vec", F.pmod(F.xxhash64("id"), F.lit(bv)).cast("int").alias("v"), all_q.alias("q"), F.lit(1).alias("kind"))
    ask = queries.select("id", "vec", all_v.alias("v"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(bq)).cast("int").alias("q"), F.lit(0).alias("kind"))
    both = rows.unionByName(ask).select((F.col("v").cast("long") * bq + F.col("q")).alias("block"), "kind", "id", "vec")
    return _best(_ranked(both, k), k)


def nearest(vectors: DataFrame, queries: DataFrame, k: int, p: HashParams = WIDE, within_cos: float = WITHIN_COS) -> DataFrame:
    """(id, neighbour, cos, rank): for each query (id, vec) the k most similar other vectors.

    Queries are answered from their buckets.  Where that gives fewer than k
    vectors, or a k-th one of a cosine below ``within_cos``, beyond which buckets
    lose too much, the query is compared with all vectors instead, so its answer is
    exact; with fewer than k other vectors in all it has fewer rows.  Ties are
    ordered by id.  Empty tables give no rows.
    """
    hashed_ = cut(hashed_nearest(vectors, queries, k, p), "hashed")
    good = hashed_.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("cos").alias("low")).where((F.col("n") == k) & (F.col("low") >= within_cos)).select("id")
    rest = cut(queries.select("id", "vec").join(good, "id", "left_anti"), "rest")
    return hashed_.join(good, "id", "left_semi").unionByName(scanned_nearest(vectors, rest, k))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The blocks of rows sorted by ``block``: (kind, id, vec); one block is held at a time."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    at = None

    def joined():
        return tuple(np.concatenate([h[i] for h in held]) for i in range(3))

    for b in batches:
        block = b.column("block").to_numpy(zero_copy_only=False)
        if not len(block):
            continue
        rows = (b.column("kind").to_numpy(zero_copy_only=False), b.column("id").to_numpy(zero_copy_only=False), matrix(b.column("vec")))
        starts = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1), len(block)]
        for lo, hi in zip(starts[:-1], starts[1:], strict=True):
            if held and block[lo] != at:
                yield joined()
                held = []
            at = block[lo]
            held.append(tuple(r[lo:hi] for r in rows))
    if held:
        yield joined()
