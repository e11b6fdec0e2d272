"""Vector code compression: product codes whose codebook entries are searched through a GNAT.

Components become integers, vectors are cut into parts, and every part position
has a codebook that a few rounds of integer k-means refine. The nearest entry is
found through a geometric near-neighbour access tree over the codebook: a node
holds split entries; each split knows, for every child, the least and the largest
distance from itself to the child's entries. A distance from the query to one split
rules out every child whose range it cannot reach from inside the best distance so
far. Roots are rounded outwards and children go only if they are strictly out of
reach, so no tie is lost; what is compared at last are squared distances in whole
numbers, ties to the lower entry.

Whole batches go through a tree at once: a node gets the rows that still may need
it. A round sends one partial sum per task, part, entry and component to one
aggregate; codebooks (parts x entries x components numbers, whatever the input) are
all the driver holds.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseloom.session import broadcast_if_small, checkpointed

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
FAN = 4
LIMB = 32  # bits of a sum that travel in one long
MOST = 2**63 - 1
_BITS = np.frompyfunc(math.isqrt, 1, 1)


def small(width: int) -> int:
    """Components below it have squared distances within a long in parts of ``width`` components."""
    return math.isqrt((1 << 60) // max(1, width))


def whole(vectors: np.ndarray, width: int) -> np.ndarray:
    """``floor(SCALE * x)`` of doubles: longs if all are :func:`small`, Python's own integers otherwise."""
    if not vectors.size or np.abs(vectors).max() < (small(width) - 1) / SCALE:
        return np.floor(vectors * SCALE).astype(np.int64)
    exact = lambda x: int(x) * SCALE if abs(x) >= 2.0**53 else math.floor(x * SCALE)
    return np.array([exact(x) for x in vectors.ravel().tolist()], dtype=object).reshape(vectors.shape)


def squared(points: np.ndarray, point: np.ndarray) -> np.ndarray:
    """Squared distances of ``points`` to ``point``, exact."""
    gap = points - point
    return (gap * gap).sum(axis=1)


def root_below(square: np.ndarray) -> np.ndarray:
    """A number that is at most the root of each square."""
    return _BITS(square) if square.dtype == object else np.sqrt(square.astype(np.float64)) * (1 - 1e-15)


def root_above(square: np.ndarray) -> np.ndarray:
    """A number that is at least the root of each square."""
    return _BITS(square) + 1 if square.dtype == object else np.sqrt(square.astype(np.float64)) * (1 + 1e-15)


class Node(NamedTuple):
    """Split entries (numbers and points), for split i and child j the range [near, far] of distances, and the nodes below."""

    entries: list[int]
    points: np.ndarray
    near: np.ndarray
    far: np.ndarray
    below: list[Node | None]


def build(book: np.ndarray, entries: list[int] | None = None, fan: int = FAN) -> Node:
    """The tree over the entries of one codebook.

    Splits are chosen far apart: the first entry, then always the one farthest
    from those chosen. Every other entry falls to its nearest split. A child's
    range covers its split and all entries below it.
    """
    entries = list(range(len(book))) if entries is None else entries
    points = book[entries]
    apart = [squared(points, points[i]) for i in range(min(len(entries), 1))]
    splits = [0]
    while len(splits) < min(fan, len(entries)):
        reach = np.min(np.stack(apart), axis=0)
        reach[splits] = -1
        splits.append(int(np.argmax(reach)))
        apart.append(squared(points, points[splits[-1]]))
    to_split = np.stack(apart)
    owner = np.argmin(to_split, axis=0)
    owner[splits] = np.arange(len(splits))
    members = [np.flatnonzero(owner == j) for j in range(len(splits))]
    near = np.stack([np.stack([root_below(to_split[i][at]).min() for at in members]) for i in range(len(splits))])
    far = np.stack([np.stack([root_above(to_split[i][at]).max() for at in members]) for i in range(len(splits))])
    below: list[Node | None] = []
    for split, at in zip(splits, members, strict=True):
        rest = [entries[x] for x in at if x != split]
        below.append(build(book, rest, fan) if rest else None)
    return Node([entries[x] for x in splits], points[splits], near, far, below)


class Found:
    """Nearest entry and squared distance of every row so far; ``asked`` counts the distances computed."""

    def __init__(self, rows: np.ndarray):
        self.entry = np.full(len(rows), -1, np.int64)
        self.square = np.full(len(rows), MOST, rows.dtype) if rows.dtype != object else np.array([None] * len(rows), dtype=object)
        self.asked = 0


def search(node: Node, rows: np.ndarray, at: np.ndarray, found: Found) -> None:
    """Let ``found`` take in the entries of ``node`` that may be nearest to ``rows[at]``."""
    fan = len(node.entries)
    alive = np.ones((len(at), fan), bool)
    for i, entry in enumerate(node.entries):
        live = np.flatnonzero(alive[:, i])
        if not len(live):
            continue
        who = at[live]
        square = squared(rows[who], node.points[i])
        found.asked += len(who)
        old = found.entry[who]
        nearer = old < 0
        known = ~nearer
        nearer[known] = (square[known] < found.square[who[known]]) | ((square[known] == found.square[who[known]]) & (entry < old[known]))
        found.square[who[nearer]] = square[nearer]
        found.entry[who[nearer]] = entry
        low, high, reach = root_below(square), root_above(square), root_above(found.square[who])
        for j in range(fan):
            if j != i:
                gone = (low > node.far[i, j] + reach) | (high + reach < node.near[i, j])
                alive[live[gone], j] = False
            elif node.below[i] is not None:
                # The range from a split to its own child, itself left out of what is below.
                alive[live[low > node.far[i, i] + reach], i] = False
    for j, child in enumerate(node.below):
        if child is not None and len(live := at[alive[:, j]]):
            search(child, rows, live, found)


def nearest(tree: Node, rows: np.ndarray) -> Found:
    """Entry (ties to the lower) and squared distance of every row."""
    if rows.dtype != object and tree.points.dtype == object:
        rows = rows.astype(object)
    found = Found(rows if tree.points.dtype != object else rows.astype(object))
    if len(rows):
        search(tree, rows, np.arange(len(rows)), found)
    return found


def _matrix(column: pa.Array, size: int, width: int) -> np.ndarray:
    """The vectors of a batch as one matrix of whole numbers, shorter ones followed by zeros."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(lengths), size))
    out[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return whole(out, width)


def _limbs(value: int) -> Iterator[tuple[int, int]]:
    """``value`` as (number, limb) of LIMB bits each, the last with the sign; sums of limbs add up to the sum of values."""
    number = 0
    while not -(1 << LIMB) <= value < 1 << LIMB:
        yield number, value & ((1 << LIMB) - 1)
        value >>= LIMB
        number += 1
    yield number, value


def _means(kept: DataFrame, books: list[np.ndarray], size: int) -> list[np.ndarray]:
    """The codebooks after one round: every used entry the floor of the mean of its parts."""
    width = size // len(books)
    trees = [build(book) for book in books]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(books), len(books[0])), np.int64)
        sums = np.zeros((len(books), len(books[0]), width), dtype=object)
        for batch in batches:
            rows = _matrix(batch.column(0), size, width)
            for m, tree in enumerate(trees):
                part = rows[:, m * width : (m + 1) * width]
                entry = nearest(tree, part).entry
                for e in np.unique(entry):
                    own = part[entry == e]
                    counts[m, e] += len(own)
                    sums[m, e] += own.sum(axis=0).astype(object)
        out = [(m, e, -1, 0, int(counts[m, e])) for m, e in np.argwhere(counts)]
        for m, e in np.argwhere(counts):
            out += [(m, e, at, number, limb) for at in range(width) for number, limb in _limbs(int(sums[m, e, at]))]
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64())
        columns = zip(*out, strict=True) if out else ([],) * 5
        yield pa.RecordBatch.from_arrays([pa.array([int(v) for v in c], k) for c, k in zip(columns, kinds, strict=True)], names=["part", "entry", "at", "limb", "total"])

    partial = kept.select("vector").mapInArrow(run, "part int, entry int, at int, limb int, total long")
    total, count = {}, {}
    # At most parts x entries x components rows, and a few limbs of each.
    for r in partial.groupBy("part", "entry", "at", "limb").agg(F.sum("total").alias("total")).collect():
        if r["at"] < 0:
            count[r["part"], r["entry"]] = r["total"]
        else:
            total[r["part"], r["entry"], r["at"]] = total.get((r["part"], r["entry"], r["at"]), 0) + (r["total"] << (LIMB * r["limb"]))
    fresh = []
    for m, book in enumerate(books):
        rows = [[total[m, e, at] // count[m, e] for at in range(width)] if (m, e) in count else book[e].tolist() for e in range(len(book))]
        fresh.append(_as_book(rows))
    return fresh


def _as_book(rows: list[list[int]]) -> np.ndarray:
    big = any(abs(v) >= small(len(row)) for row in rows for v in row)
    return np.array(rows, dtype=object if big else np.int64).reshape(len(rows), -1)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, label and vector (doubles) of the rows whose vector is there and has only finite components."""
    v = F.col("embedding").cast("array<double>")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(v.isNotNull()).where(good).select("vec_id", "label", v.alias("vector"))


def first_books(kept: DataFrame, size: int, parts: int, entries: int) -> list[np.ndarray]:
    """Codebooks of the parts of the vectors with the smallest ids; a repeated id gives its smallest vector."""
    ids = kept.where("vec_id is not null").select("vec_id").distinct().orderBy("vec_id").limit(entries)
    rows = kept.join(F.broadcast(ids), "vec_id", "left_semi").groupBy("vec_id").agg(F.min("vector").alias("vector")).orderBy("vec_id").collect()
    if not rows:  # only null ids: the smallest vectors
        rows = kept.select("vector").distinct().orderBy("vector").limit(entries).collect()
    width = size // parts
    held = _matrix(pa.array([r["vector"] for r in rows], pa.list_(pa.float64())), size, width).tolist()
    return [_as_book([row[m * width : (m + 1) * width] for row in held]) for m in range(parts)]


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every row with a usable vector.

    ``code`` has two hex digits for each part; ``error`` is the sum of squared
    distances to the chosen entries, ``label_error`` its sum over equal labels
    (null labels together), both cut to the range of a long; the hash is that of
    all final entries' components, comma-joined. Rows whose vector is null or has
    null or non-finite components are left out; any finite component takes part,
    whatever its size. Rows that repeat an id are coded each; the first codebooks
    take an id once, null ids only if there are no others. Vectors whose length is
    no multiple of ``parts``, or is below that of the longest, count as followed by
    zeros. Fewer than ``entries`` ids give shorter codebooks. An empty table gives
    an empty result. Other columns are not read.
    """
    kept = checkpointed(usable(vectors))
    longest = kept.agg(F.max(F.size("vector")).alias("n")).first()["n"]
    size = max(1, -(-(longest or 0) // parts)) * parts
    books = [] if longest is None else first_books(kept, size, parts, entries)
    for _ in range(rounds if books else 0):
        books = _means(kept, books, size)
    text = ",".join(str(int(v)) for book in books for row in book for v in row)
    width, trees = size // parts, [build(book) for book in books]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _matrix(batch.column(2), size, width)
            found = [nearest(tree, rows[:, m * width : (m + 1) * width]) for m, tree in enumerate(trees)]
            codes = np.stack([f.entry for f in found], axis=1).astype(np.uint8).tobytes().hex()
            error = [min(MOST, sum(map(int, each))) for each in zip(*(f.square.tolist() for f in found), strict=True)]
            step = 2 * len(trees)
            code = [codes[at : at + step] for at in range(0, len(codes), step)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(code, pa.string()), pa.array(error, pa.int64())], names=["vec_id", "label", "code", "error"])

    kind = dict(kept.dtypes)
    coded = kept.mapInArrow(run, f"vec_id {kind['vec_id']}, label {kind['label']}, code string, error long")
    coded = checkpointed(coded)
    sums = coded.groupBy(F.col("label").alias("of")).agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(MOST).cast("decimal(38,0)")).cast("long").alias("label_error"))
    named = coded.join(broadcast_if_small(sums), F.col("label").eqNullSafe(F.col("of")))
    return named.select("vec_id", "code", "error", "label_error", F.lit(hashlib.sha256(text.encode()).hexdigest()).alias("codebooks_sha256"))
