"""Exact top-k by inner product: best-first search in M-trees.

Inner products become distances by one more coordinate: with M the largest norm
of a block, x gets ``sqrt(M^2 - |x|^2)`` and a query 0, so that
``d^2 = |q|^2 + M^2 - 2 q.x``. Each block of vectors is a tree of pages. An entry
of an inner page is a routing vector with the covering radius of its subtree and
its distance to the routing vector above; a leaf entry has that distance too. The
search opens pages by their least possible distance. The triangle inequality over
the stored distances rules entries out before their own distance is computed.
Scores of leaves are exact integers.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame

from pulseloom.llm.vectors import best, scale_of, search, usable

PAGE, FAN = 384, 24
SLACK = 1e-9


class Page(NamedTuple):
    points: np.ndarray  # routing vectors or, in a leaf, the rows themselves (with the added coordinate)
    to_parent: np.ndarray
    radius: np.ndarray | None
    children: list | None
    rows: np.ndarray | None


def build(points: np.ndarray, rows: np.ndarray, parent: np.ndarray | None, rng: np.random.Generator) -> Page:
    """Pages over ``points[rows]``: the nearest of a few routing vectors takes each row; equal rows are cut evenly."""
    own = points[rows]
    to_parent = np.zeros(len(rows)) if parent is None else np.linalg.norm(own - parent, axis=1)
    if len(rows) <= PAGE:
        return Page(own, to_parent, None, None, rows)
    fan = min(FAN, -(-len(rows) // (PAGE // 2)))
    pivots = own[rng.choice(len(rows), fan, replace=False)]
    squared = (own**2).sum(axis=1)[:, None] - 2 * own @ pivots.T + (pivots**2).sum(axis=1)
    group = squared.argmin(axis=1)
    if np.bincount(group, minlength=fan).max() > 0.9 * len(rows):
        group = np.arange(len(rows)) * fan // len(rows)
    members = [rows[group == g] for g in range(fan)]
    held = [g for g in range(fan) if len(members[g])]
    children = [build(points, members[g], pivots[g], rng) for g in held]
    radius = np.array([np.linalg.norm(points[members[g]] - pivots[g], axis=1).max() for g in held])
    pivots = pivots[held]
    above = np.zeros(len(held)) if parent is None else np.linalg.norm(pivots - parent, axis=1)
    return Page(pivots, above, radius, children, None)


def _nearest(root: Page, top: float, exact: np.ndarray, ids: np.ndarray, own_id: int, q: np.ndarray, q_exact: np.ndarray, k: int, unit: int = 1) -> tuple[list, list]:
    size = float(q @ q) + top
    wide = np.append(q, 0.0)
    found: list[tuple] = []  # heap of (score, -id), the worst first
    pages: list[tuple] = [(0.0, 0, None, root)]  # the root has no routing vector above it
    count = 0

    def reach() -> float:
        """The largest distance that can still matter."""
        if len(found) < k:
            return np.inf
        return np.sqrt(max(0.0, size - 2 * float(found[0][0] / unit)) + SLACK * size) * (1 + SLACK)

    while pages:
        least, _, to_q, page = heapq.heappop(pages)
        limit = reach()
        if least > limit:
            break
        bound = np.abs(to_q - page.to_parent) if to_q is not None else np.zeros(len(page.to_parent))
        if page.rows is not None:
            some = page.rows[bound <= limit]
            some = some[ids[some] != own_id]
            scores = exact[some] @ q_exact
            if len(found) == k:
                some, scores = some[scores >= found[0][0]], scores[scores >= found[0][0]]
            if len(some):
                for i in best(ids[some], scores, k):
                    heapq.heappush(found, (scores[i], -int(ids[some[i]])))
                    if len(found) > k:
                        heapq.heappop(found)
            continue
        at = np.flatnonzero(bound - page.radius <= limit)
        dist = np.linalg.norm(page.points[at] - wide, axis=1)
        for i, d in zip(at, dist, strict=True):
            nearest = max(0.0, d - page.radius[i], least)
            if nearest <= limit:
                count += 1
                heapq.heappush(pages, (nearest, count, d, page.children[i]))
    found.sort(reverse=True)
    return [-x[1] for x in found], [x[0] for x in found]


def _whole(block: np.ndarray) -> np.ndarray:
    """``floor(256 x)`` in Python's own integers."""
    exact = lambda x: int(x) * 256 if abs(x) >= 2.0**53 else math.floor(x * 256)
    return np.array([exact(x) for x in block.ravel().tolist()], dtype=object).reshape(block.shape)


def _beyond_long(score: int) -> bytes:
    """Bytes in the order of the scores, for scores of one sign at the ends of a long or beyond."""
    size = -(-abs(score).bit_length() // 8)
    held = size.to_bytes(4, "big") + abs(score).to_bytes(size, "big")
    return held if score > 0 else bytes(255 - b for b in held)


def _in_block(k: int):
    def find(ids: np.ndarray, block: np.ndarray, query_ids: np.ndarray, queries: np.ndarray) -> Iterator[tuple]:
        # Geometry in doubles, divided by a power of two where squares would leave their range.
        power = scale_of(block, queries)
        shrink = lambda x: np.floor(x * 256.0) if not power else np.ldexp(x, 8 - power)
        near, asked = shrink(block), shrink(queries)
        most = max(np.abs(near).max(initial=0), np.abs(asked).max(initial=0))
        # Sums below 2^53 are exact in doubles; beyond them Python's own integers take over.
        small = not power and most * most * max(1, block.shape[1]) < 2.0**53
        exact, asked_exact = (near, asked) if small else (_whole(block), _whole(queries))
        unit = 1 << (2 * power)
        norms = (near**2).sum(axis=1)
        top = float(norms.max())
        points = np.concatenate([near, np.sqrt(np.maximum(0.0, top - norms))[:, None]], axis=1)
        root = build(points, np.arange(len(ids)), None, np.random.default_rng(5))
        for own, q, q_exact in zip(query_ids, asked, asked_exact, strict=True):
            found, scores = _nearest(root, top, exact, ids, int(own), q, q_exact, k, unit)
            cut = [max(-(2**63), min(2**63 - 1, int(s))) for s in scores]
            apart = [_beyond_long(int(s)) if c in (-(2**63), 2**63 - 1) else None for c, s in zip(cut, scores, strict=True)]
            yield int(own), np.array(found, np.int64), np.array(cut, np.int64), apart

    return find


def top_inner_products(vectors: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: each query's ``k`` highest integer inner products over ``floor(256 x)``.

    Queries are the vectors whose vec_id is divisible by ``every``; candidates all
    others. Null ids, null vectors, null or non-finite components take no part;
    repeated ids count once (smallest vector); vectors of other lengths are not
    compared. Scores beyond a long are ranked as they are, then cut to its range. Empty tables give no rows.
    """
    return search(usable(vectors, nonzero=False), every, k, "long", _in_block(k))
