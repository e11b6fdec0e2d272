"""Approximate nearest neighbours by inner product: randomly rotated one-bit codes.

A vector is its block's mean plus ``r * u`` with u of length 1. u is turned by a
random rotation and kept as one bit per coordinate, packed, with two correction
scalars: r and ``t``, the inner product of the turned u with its code. For a
turned query, code and scalars give an unbiased estimate of ``u . q``; its error
is at most ``|q| * sqrt((1 - t^2) / t^2) * EPS / sqrt(dim - 1)`` but for a small
probability. Vectors whose upper bound reaches the k-th best lower bound are
reranked with exact inner products.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from pulseloom.llm.vectors import best, scale_of, search, usable

EPS = 2.5
BATCH = 128


def rotation(size: int) -> np.ndarray:
    """A fixed random rotation."""
    q, r = np.linalg.qr(np.random.default_rng(11).normal(size=(size, size)))
    return q * np.sign(np.diag(r))


class Codes:
    """Packed codes of one block."""

    def __init__(self, block: np.ndarray):
        self.size = block.shape[1]
        self.mean = block.mean(axis=0)
        rest = block - self.mean
        self.r = np.linalg.norm(rest, axis=1)
        turned = (rest / np.maximum(self.r, 1e-300)[:, None]) @ rotation(self.size).T
        self.packed = np.packbits(turned >= 0, axis=1)
        self.t = np.maximum(np.abs(turned).sum(axis=1) / np.sqrt(self.size), 1e-9)

    def estimate(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Estimated inner products (queries by vectors) and their error bounds."""
        turned = queries @ rotation(self.size).T
        sign = np.unpackbits(self.packed, axis=1, count=self.size).astype(np.float32) * 2 - 1
        raw = (turned.astype(np.float32) @ sign.T) / np.sqrt(self.size)
        guess = (queries @ self.mean)[:, None] + raw * (self.r / self.t)
        spread = self.r * np.sqrt(np.maximum(0.0, 1 - self.t**2)) / self.t * EPS / np.sqrt(max(1, self.size - 1))
        return guess, np.linalg.norm(queries, axis=1)[:, None] * spread + 1e-6 * (1 + np.abs(guess))


def _products(rows: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products, row by row; where a term or a sum leaves the doubles on the way, of the scaled vectors."""
    with np.errstate(over="ignore", invalid="ignore"):
        exact = (rows * q).sum(axis=1)
        odd = ~np.isfinite(exact)
        if odd.any():
            power = scale_of(rows, q)
            exact[odd] = np.ldexp((np.ldexp(rows[odd], -power) * np.ldexp(q, -power)).sum(axis=1), 2 * power)
    return exact


def _in_block(k: int):
    def find(ids: np.ndarray, block: np.ndarray, query_ids: np.ndarray, queries: np.ndarray) -> Iterator[tuple]:
        # Codes and estimates in units in which squares stay in range; scores come from the vectors as they are.
        power = scale_of(block, queries)
        codes = Codes(np.ldexp(block, -power))
        for lo in range(0, len(queries), BATCH):
            guess, error = codes.estimate(np.ldexp(queries[lo : lo + BATCH], -power))
            for own, q, g, e in zip(query_ids[lo : lo + BATCH], queries[lo : lo + BATCH], guess, error, strict=True):
                other = ids != own
                low = np.where(other, g - e, -np.inf)
                least = np.partition(low, len(low) - k)[len(low) - k] if len(low) > k else -np.inf
                some = np.flatnonzero((g + e >= least) & other)
                # Row by row, so that equal vectors get equal sums wherever they lie.
                exact = _products(block[some], q)
                top = best(ids[some], exact, k)
                yield int(own), ids[some[top]], exact[top]

    return find


def nearest(vectors: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: each query's ``k`` nearest found, by largest inner product.

    Queries are the vectors whose vec_id is divisible by ``every``; candidates all
    others. Null ids, null or zero vectors, null or non-finite components take no
    part; repeated ids count once (smallest vector); vectors of other lengths are
    not compared. Scores are exact; those beyond the doubles are infinite. Empty tables give no rows.
    """
    return search(usable(vectors, nonzero=True), every, k, "double", _in_block(k))
