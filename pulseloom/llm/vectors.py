"""Search of a stated query set against all vectors, in blocks.

Vectors are dealt to blocks by a hash of their id, queries to chunks; a task holds
one block and one chunk, so neither side is ever whole in one place. A block
returns the best of each query, and those few rows meet per query.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulseloom.session import checkpointed

BLOCK, CHUNK = 16_384, 4096


def usable(vectors: DataFrame, nonzero: bool) -> DataFrame:
    """vec_id and vector (doubles) of the rows that take part.

    Left out: null ids, null vectors, null or non-finite components and, if
    ``nonzero``, vectors of zeros. Rows that repeat an id count once, with the
    smallest of their vectors. Other columns are not read.
    """
    v = F.col("embedding").cast("array<double>")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    if nonzero:
        good &= F.exists(v, lambda x: x != 0)
    kept = vectors.where(F.col("vec_id").isNotNull() & v.isNotNull()).where(good)
    return kept.groupBy("vec_id").agg(F.min(v).alias("vector"))


Search = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], Iterator[tuple]]


def search(vectors: DataFrame, every: int, k: int, score: str, find: Search) -> DataFrame:
    """The ``k`` best other vectors of every vector whose id is divisible by ``every``.

    ``find(ids, block, query_ids, queries)`` yields for a query its best ids and
    scores in one block, its own id left out; it may also yield a list of bytes (or
    nulls) by which equal scores are told apart, the larger first. Only vectors of
    equal length are compared. Ties go to the smaller id. Without vectors the result is empty.
    """
    held = checkpointed(vectors)
    asked = F.col("vec_id") % every == 0
    n, q = held.agg(F.count(F.lit(1)), F.count_if(asked)).first()
    blocks, chunks = max(1, -(-n // BLOCK)), max(1, -(-q // CHUNK))
    dealt = held.withColumn("size", F.size("vector"))
    rows = dealt.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks))).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    asks = dealt.where(asked).withColumn("chunk", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(chunks)).cast("int"))
    asks = asks.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))

    def matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        flat = table["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        return table["vec_id"].to_numpy(), flat.reshape(table.num_rows, -1)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out, apart = [(np.zeros(0, np.int64),) * 3], []
        if left.num_rows and right.num_rows:
            for query, ids, scores, *beyond in find(*matrix(left), *matrix(right)):
                out.append((np.full(len(ids), query), ids, scores))
                apart += beyond[0] if beyond else [None] * len(ids)
        a, b, c = (np.concatenate(x) for x in zip(*out, strict=True))
        scored = pa.array(c.tolist(), pa.int64() if score == "long" else pa.float64())
        return pa.table({"query_id": pa.array(a, pa.int64()), "vec_id": pa.array(b, pa.int64()), "score": scored, "apart": pa.array(apart, pa.binary())})

    keys = ["block", "chunk", "size"]
    near = rows.select(*keys, "vec_id", "vector").groupBy(*keys).cogroup(asks.select(*keys, "vec_id", "vector").groupBy(*keys)).applyInArrow(run, f"query_id long, vec_id long, score {score}, apart binary")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("apart").desc(), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def scale_of(*blocks: np.ndarray) -> int:
    """The power of two to divide by before squares are taken: 0 unless squares or sums of them could leave the doubles."""
    most = max(float(np.abs(b).max(initial=0)) for b in blocks)
    return 0 if most < 2.0**400 else int(np.frexp(most)[1])


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    if len(ids) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= least)
        return some[np.lexsort((ids[some], -scores[some]))[:k]]
    return np.lexsort((ids, -scores))[:k]
