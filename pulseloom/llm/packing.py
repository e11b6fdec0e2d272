"""Best-fit packing of documents into sequences, under conflicts.

Texts longer than a sequence are cut into pieces, so whole texts are packed. A
bin carries a bitmap of its sources and one of its duplicate clusters; a piece may
not join a bin that already has its source or its cluster. Bins are ordered by
residual: the search starts at the tightest bin that has room and goes on until
the first compatible one; if none is, a new bin opens. Pieces come in falling size.

Pieces are dealt to shards of about SHARD rows by hash, each packed on its own:
a task holds one shard, and no key gathers more.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseloom.llm.text import word_count
from pulseloom.session import checkpointed

CAPACITY = 2048
SHARD = 4096


def best_fit(sizes: list[int], sources: list[int], clusters: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset of every piece, in the order given.

    ``sources`` and ``clusters`` are bit numbers, -1 for none (never in conflict).
    A piece fits if its size is at most the residual.
    """
    order: list[tuple[int, int]] = []  # open bins as (residual, number)
    source_bits, cluster_bits, residual = [], [], []
    bins, offsets = [], []
    for size, source, cluster in zip(sizes, sources, clusters, strict=True):
        s, c = 0 if source < 0 else 1 << source, 0 if cluster < 0 else 1 << cluster
        at = bisect_left(order, (size, -1))
        while at < len(order) and (source_bits[order[at][1]] & s or cluster_bits[order[at][1]] & c):
            at += 1
        if at == len(order):
            number = len(residual)
            residual.append(capacity)
            source_bits.append(0)
            cluster_bits.append(0)
        else:
            number = order.pop(at)[1]
        bins.append(number)
        offsets.append(capacity - residual[number])
        residual[number] -= size
        source_bits[number] |= s
        cluster_bits[number] |= c
        if residual[number]:
            insort(order, (residual[number], number))
    return bins, offsets


def _bits(values: pa.ChunkedArray) -> list[int]:
    """Small numbers for values that occur more than once; -1 for null and for the others, which can meet nothing."""
    counts = pc.value_counts(values.drop_null())
    often = [v["values"] for v in counts.to_pylist() if v["counts"] > 1]
    number = {v: i for i, v in enumerate(often)}
    return [number.get(v, -1) for v in values.to_pylist()]


def pack(docs: DataFrame, capacity: int = CAPACITY, cluster: str | None = None, separate_sources: bool = True) -> DataFrame:
    """One row per piece of every document: doc_id, piece, start, tokens, bin_id, bin_offset.

    ``piece`` counts from 0, ``start`` is its first word, ``bin_offset`` its place
    in the bin. ``cluster`` names the column of duplicate clusters (null: none);
    without it, equal texts form a cluster. Texts without words give one row of 0
    tokens with null bin. A null source is a source of its own. Rows that repeat an
    id are packed each for itself. Order and columns beside doc_id, text, source
    and ``cluster`` do not matter.
    """
    group = F.col(cluster) if cluster else F.col("text")
    sized = docs.select(
        "doc_id", F.xxhash64("source").alias("source"), F.when(group.isNotNull(), F.xxhash64(group)).alias("cluster"), F.xxhash64("text").alias("tie"), word_count(F.col("text")).alias("size")
    )
    count = F.greatest(F.lit(1), F.ceil(F.col("size") / capacity)).cast("int")
    pieces = sized.withColumn("piece", F.explode(F.sequence(F.lit(0), count - 1)))
    pieces = pieces.withColumn("start", F.col("piece").cast("long") * capacity).withColumn("tokens", F.least(F.lit(capacity).cast("long"), F.col("size") - F.col("start")))
    held = checkpointed(pieces.drop("size"))
    rows = held.count()
    shards = max(1, -(-rows // SHARD))
    sharded = held.where("tokens > 0").withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "tie"), F.lit(shards)).cast("long"))

    def run(rows: pa.Table) -> pa.Table:
        order = [("tokens", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("tie", "ascending")]
        rows = rows.take(pc.sort_indices(rows, sort_keys=order, null_placement="at_end"))
        sources = _bits(rows["source"]) if separate_sources else [-1] * rows.num_rows
        bins, offsets = best_fit(rows["tokens"].to_pylist(), sources, _bits(rows["cluster"]), capacity)
        shard = rows["shard"][0].as_py()
        placed = rows.select(["doc_id", "piece", "start", "tokens"]).append_column("bin_id", pa.array([(shard << 20) + b for b in bins], pa.int64()))
        return placed.append_column("bin_offset", pa.array(offsets, pa.int64()))

    schema = "doc_id long, piece int, start long, tokens long, bin_id long, bin_offset long"
    packed = sharded.groupBy("shard").applyInArrow(run, schema)
    empty = held.where("tokens <= 0").select("doc_id", "piece", "start", F.lit(0).cast("long").alias("tokens"), F.lit(None).cast("long").alias("bin_id"), F.lit(None).cast("long").alias("bin_offset"))
    return packed.unionByName(empty)
