"""Token counts of documents in flat token files that have no index.

A token file is one run of token ids in which an end-of-document id closes every
document. It is met in blocks of fixed size; a document may lie across any number
of blocks. Each block is searched for separators as one numpy array; its summary
(tokens, separators, first and last separator) is small. A prefix scan over the
summaries of a file gives every block its first document number, its position and
the last separator before it, which stitches documents that cross blocks. The scan
has two levels, so one huge file is no single task.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulseloom.session import broadcast_if_small, checkpointed

BLOCK = 1 << 16  # tokens
GROUP = 1024  # blocks whose summaries are scanned together
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
END = 50256
_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
# Runs of what the pattern calls blank (Unicode White_Space) that are too long for its look-ahead.
_LONG_BLANKS = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{10000,}")


@lru_cache(maxsize=2)
def _encoding(ranks: str):
    import tiktoken

    with open(ranks, "rb") as lines:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("flat", pat_str=_PATTERN, mergeable_ranks=table, special_tokens={})


def encode(text: str, ranks: str = RANKS) -> list[int]:
    """Token ids of a text.

    A very long run of blanks is cut out where the pattern itself splits: before
    it, and before its last blank if anything follows.
    """
    plain, out, at = _encoding(ranks).encode_ordinary, [], 0
    for run in _LONG_BLANKS.finditer(text):
        cut = run.end() if run.end() == len(text) else run.end() - 1
        out += plain(text[at : run.start()]) + plain(text[run.start() : cut])
        at = cut
    return out + plain(text[at:])


_FILES = "stream long, block long, data binary, first long, ids array<long>"


def write_stream(docs: DataFrame, ranks: str = RANKS, end: int = END) -> DataFrame:
    """``docs`` (doc_id, text) as flat token streams, one per partition, in blocks of BLOCK 16-bit ids.

    Rows (stream, block, data) hold the tokens; rows (stream, first, ids) name the
    documents in the order they were written, ``first`` being the number of the
    first. Every text is followed by the end id; null and empty texts are the end
    id alone. Write the result before using it: a stream is a partition.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, block, number, held, size = TaskContext.get().partitionId(), 0, 0, [], 0

        def row(block=None, data=None, first=None, ids=None):
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((stream, block, data, first, ids), kinds, strict=True)], names=["stream", "block", "data", "first", "ids"])

        for batch in batches:
            yield row(first=number, ids=batch.column(0).to_pylist())
            number += batch.num_rows
            for text in batch.column(1):
                ids = np.array([*encode(text.as_py() or "", ranks), end], np.uint16)
                held.append(ids)
                size += len(ids)
                if size >= BLOCK:
                    flat = np.concatenate(held)
                    for at in range(0, size - BLOCK + 1, BLOCK):
                        yield row(block, flat[at : at + BLOCK].tobytes())
                        block += 1
                    held, size = [flat[size - size % BLOCK :]], size % BLOCK
        if size:
            yield row(block, np.concatenate(held).tobytes())

    return docs.select("doc_id", "text").mapInArrow(run, _FILES)


def read_files(spark: SparkSession, path: str, width: int = 2, end: int = END) -> DataFrame:
    """Blocks (stream, block, data) of flat binary token files below ``path``; a stream is named by its path's hash.

    Files may have any size: Spark cuts them at a byte that every end id has, in
    its own file systems, so a task reads a range of a file and no file is ever one
    value (a document is, so one may have up to 2 GB). Ranges begin anywhere in a
    block; a running sum of their lengths gives each its place, and the few blocks
    that two ranges share are put together.
    """
    mark, step = chr(end & 255), BLOCK * width
    lines = spark.read.option("lineSep", mark).option("encoding", "ISO-8859-1").text(path)
    place = [F.xxhash64("_metadata.file_path").alias("stream"), F.col("_metadata.file_block_start").alias("range")]
    lines = lines.select(*place, F.col("_metadata.file_size").alias("size"), F.col("value").cast("binary").alias("data"))
    # Every line ends with the mark, but perhaps the last of a file; its size tells.
    ranges = lines.groupBy("stream", "range").agg(F.sum(F.octet_length("data") + 1).alias("n"), F.max("size").alias("size"))
    whole = Window.partitionBy("stream")
    ranges = ranges.withColumn("base", F.sum("n").over(whole.orderBy("range")) - F.col("n")).withColumn("spare", F.sum("n").over(whole) - F.col("size"))
    # Readers drop a byte order mark at the start of a file: then 3 bytes are missing.
    lost = F.when(F.col("spare") < 0, 3).otherwise(0)
    ranges = checkpointed(ranges.select("stream", "range", (F.col("base") + F.when(F.col("range") > 0, lost).otherwise(0)).alias("base"), "size", lost.alias("lost")))
    ordered = lines.select("stream", "range", "data", F.monotonically_increasing_id().alias("line"))
    placed = ordered.join(broadcast_if_small(ranges), ["stream", "range"]).repartition("stream", "range").sortWithinPartitions("stream", "range", "line")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, pos, size, held = None, 0, 0, bytearray()

        def parts(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal pos
            while held and (last or len(held) > step):
                n = min(len(held), step - pos % step)
                part = bytes(held[:n])
                del held[:n]
                columns = [pa.array([v], k) for v, k in zip((at[0], pos // step, pos % step, part), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)]
                pos += n
                yield pa.RecordBatch.from_arrays(columns, names=["stream", "block", "first", "data"])

        for batch in batches:
            rows = zip(*(batch.column(i).to_pylist() for i in range(5)), batch.column(5), strict=True)
            for stream, start, base, total, lost, data in rows:
                if (stream, start) != at:
                    if at:
                        yield from parts(True)
                    at, pos, size = (stream, start), base, total
                    held += b"\xef\xbb\xbf" if lost and not start else b""
                held += data.as_buffer()
                if pos + len(held) < size:
                    held += mark.encode("latin-1")
                yield from parts(False)
        if at:
            yield from parts(True)

    made = placed.select("stream", "range", "base", "size", "lost", "data").mapInArrow(run, "stream long, block long, first long, data binary")
    joined = made.groupBy("stream", "block").agg(F.array_sort(F.collect_list(F.struct("first", "data"))).alias("parts"))
    return joined.select("stream", "block", F.aggregate("parts", F.lit(b""), lambda done, part: F.concat(done, part["data"])).alias("data"))


def scan(blocks: DataFrame, end: int = END, width: int = 2) -> DataFrame:
    """stream, number, n_tokens of every document in ``blocks`` (stream, block, data); the end id is not counted.

    Blocks of a stream are numbered in order; sizes may differ, and null data is an
    empty block. A last document without its end id counts if it has tokens. Empty
    documents have 0 tokens. ``width`` is 2 or 4 bytes an id, little-endian.
    """
    kind = {2: "<u2", 4: "<u4"}[width]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for stream, block, data in zip(*(batch.column(i) for i in range(3)), strict=True):
                ids = np.frombuffer(data.as_buffer(), kind) if data.is_valid else np.zeros(0, kind)
                at = np.flatnonzero(ids == end)
                out.append((stream.as_py(), block.as_py(), len(ids), len(at), int(at[0]) if len(at) else None, int(at[-1]) if len(at) else None, (np.diff(at) - 1).tolist()))
            kinds = (*[pa.int64()] * 6, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["stream", "block", "n", "ends", "first_end", "last_end", "inner"])

    found = blocks.select("stream", "block", "data").mapInArrow(run, "stream long, block long, n long, ends long, first_end long, last_end long, inner array<long>")
    found = checkpointed(found.withColumn("part", F.floor(F.col("block") / GROUP)))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    inside = before(Window.partitionBy("stream", "part").orderBy("block"))
    across = before(Window.partitionBy("stream").orderBy("part"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    # Positions and document numbers by sums, the separator before a block by a maximum.
    local = found.withColumn("pos", zero(F.sum("n").over(inside))).withColumn("number", zero(F.sum("ends").over(inside)))
    local = local.withColumn("end_before", F.max(F.col("pos") + F.col("last_end")).over(inside))
    parts = local.groupBy("stream", "part").agg(F.sum("n").alias("size"), F.sum("ends").alias("ends"), F.max(F.col("pos") + F.col("last_end")).alias("last"))
    parts = parts.withColumn("base", zero(F.sum("size").over(across))).withColumn("base_number", zero(F.sum("ends").over(across)))
    parts = parts.withColumn("base_end", F.max(F.col("base") + F.col("last")).over(across)).withColumn("last", F.col("base") + F.col("last"))
    joined = local.join(parts.select("stream", "part", "base", "base_number", "base_end"), ["stream", "part"])
    start = F.coalesce(F.col("base") + F.col("end_before"), F.col("base_end"), F.lit(-1).cast("long"))
    lengths = F.concat(F.array(F.col("base") + F.col("pos") + F.col("first_end") - start - 1), F.col("inner"))
    closed = joined.where("ends > 0").select("stream", (F.col("base_number") + F.col("number")).alias("first"), F.posexplode(lengths).alias("at", "n_tokens"))
    closed = closed.select("stream", (F.col("first") + F.col("at")).alias("number"), "n_tokens")
    tail = parts.groupBy("stream").agg(F.sum("ends").alias("number"), (F.sum("size") - F.coalesce(F.max("last"), F.lit(-1).cast("long")) - 1).alias("n_tokens"))
    return closed.unionByName(tail.where("n_tokens > 0"))


def token_counts(docs: DataFrame, ranks: str = RANKS, end: int = END) -> DataFrame:
    """doc_id, stream, number, n_tokens of every row of ``docs``: tokenised into flat streams, then counted by :func:`scan`.

    Rows keep null and repeated ids; an empty table gives an empty result.
    """
    table = checkpointed(write_stream(docs, ranks, end))
    counts = scan(table.where("block is not null"), end)
    names = table.where("ids is not null").select("stream", "first", F.posexplode("ids").alias("at", "doc_id")).select("stream", (F.col("first") + F.col("at")).alias("number"), "doc_id")
    return names.join(counts, ["stream", "number"]).select("doc_id", "stream", "number", "n_tokens")
