"""Divergence of sources: how far the terms of each source of a language lie from those of its other sources.

Terms are runs of ASCII letters and of all characters beyond ASCII, A-Z as a-z. A
language keeps the terms that enough of its documents hold. A group is one source
of one language; its share of a term is ``1 + floor(10^9 (count + 2) / (N + 2 V))``,
N the group's occurrences of kept terms and V their number. Two shares p and q are
``floor((p - q)^2 / (p + q))`` apart. All arithmetic is on whole numbers.

The sum over all kept terms for every two groups is a product of the sparse
group-by-term matrix with its own transpose, done row by row after Gustavson: the
term-major index (which groups hold a term, and how often) is cut into buckets of
terms; a task takes the rows of its bucket one after another, scatters each of a
row's terms through the index into one dense accumulator over the peers, and sends
that on. No pair of postings leaves a task. What a row adds where a peer lacks the
term needs only the distinct counts of the row; what neither has is a product.
With p0 the share of count 0, each kept term adds to a pair (G, S)::

    f(p0G, p0S)                                                    always
    f(pG, p0S) - f(p0G, p0S)                                       if G has it
    f(p0G, pS) - f(p0G, p0S)                                       if S has it
    f(pG, pS) - f(pG, p0S) - f(p0G, pS) + f(p0G, p0S)              if both have it
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulseloom.llm.words import LOWER, SLICE_BYTES, Texts, pieces, slices
from pulseloom.session import broadcast_if_small, checkpointed

LEAST, TOP = 10, 10
UNIT = 1_000_000_000
HELD = 1 << 19  # counted terms a scan task holds before it sends them on
POSTINGS, MOST_POSTINGS = 1 << 16, 1 << 22  # of a bucket; more where there are many sources, as each row sends one number per source
STEP = 1 << 20  # numbers scattered at once: their sums stay exact in doubles

TERM = np.zeros(256, bool)
TERM[65:91] = TERM[97:123] = TERM[128:] = True
_GAP = ~TERM


def terms(texts: Texts) -> tuple[np.ndarray, pa.LargeStringArray]:
    """Text (from 0) and term of every occurrence, in order."""
    inside = TERM[texts.data]
    edge = np.zeros(len(inside) + 1, bool)
    edge[texts.offsets] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last[:-1] &= ~inside[1:] | edge[1:-1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    # The bytes of all terms, end to end, are the bytes inside.
    bounds = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int64)
    packed = LOWER[texts.data[inside]]
    found = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(bounds), pa.py_buffer(packed))
    return np.searchsorted(texts.offsets, start, side="right") - 1, found


def _counted(texts: Texts, group: np.ndarray) -> pa.Table:
    """group, term, count, docs of a run of texts; ``group`` has a number for each text."""
    parts = [texts] if len(texts.data) <= SLICE_BYTES else [Texts(0, 1, texts.data[a:b], np.array([0, b - a])) for a, b in pieces(texts.data, _GAP)]
    if texts.hi - texts.lo > 1:
        parts = [texts]
    found = []
    for part in parts:
        doc, held = terms(part)
        held = held.dictionary_encode()
        size = max(1, len(held.dictionary))
        pair, n = np.unique(doc * size + held.indices.to_numpy().astype(np.int64), return_counts=True)
        found.append(pa.table({"doc": pair // size, "term": held.dictionary.take(pa.array(pair % size)), "n": n}))
    whole = found[0] if len(found) == 1 else pa.concat_tables(found).group_by(["doc", "term"]).aggregate([("n", "sum")]).rename_columns(["doc", "term", "n"])
    held = whole["term"].combine_chunks()
    held = (held.chunk(0) if isinstance(held, pa.ChunkedArray) else held).dictionary_encode() if len(held) else pa.array([], pa.large_string()).dictionary_encode()
    size = max(1, len(held.dictionary))
    key, at = np.unique(group[whole["doc"].to_numpy()] * size + held.indices.to_numpy().astype(np.int64), return_inverse=True)
    count = np.zeros(len(key), np.int64)
    np.add.at(count, at, whole["n"].to_numpy())
    docs = np.bincount(at, minlength=len(key)).astype(np.int64)
    return pa.table({"group": key // size, "term": held.dictionary.take(pa.array(key % size)), "count": count, "docs": docs})


_COUNTS = "lang string, source string, term string, count long, docs long"


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, count, docs: occurrences of every term in a group, and in how many of its documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def merged() -> pa.Table:
            return pa.concat_tables(held).group_by(["lang", "source", "term"]).aggregate([("count", "sum"), ("docs", "sum")]).rename_columns(["lang", "source", "term", "count", "docs"])

        def send(table: pa.Table) -> list[pa.RecordBatch]:
            plain = pa.schema([(c, pa.string() if c in ("lang", "source", "term") else pa.int64()) for c in table.column_names])
            return table.cast(plain).combine_chunks().to_batches(max_chunksize=1 << 16)

        for batch in batches:
            names = [pc.fill_null(batch.column(i), "").dictionary_encode() for i in (0, 1)]
            codes = [c.indices.to_numpy().astype(np.int64) for c in names]
            group = codes[0] * max(1, len(names[1].dictionary)) + codes[1]
            for texts in slices(batch.column(2)):
                found = _counted(texts, group[texts.lo : texts.hi])
                of = found["group"].to_numpy()
                size = max(1, len(names[1].dictionary))
                lang, source = names[0].dictionary.take(pa.array(of // size)), names[1].dictionary.take(pa.array(of % size))
                held.append(pa.table({"lang": lang, "source": source, "term": found["term"], "count": found["count"], "docs": found["docs"]}))
                rows += len(of)
                if rows > HELD:
                    held = [merged()]
                    rows = held[0].num_rows
                    if rows > HELD // 2:
                        yield from send(held[0])
                        held, rows = [], 0
        if held:
            yield from send(merged())

    partial = docs.select("lang", "source", "text").mapInArrow(run, _COUNTS)
    return partial.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))


def share(count: str, n: str, v: str) -> Column:
    """The share of ``count`` occurrences in a group of ``n`` among ``v`` kept terms, as a whole number."""
    return F.expr(f"1 + cast({UNIT} as decimal(10,0)) * cast({count} + 2 as decimal(20,0)) div cast({n} + 2 * {v} as decimal(20,0))")


def apart(p: str, q: str) -> Column:
    return F.expr(f"({p} - {q}) * ({p} - {q}) div ({p} + {q})")


def _share(count: np.ndarray, n: np.ndarray, v: int) -> np.ndarray:
    if not len(count) or int(count.max()) < (1 << 62) // UNIT:
        return 1 + UNIT * (count + 2) // (n + 2 * v)
    return (1 + UNIT * (count.astype(object) + 2) // (n.astype(object) + 2 * v)).astype(np.int64)


def _apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def accumulate(term: np.ndarray, group: np.ndarray, count: np.ndarray, n: np.ndarray, v: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each group of a bucket of postings its row: what terms both groups have add for each peer, and what the group's own terms add.

    ``term`` numbers the bucket's terms from 0; ``n`` holds the occurrences of kept terms of every group of the language.
    """
    p, none = _share(count, n[group], v), _share(np.zeros(len(n), np.int64), n, v)
    by_term = np.argsort(term, kind="stable")
    index_group, index_share = group[by_term], p[by_term]
    begin = np.searchsorted(term[by_term], np.arange(int(term.max(initial=-1)) + 2))
    by_group = np.argsort(group, kind="stable")
    for own in np.split(by_group, np.flatnonzero(np.diff(group[by_group])) + 1):
        if not len(own):
            continue
        g = int(group[own[0]])
        base = _apart(none[g], none)
        both, alone = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
        size = begin[term[own] + 1] - begin[term[own]]
        cuts = np.flatnonzero(np.diff(np.cumsum(size) // STEP)) + 1
        for some, sizes in zip(np.split(own, cuts), np.split(size, cuts), strict=True):
            at = np.arange(sizes.sum()) + np.repeat(begin[term[some]] - np.cumsum(sizes) + sizes, sizes)
            peer, theirs, mine = index_group[at], index_share[at], np.repeat(p[some], sizes)
            add = _apart(mine, theirs) - _apart(mine, none[peer]) - _apart(none[g], theirs) + base[peer]
            both += np.bincount(peer, weights=add, minlength=len(n)).astype(np.int64)
        value, times = np.unique(p[own], return_counts=True)
        step = max(1, STEP // len(n))
        for lo in range(0, len(value), step):
            alone += ((_apart(value[lo : lo + step, None], none) - base) * times[lo : lo + step, None]).sum(axis=0)
        yield g, both, alone


def _rows(index: DataFrame, peers: DataFrame, langs: DataFrame) -> DataFrame:
    """lang, i, j, value: what the terms that at least one of groups i and j has add to their pair, beyond the terms' base."""
    wide = F.least(F.col("sources") * F.col("sources"), F.lit(MOST_POSTINGS))
    cut = langs.select("lang", F.ceil(F.col("postings") / F.greatest(F.lit(POSTINGS), wide)).cast("long").alias("buckets"))
    numbered = index.join(broadcast_if_small(peers.select("lang", "source", "i")), ["lang", "source"]).join(broadcast_if_small(cut), "lang")
    cells = numbered.select("lang", F.pmod(F.xxhash64("term"), "buckets").alias("bucket"), "term", "i", "count")
    beside = peers.join(broadcast_if_small(cut), "lang").select("lang", F.explode(F.sequence(F.lit(0).cast("long"), F.col("buckets") - 1)).alias("bucket"), F.col("i").alias("peer"), F.col("n").alias("of_peer"), F.col("v").alias("terms"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        order = np.argsort(right["peer"].to_numpy())
        n = right["of_peer"].to_numpy()[order]
        out = []
        if left.num_rows:
            term = left["term"].combine_chunks()
            term = (term.chunk(0) if isinstance(term, pa.ChunkedArray) else term).dictionary_encode().indices.to_numpy().astype(np.int64)
            out = list(accumulate(term, left["i"].to_numpy().astype(np.int64), left["count"].to_numpy(), n, int(right["terms"][0].as_py())))
        lang = left["lang"][0].as_py() if left.num_rows else ""
        kind = pa.list_(pa.int64())
        return pa.table(
            {"lang": pa.array([lang] * len(out), pa.string()), "i": pa.array([g for g, _, _ in out], pa.int32()), "both": pa.array([b for _, b, _ in out], kind), "alone": pa.array([a for _, _, a in out], kind)}
        )

    made = cells.groupBy("lang", "bucket").cogroup(beside.groupBy("lang", "bucket")).applyInArrow(run, "lang string, i int, both array<long>, alone array<long>")
    each = made.select("lang", "i", F.posexplode(F.arrays_zip("both", "alone")).alias("j", "add"))
    # Both groups of a pair get what the terms of the one add.
    ways = F.array(F.struct("i", "j", (F.col("add.both") + F.col("add.alone")).alias("value")), F.struct(F.col("j").alias("i"), F.col("i").alias("j"), F.col("add.alone").alias("value")))
    return each.select("lang", F.explode(ways).alias("way")).groupBy("lang", "way.i", "way.j").agg(F.sum("way.value").alias("value"))


def audit(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank.

    Part ``pair``: for every group each other source of its language and their
    distance over all kept terms (0 if there are none), all ranks. Part ``term``:
    the kept terms the group holds with a share above that in its language, and how
    far it is apart from that, ranks up to ``top``. Ranks count from 1 for each group
    and part, higher values first, ties by the bytes of the item. Null texts,
    languages and sources are read as ''. Groups without terms take part. Every row
    is a document, whatever ids repeat. An empty table gives an empty result; other
    columns are not read.

    The result has a row for every two groups of a language; memory of a task holds
    one number per source of a language.
    """
    named = [F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")]
    groups = docs.select(*named).distinct()
    counts = checkpointed(term_counts(docs))
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("count").alias("total")).where(F.col("docs") >= least).select("lang", "term", "total")
    index = checkpointed(counts.join(kept, ["lang", "term"]).select("lang", "source", "term", "count", "total"))
    own = index.groupBy("lang", "source").agg(F.sum("count").alias("n"), F.count(F.lit(1)).alias("postings"))
    vocabulary = index.select("lang", "term", "total").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("total").alias("n_lang"))
    peers = groups.join(own, ["lang", "source"], "left").join(vocabulary, "lang", "left").na.fill(0, ["n", "v", "n_lang", "postings"])
    # One row per group: a source's number among those of its language.
    peers = checkpointed(peers.withColumn("i", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1))
    langs = peers.groupBy("lang").agg(F.sum("postings").alias("postings"), F.count(F.lit(1)).alias("sources"))

    with_shares = index.join(broadcast_if_small(peers.select("lang", "source", "n", "v", "n_lang")), ["lang", "source"])
    with_shares = with_shares.select("lang", "source", F.col("term").alias("item"), share("count", "n", "v").alias("p"), share("total", "n_lang", "v").alias("q"))
    term = with_shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), "item", apart("p", "q").alias("value"))

    every = peers.join(broadcast_if_small(langs.select("lang", "sources")), "lang")
    every = every.select("lang", "source", "i", "n", "v", F.explode(F.sequence(F.lit(0), (F.col("sources") - 1).cast("int"))).alias("j")).where("i <> j")
    other = peers.select("lang", F.col("i").alias("j"), F.col("source").alias("item"), F.col("n").alias("m"))
    shares = every.join(other, ["lang", "j"]).withColumn("p", F.when(F.col("v") > 0, share("0", "n", "v"))).withColumn("q", F.when(F.col("v") > 0, share("0", "m", "v")))
    base = F.coalesce(F.col("v") * apart("p", "q"), F.lit(0))
    pair = shares.join(_rows(index, peers, langs.where("postings > 0")), ["lang", "i", "j"], "left")
    pair = pair.select("lang", "source", F.lit("pair").alias("part"), "item", (base + F.coalesce("value", F.lit(0))).cast("long").alias("value"))

    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    best = term.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return best.unionByName(pair.withColumn("rank", F.row_number().over(order)))
