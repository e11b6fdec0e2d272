"""Jaccard join of documents on word n-grams by rare-first prefix filtering.

A document's set holds its distinct ``width``-word n-grams (fewer words: the whole
sequence as one; none: the empty set, linked with nothing). Two documents are
linked if ``100 * |A & B| >= percent * |A | B|``. With all n-grams ordered from
rare to frequent, linked documents share an n-gram among the first
``n - ceil(percent * n / 100) + 1`` of each: their prefixes.

1. N-grams that only one document has are the rarest. One pass over the texts
   counts, for every document, how many of its n-grams nobody else has; a
   document whose whole prefix is such n-grams is linked with nothing and goes.
   Blocks of documents send each n-gram once, with the document's number only
   where a block holds it once, so a very frequent n-gram gathers one mark a block.
2. Documents with equal sets become one class. The frequencies among the classes
   that are left order their n-grams, and the prefixes become narrow entries: the
   n-gram, the set's size, the position, and how the n-grams behind it spread over
   ranges of hashes.
3. Entries of one n-gram are joined. A pair must pass the length filter; the
   positional filter (what can still be shared behind the common n-gram); and the
   suffix filter (what the ranges behind it cannot share). In a few rounds every
   set meets one, two, four others of another component that pass, and so on; these
   pairs are verified on the full sets and join components. Then all pairs of different components are
   compared, in blocks, the largest component of a group never with itself. Every
   pair that passes is verified once.

Nothing is estimated, so no link is lost, up to 64-bit hashes of n-grams and sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulseloom.llm.components import components
from pulseloom.llm.minhash import verify
from pulseloom.llm.words import SLICE_BYTES, Texts, mix, slices, word_hashes, words
from pulseloom.session import broadcast_if_small, checkpointed

GRAMS = 1 << 21  # n-grams of a block of documents
BUCKET = 1 << 22  # n-grams, about, that one step counts
WORD = 6  # bytes of text for one n-gram, about
RANGES = 32  # of hashes, for the suffix filter
ROUNDS = 6  # of 1, 2, 4 and so on pairs for each set, before all pairs that are left
BLOCK = 1024  # entries of one n-gram that are compared at a time

_STEP = np.random.default_rng(12).integers(1, 1 << 63, 2, dtype=np.uint64) | np.uint64(1)


def gram_sets(texts: Texts, width: int) -> Iterator[np.ndarray]:
    """For each text its sorted distinct n-gram hashes."""
    n_texts = texts.hi - texts.lo
    if n_texts == 1 and len(texts.data) > SLICE_BYTES:
        flat = word_hashes(texts.data)
        bounds = np.array([0, len(flat)])
    else:
        found = words(texts)
        flat, bounds = found.hash, np.searchsorted(found.doc, np.arange(n_texts + 1))
    grams = flat[: max(0, len(flat) - width + 1)].copy()
    for i in range(1, width):
        grams = mix(grams * _STEP[0] + np.uint64(i)) + flat[i : len(flat) - width + 1 + i] if len(grams) else grams
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= width:
            yield np.unique(grams[a : b - width + 1])
        elif b > a:
            whole = np.array([b - a], np.uint64)
            for h in flat[a:b]:
                whole = mix((whole ^ h) * _STEP[1])
            yield whole
        else:
            yield np.zeros(0, np.uint64)


def set_id(grams: np.ndarray) -> np.uint64:
    """A hash of a whole set."""
    two = [grams.sum(dtype=np.uint64), mix(grams ^ _STEP[1]).sum(dtype=np.uint64), np.uint64(len(grams))]
    return mix(mix(mix(np.array(two[:1])) + two[1:2]) + two[2:3])[0]


def _bytes(values: np.ndarray, kind) -> bytes:
    return np.ascontiguousarray(values, dtype=kind).tobytes()


_MARKS = "bucket int, block long, kind int, a binary, b binary, c binary, d binary"


def _marks(docs: DataFrame, width: int, buckets: int) -> DataFrame:
    """Rows of kind 0: ids, set sizes and set hashes of the documents of a block. Rows of kind 1, one for each bucket of
    hashes a block meets: which of its documents (by their place in the block), how many n-grams of each no other
    document of the block has, these n-grams, and the n-grams that several of them have."""

    def block(ids: list[int], sets: list[np.ndarray]) -> Iterator[tuple]:
        size = np.array([len(s) for s in sets], np.int64)
        yield 0, 0, _bytes(ids, np.int64), _bytes(size, np.int64), _bytes([set_id(s) for s in sets], np.uint64), b""
        flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
        order = np.argsort(flat)
        new = np.ones(len(flat), bool)
        new[1:] = flat[order[1:]] != flat[order[:-1]]
        alone = new & np.append(new[1:], True)
        single = np.zeros(len(flat), bool)
        single[order[alone]] = True
        several = flat[order[new & ~alone]]
        flat, owner = flat[single], owner[single]
        of, of_several = (flat >> np.uint64(32)) % np.uint64(buckets), (several >> np.uint64(32)) % np.uint64(buckets)
        by, by_several = np.argsort(of, kind="stable"), np.argsort(of_several, kind="stable")
        cuts = np.searchsorted(of[by], np.arange(buckets + 1, dtype=np.uint64))
        cuts_several = np.searchsorted(of_several[by_several], np.arange(buckets + 1, dtype=np.uint64))
        for bucket in np.flatnonzero((np.diff(cuts) > 0) | (np.diff(cuts_several) > 0)):
            own = by[cuts[bucket] : cuts[bucket + 1]]
            who, count = np.unique(owner[own], return_counts=True)
            shared = several[by_several[cuts_several[bucket] : cuts_several[bucket + 1]]]
            yield int(bucket), 1, _bytes(who, np.uint32), _bytes(count, np.uint32), _bytes(flat[own], np.uint32), _bytes(shared, np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 4)
        names = ["bucket", "block", "kind", "a", "b", "c", "d"]
        ids, sets, held = [], [], 0
        number = TaskContext.get().partitionId() << 32

        def rows() -> Iterator[pa.RecordBatch]:
            for bucket, *row in block(ids, sets):
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((bucket, number, *row), kinds, strict=True)], names=names)

        for batch in batches:
            for texts in slices(batch.column(1)):
                ids += batch.column(0)[texts.lo : texts.hi].to_pylist()
                for own in gram_sets(texts, width):
                    sets.append(own)
                    held += len(own)
                if held >= GRAMS:
                    yield from rows()
                    ids, sets, held = [], [], 0
                    number += 1
        if ids:
            yield from rows()

    return docs.select("doc_id", "text").mapInArrow(run, _MARKS)


def sizes_and_lone_grams(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n, sid and ``lone``, the number of its n-grams that no other row has, of every document.

    ``docs`` must be read in the same order if a task runs again, as stored tables are.
    """
    volume = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    buckets = max(1, -(-volume // (WORD * BUCKET)))
    names = ["block", "kind", "a", "b", "c", "d"]

    def count(marks: list[tuple]) -> Iterator[pa.RecordBatch]:
        """Of the marks of one bucket: for each block how many n-grams of its documents are lone."""
        single, several = (np.concatenate([m[i] for m in marks]) for i in (3, 4))
        grams = np.concatenate([single, several])
        order = np.argsort(grams)
        new = np.ones(len(grams), bool)
        new[1:] = grams[order[1:]] != grams[order[:-1]]
        lone = np.zeros(len(grams), bool)
        lone[order[new & np.append(new[1:], True)]] = True
        total, at = np.concatenate([[0], np.cumsum(lone[: len(single)])]), 0
        for block, who, counts, own, _ in marks:
            ends = at + np.cumsum(counts.astype(np.int64))
            each = total[ends] - total[ends - counts]
            at += len(own)
            row = (block, 1, _bytes(who[each > 0], np.uint32), _bytes(each[each > 0], np.uint32), b"", b"")
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, (pa.int64(), pa.int32(), *[pa.binary()] * 4), strict=True)], names=names)

    def by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            yield pa.RecordBatch.from_arrays(batch.filter(pc.equal(batch.column(2), 0)).columns[1:], names=names)
            for bucket, block, kind, *blobs in zip(*(batch.column(i) for i in range(7)), strict=True):
                if kind.as_py() == 0:
                    continue
                if at != bucket.as_py():
                    if held:
                        yield from count(held)
                    at, held = bucket.as_py(), []
                held.append((block.as_py(), *(np.frombuffer(blob.as_buffer(), np.uint32) for blob in blobs)))
        if held:
            yield from count(held)

    def by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        documents, lone = None, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*map(pa.array, documents), pa.array(lone)], names=["doc_id", "n", "sid", "lone"])

        for batch in batches:
            for kind, *blobs in zip(*(batch.column(i) for i in range(1, 6)), strict=True):
                a, b, c, _ = (blob.as_buffer() for blob in blobs)
                if kind.as_py() == 0:  # the first row of its block
                    if documents:
                        yield done()
                    documents = [np.frombuffer(x, np.int64) for x in (a, b, c)]
                    lone = np.zeros(len(documents[0]), np.int64)
                else:
                    lone[np.frombuffer(a, np.uint32)] += np.frombuffer(b, np.uint32)
        if documents:
            yield done()

    marks = _marks(docs, width, buckets).repartition(buckets, "bucket").sortWithinPartitions("bucket", "kind")
    counts = marks.mapInArrow(by_bucket, "block long, kind int, a binary, b binary, c binary, d binary")
    dealt = counts.repartition("block").sortWithinPartitions("block", "kind")
    return dealt.mapInArrow(by_block, "doc_id long, n long, sid long, lone long")


def class_sets(docs: DataFrame, classes: DataFrame, width: int) -> DataFrame:
    """sid, n and the full set, as bytes, of every class (sid, class_id), read from the text of one of its documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in slices(batch.column(0)):
                sets = list(gram_sets(texts, width))
                sid = np.array([set_id(s) for s in sets], np.uint64).view(np.int64)
                columns = [pa.array(sid), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["sid", "n", "grams"])

    chosen = docs.join(broadcast_if_small(classes.select(F.col("class_id").alias("doc_id")).distinct(), materialize=True), "doc_id", "left_semi")
    made = chosen.select("text").mapInArrow(run, "sid long, n long, grams binary")
    return made.join(classes.select("sid"), "sid", "left_semi").dropDuplicates(["sid"])


def prefix_entries(sets: DataFrame, percent: int) -> DataFrame:
    """gram, sid, n, pos, behind: the prefix n-grams of every set that another set has, too.

    ``pos`` counts from 0 in the order from rare to frequent (ties by hash);
    ``behind`` holds, for RANGES ranges of hashes, how many n-grams that other sets
    have follow in the order.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sid, n, grams in zip(*(batch.column(i) for i in range(3)), strict=True):
                own = np.frombuffer(grams.as_buffer(), np.int64)
                for at in range(0, len(own), 1 << 18):
                    part = own[at : at + (1 << 18)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), sid.as_py())), pa.array(np.full(len(part), n.as_py())), pa.array(part)], names=["sid", "n", "gram"])

    grams = sets.select("sid", "n", "grams").mapInArrow(spread, "sid long, n long, gram long")
    shared = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    # Only n-grams that several sets have travel on; the others come first in the order and are counted by what is missing.
    ranked = grams.join(shared, "gram").select("sid", "n", "df", "gram")

    def entries(sid: int, n: int, gram: np.ndarray) -> pa.RecordBatch | None:
        lone = n - len(gram)
        prefix = n - -(-n * percent // 100) + 1
        some = min(len(gram), prefix - lone)
        if some <= 0:
            return None
        part = (gram.view(np.uint64) >> np.uint64(59)).astype(np.int64)
        seen = np.cumsum(part[:some, None] == np.arange(RANGES), axis=0)
        behind = np.bincount(part, minlength=RANGES) - seen
        lists = pa.ListArray.from_arrays(pa.array(np.arange(some + 1) * RANGES, pa.int32()), pa.array(behind.ravel(), pa.int32()))
        return pa.RecordBatch.from_arrays(
            [pa.array(gram[:some]), pa.array(np.full(some, sid)), pa.array(np.full(some, n)), pa.array(lone + np.arange(some)), lists], names=["gram", "sid", "n", "pos", "behind"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, size, held = None, 0, []
        for batch in batches:
            sid, n, gram = (batch.column(i).to_numpy() for i in range(3))
            cuts = np.flatnonzero(np.diff(sid)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(sid)], strict=True):
                if a == b:
                    continue
                if sid[a] != at:
                    if held and (made := entries(at, size, np.concatenate(held))):
                        yield made
                    at, size, held = int(sid[a]), int(n[a]), []
                held.append(gram[a:b])
        if held and (made := entries(at, size, np.concatenate(held))):
            yield made

    dealt = ranked.repartition("sid").sortWithinPartitions("sid", "df", "gram").select("sid", "n", "gram")
    return dealt.mapInArrow(run, "gram long, sid long, n long, pos long, behind array<int>")


def may_link(a, b, percent: int) -> Column:
    """The three filters for two entries of one n-gram (columns or structs with n, pos, behind)."""
    total = a["n"] + b["n"]
    enough = lambda common: common * (100 + percent) >= total * percent
    length = F.least(a["n"], b["n"]) * 100 >= F.greatest(a["n"], b["n"]) * percent
    behind = F.shiftright(total - _gap(a, b), 1)
    return length & enough(F.least(a["n"] - a["pos"], b["n"] - b["pos"])) & enough(behind)


def _compare(left: dict, right: dict, same: bool, percent: int) -> Iterator[tuple[int, int]]:
    """The same filters within one block or between two, for pairs of different components."""
    for i in range(len(left["sid"])):
        at = slice(i + 1, None) if same else slice(None)
        n, m = int(left["n"][i]), right["n"][at]
        need = -(-(n + m) * percent // (100 + percent))
        fits = (right["component"][at] != left["component"][i]) & (np.minimum(m, n) * 100 >= np.maximum(m, n) * percent)
        fits &= np.minimum(n - left["pos"][i], m - right["pos"][at]) >= need
        some = np.flatnonzero(fits)
        if len(some):
            apart = np.abs(right["behind"][at][some] - left["behind"][i]).sum(axis=1)
            some = some[left["pos"][i] + right["pos"][at][some] + apart <= n + m[some] - 2 * need[some]]
            for x in right["sid"][at][some].tolist():
                yield min(int(left["sid"][i]), x), max(int(left["sid"][i]), x)


def _gap(a, b) -> Column:
    """How far two entries must at least lie apart, in n-grams that only one has."""
    ranges = F.zip_with(a["behind"], b["behind"], lambda x, y: F.abs(x - y))
    return a["pos"] + b["pos"] + F.aggregate(ranges, F.lit(0), lambda s, x: s + x)


def some_each(entries: DataFrame, groups: DataFrame, percent: int, seed: int, most: int) -> DataFrame:
    """At most ``most`` pairs (a, b) for every set that may be linked with another component (``groups``: doc_id, component).

    Every n-gram names ``most`` members of the largest component that holds it; sets
    of other components that pass the filters with them take, of all that are named
    to them, the ones that may be nearest.
    """
    placed = _placed(entries, groups).select("gram", F.struct("sid", "n", "pos", "behind", "component").alias("own"))
    parts = placed.groupBy("gram", "own.component").agg(F.count(F.lit(1)).alias("size"))
    largest = parts.groupBy("gram").agg(F.max(F.struct("size", "component"))["component"].alias("largest"), F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    split = placed.join(largest.select("gram", "largest"), "gram")
    draw = Window.partitionBy("gram").orderBy(F.xxhash64("own.sid", F.lit(seed)), "own.sid")
    named = split.where("own.component = largest").withColumn("draw", F.row_number().over(draw)).where(F.col("draw") <= most)
    met = split.where("own.component <> largest").join(named.select("gram", F.col("own").alias("other")), "gram").where(may_link(F.col("own"), F.col("other"), percent))
    pairs = met.groupBy("own.sid", F.col("other.sid").alias("other")).agg(F.min(_gap(F.col("own"), F.col("other"))).alias("gap"))
    nearest = Window.partitionBy("sid").orderBy("gap", "other")
    best = pairs.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= most)
    return best.select(F.least("sid", "other").alias("a"), F.greatest("sid", "other").alias("b")).distinct()


def _placed(entries: DataFrame, groups: DataFrame) -> DataFrame:
    placed = entries.join(groups.withColumnRenamed("doc_id", "sid"), "sid", "left")
    return placed.withColumn("component", F.coalesce("component", "sid"))


def open_pairs(entries: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components (``groups``: doc_id, component) that share a prefix n-gram and pass the filters.

    A group of up to BLOCK entries is one cell. In a larger one the largest
    component and the rest are cut into blocks; a cell holds a block of the rest and
    any other block, so members of the largest component travel once for each
    block of the rest and never meet each other.
    """
    placed = checkpointed(_placed(entries, groups))
    parts = placed.groupBy("gram", "component").agg(F.count(F.lit(1)).alias("n"))
    several = parts.groupBy("gram").agg(F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("size"), F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    few = F.col("size") <= BLOCK
    rest = F.when(few, 1).otherwise(F.ceil((F.col("size") - F.col("top.n")) / BLOCK)).cast("int")
    top = F.when(few, 0).otherwise(F.ceil(F.col("top.n") / BLOCK)).cast("int")
    cut = several.select("gram", F.when(~few, F.col("top.component")).alias("main"), rest.alias("rest"), top.alias("top"))
    own = placed.join(cut, "gram")
    is_main = F.coalesce(F.col("component") == F.col("main"), F.lit(False))
    label = F.when(is_main, F.col("rest") + F.pmod(F.xxhash64("sid"), F.greatest("top", F.lit(1)))).otherwise(F.pmod(F.xxhash64("sid"), "rest")).cast("int")
    others = F.when(is_main, F.sequence(F.lit(0), F.col("rest") - 1)).otherwise(F.sequence(F.lit(0), F.col("rest") + F.col("top") - 1))
    cells = own.withColumn("label", label).withColumn("other", F.explode(others))
    cells = cells.select("gram", F.least("label", "other").alias("x"), F.greatest("label", "other").alias("y"), "label", "sid", "n", "pos", "component", "behind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def compared(cell, held) -> Iterator[tuple[int, int]]:
            columns = [np.concatenate(c) for c in zip(*held, strict=True)]
            whole = dict(zip(("label", "sid", "n", "pos", "component", "behind"), columns, strict=True))
            side = lambda which: {k: v[whole["label"] == which] for k, v in whole.items()}
            left = side(cell[1])
            yield from _compare(left, left if cell[1] == cell[2] else side(cell[2]), cell[1] == cell[2], percent)

        def rows(found) -> Iterator[pa.RecordBatch]:
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["a", "b"])

        at, held = None, []
        for batch in batches:
            gram, x, y, label, sid, n, pos, component = (batch.column(i).to_numpy() for i in range(8))
            behind = batch.column(8).flatten().to_numpy().reshape(-1, RANGES).astype(np.int64)
            cuts = np.flatnonzero((np.diff(gram) != 0) | (np.diff(x) != 0) | (np.diff(y) != 0)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(gram)], strict=True):
                if a == b:
                    continue
                cell = (gram[a], x[a], y[a])
                if cell != at:
                    if held:
                        yield from rows(list(compared(at, held)))
                    at, held = cell, []
                held.append(tuple(c[a:b] for c in (label, sid, n, pos, component, behind)))
        if held:
            yield from rows(list(compared(at, held)))

    dealt = cells.repartition("gram", "x", "y").sortWithinPartitions("gram", "x", "y")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def jaccard_join(docs: DataFrame, width: int = 4, percent: int = 85) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id.

    ``component_id`` is the smallest doc_id that can be reached over links, itself
    included. Null or empty texts have no n-grams and stay alone. Rows whose doc_id
    is null are returned with no n-grams counted and a null component. A doc_id on
    several rows: the rows count as one document that is linked with whatever any
    of its texts is linked with. An empty table gives an empty result. Other columns
    are not read. ``docs`` is read three times and should be a stored table.
    """
    known = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text")
    every = checkpointed(sizes_and_lone_grams(known, width))
    alive = every.where("n > 0").where((F.col("n") - F.col("lone")) * 100 >= F.col("n") * percent).select("doc_id", "sid")
    classes = checkpointed(alive.groupBy("sid").agg(F.min("doc_id").alias("class_id")))
    copies = alive.join(classes, "sid").where("class_id < doc_id").select(F.col("class_id").alias("a"), F.col("doc_id").alias("b"))
    sets = checkpointed(class_sets(known, classes, width))
    entries = checkpointed(prefix_entries(sets, percent))
    met = entries.groupBy("gram").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("gram")
    crowded = checkpointed(entries.join(met, "gram", "left_semi"))
    of = sets.select(F.col("sid").alias("doc_id"), F.col("grams").alias("shingles"))
    linked = F.col("common") * 100 >= F.col("total") * percent
    tried = links = docs.sparkSession.createDataFrame([], "a long, b long")
    groups = components(links)
    for seed in range(ROUNDS):
        pairs = checkpointed(some_each(crowded, groups, percent, seed, 1 << seed).join(tried, ["a", "b"], "left_anti"))
        found = checkpointed(verify(of, pairs).where(linked).select("a", "b"))
        if found.isEmpty():
            break
        tried, links = tried.unionByName(pairs), links.unionByName(found)
        groups = components(links)
    more = checkpointed(open_pairs(crowded, groups, percent).join(tried, ["a", "b"], "left_anti"))
    links = links.unionByName(verify(of, more).where(linked).select("a", "b"))
    for end in ("a", "b"):
        links = links.withColumnRenamed(end, "sid").join(classes, "sid").drop("sid").withColumnRenamed("class_id", end)
    whole = components(links.select("a", "b").unionByName(copies))
    out = every.select("doc_id", F.col("n").alias("n_shingles")).join(whole, "doc_id", "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    nameless = docs.where(F.col("doc_id").isNull()).select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"))
    return out.unionByName(nameless)
