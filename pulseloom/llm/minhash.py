"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

A document's set holds its distinct shingles of ``width`` words (fewer words:
the whole sequence as one; none: the empty set, linked with nothing). Two
documents are linked if ``100 * |A & B| >= percent * |A | B|``.

1. One pass hashes every shingle and derives the signature: the first
   permutation spreads a shingle over 32 bits, the second, shifted circularly by
   k, gives coordinate k. Coordinates are grouped into bands.
2. Documents with equal sets fall into one class by their 128-bit set hash; only
   one document of a class goes on.
3. Every bucket (band, value) pairs its members with the smallest one, its leader:
   as many pairs as members. Each pair is verified on the full sets; the verified
   links give components.
4. Buckets that then still hold several components compare these in blocks, in
   one task for two blocks: pairs that sizes and signatures allow are verified
   there on the full sets, and only links are written. So no link is lost.

Bands of 4 are as many as it takes to miss a pair at the threshold with probability
of at most MISSED: 20 at Jaccard 0.85, 28 at 0.80. Signatures of a pair that shares
a band rule it out in step 4 with probability of at most DOUBTED.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseloom.llm.components import components
from pulseloom.llm.words import Texts, mix, slices, words
from pulseloom.session import broadcast_if_small, checkpointed

BANDS, ROWS = 20, 4
MEMBERS = 256  # documents verified against one leader in one group
BLOCK = 1024  # documents of an unresolved bucket compared at a time
MISSED = 4e-7  # most probable loss of a pair at the threshold: no band in common
DOUBTED = 4e-8  # the same: a signature estimate too low to be verified

_STEPS = np.random.default_rng(7).integers(1, 1 << 63, 8, dtype=np.uint64) | np.uint64(1)


def bands_for(percent: int, rows: int = ROWS) -> int:
    """Bands that miss a pair at the threshold with probability of at most MISSED; BANDS at least."""
    apart = 1 - (percent / 100) ** rows
    return BANDS if apart <= 0 else max(BANDS, math.ceil(math.log(MISSED) / math.log(apart)))


def least_matches(percent: int, size: int) -> int:
    """Equal coordinates of ``size`` that a pair at the threshold falls short of with probability of at most DOUBTED."""
    p, below = min(percent / 100, 1 - 1e-12), 0.0
    for m in range(size + 1):
        choose = math.lgamma(size + 1) - math.lgamma(m + 1) - math.lgamma(size - m + 1)
        below += math.exp(choose + m * math.log(p) + (size - m) * math.log1p(-p))
        if below > DOUBTED:
            return m
    return size


def shingle_sets(texts: Texts, width: int) -> Iterator[np.ndarray]:
    """For each text its sorted distinct shingle hashes."""
    found = words(texts)
    bounds = np.searchsorted(found.doc, np.arange(texts.hi - texts.lo + 1))
    n = len(found.hash)
    joined = np.zeros(max(0, n - width + 1), np.uint64)
    for i in range(width):
        joined += found.hash[i : n - width + 1 + i] * _STEPS[i % 8] * np.uint64(2 * (i // 8) + 1) if len(joined) else 0
    joined = mix(joined)
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= width:
            yield np.unique(joined[a : b - width + 1])
        elif b > a:
            whole = np.uint64(b - a)
            for h in found.hash[a:b]:
                whole = mix(np.array([whole ^ h]))[0]
            yield mix(np.array([whole ^ _STEPS[7]], np.uint64))
        else:
            yield np.zeros(0, np.uint64)


def signature(shingles: np.ndarray, size: int) -> np.ndarray:
    """Circulant signature: coordinate k is the least value of the second permutation, shifted by k."""
    least = np.full(size, 0xFFFFFFFF, np.uint32)
    spread = (mix(shingles ^ _STEPS[0]) >> np.uint64(32)).astype(np.uint32)
    shift = np.arange(size, dtype=np.uint32)[:, None]
    for at in range(0, len(spread), 1024):
        x = spread[None, at : at + 1024] + shift
        x ^= x >> np.uint32(16)
        x *= np.uint32(0x85EBCA6B)
        x ^= x >> np.uint32(13)
        x *= np.uint32(0xC2B2AE35)
        x ^= x >> np.uint32(16)
        np.minimum(least, x.min(axis=1), out=least)
    return least


def sketches(docs: DataFrame, width: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, two set hashes, the band values and one byte of each coordinate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for texts in slices(batch.column(1)):
                count, low, high, keys, brief = [], [], [], [], []
                for own in shingle_sets(texts, width):
                    sign = signature(own, bands * rows)
                    count.append(len(own))
                    low.append(int(own.sum(dtype=np.uint64).view(np.int64)) if len(own) else 0)
                    high.append(int(mix(own + _STEPS[5]).sum(dtype=np.uint64).view(np.int64)) if len(own) else 0)
                    key = np.zeros(bands, np.uint64)
                    for part in sign.reshape(bands, rows).T:
                        key = mix(key + part.astype(np.uint64) + np.uint64(1))
                    keys.append(key.view(np.int64) if len(own) else np.zeros(0, np.int64))
                    brief.append((sign & np.uint32(255)).astype(np.uint8).tobytes())
                lists = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum([len(k) for k in keys])]), pa.int32()), pa.array(np.concatenate(keys), pa.int64())
                )
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(texts.lo, texts.hi - texts.lo), pa.array(count, pa.int64()), pa.array(low, pa.int64()), pa.array(high, pa.int64()), lists, pa.array(brief, pa.binary())],
                    names=["doc_id", "n_shingles", "low", "high", "bands", "brief"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, low long, high long, bands array<long>, brief binary")


def full_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """doc_id and the full shingle set, as bytes, of the documents named in ``wanted`` (doc_id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in slices(batch.column(1)):
                held = [own.tobytes() for own in shingle_sets(texts, width)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(texts.lo, texts.hi - texts.lo), pa.array(held, pa.binary())], names=["doc_id", "shingles"])

    some = docs.select("doc_id", "text").join(broadcast_if_small(wanted, materialize=True), "doc_id", "left_semi")
    return some.mapInArrow(run, "doc_id long, shingles binary")


def verify(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs (a, b) with ``common`` and ``total``: sizes of intersection and union of the full sets.

    Members of one ``a`` are cut into groups of about MEMBERS; a task holds the
    set of one ``a`` while the members stream past.
    """
    sizes = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).cast("int").alias("parts"))
    cut = pairs.join(sizes, "a")
    member = cut.select("a", F.pmod(F.xxhash64("b"), "parts").cast("int").alias("part"), F.col("b").alias("doc_id"), F.lit(1).alias("role"))
    lead = sizes.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("a").alias("doc_id"), F.lit(0).alias("role"))
    rows = sets.join(member.unionByName(lead), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, []
        for batch in batches:
            out = []
            a, part, role, ids, shingles = (batch.column(i) for i in range(5))
            for i in range(batch.num_rows):
                own = np.frombuffer(shingles[i].as_buffer(), np.uint64)
                at = (a[i].as_py(), part[i].as_py())
                if role[i].as_py() == 0:
                    held = [*held, own] if group == at else [own]
                    group = at
                    continue
                for other in held:  # several only where a doc_id is on several rows
                    common = len(np.intersect1d(other, own, assume_unique=True))
                    out.append((at[0], ids[i].as_py(), common, len(other) + len(own) - common))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b", "common", "total"])

    dealt = rows.select("a", "part", "role", "doc_id", "shingles").repartition("a", "part").sortWithinPartitions("a", "part", "role")
    return dealt.mapInArrow(run, "a long, b long, common long, total long")


def in_blocks(members: DataFrame, block: int) -> DataFrame:
    """``members`` (band, key, doc_id, component, ...) once for each cell (i, j) they go to, with their own ``block``.

    A bucket of up to ``block`` members is one cell. In a larger one the blocks of
    its largest component come behind those of the others and meet only these:
    members of one component need no comparison. So with few others a member of a
    huge component goes to one cell, not to as many as the bucket has blocks.
    """
    bucket = ["band", "key"]
    sizes = members.groupBy(*bucket, "component").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.groupBy(*bucket).agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.max_by("component", F.struct("n", "component")).alias("largest"))
    whole = F.col("n") <= block
    cut = lambda n: F.ceil(n / F.lit(block)).cast("int")
    sizes = sizes.select(
        *bucket,
        F.when(~whole, F.col("largest")).alias("largest"),
        F.when(whole, F.lit(1)).otherwise(cut(F.col("n") - F.col("most"))).alias("others"),
        F.when(whole, F.lit(0)).otherwise(cut(F.col("most"))).alias("behind"),
    )
    spread = F.xxhash64("doc_id", F.lit(3))
    large = F.coalesce(F.col("component") == F.col("largest"), F.lit(False))
    own = members.join(sizes, bucket).withColumn("large", large)
    own = own.withColumn("block", F.when(F.col("large"), F.col("others") + F.pmod(spread, F.greatest("behind", F.lit(1)))).otherwise(F.pmod(spread, "others")).cast("int"))
    last = F.col("others") + F.when(F.col("large"), F.lit(0)).otherwise(F.col("behind")) - 1
    placed = own.withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    placed = placed.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    return placed.drop("largest", "others", "behind", "large", "other")


def _links_in_blocks(members: DataFrame, sets: DataFrame, percent: int, coordinates: int) -> DataFrame:
    """Links (a, b) between different components of one bucket, found block by block.

    A task holds two blocks of one bucket. It verifies, on the full sets, the
    pairs whose sizes and signatures allow a link, each pair in the first band
    where both meet, and returns the links that join components there: at most one
    for each row, so copies that nearly all are links do not come out as all pairs.
    """
    least = least_matches(percent, coordinates)
    placed = in_blocks(members, BLOCK)
    rows = placed.join(sets, "doc_id").select("band", "key", "i", "j", "block", "doc_id", "component", "bands", "brief", "shingles")

    def compare(group, held):
        band, _, i, j = group
        left, right = [r for r in held if r[0] == i], [r for r in held if r[0] == j]
        if not left or not right:
            return
        brief = np.frombuffer(b"".join(r[4] for r in right), np.uint8).reshape(len(right), -1)
        bands = np.array([r[3] for r in right])[:, :band]
        comp = np.array([r[2] for r in right])
        of = comp if i == j else np.array([r[2] for r in left])
        size = np.array([len(r[5]) for r in right])
        for n, (_, doc, _, own_bands, own_brief, own_set) in enumerate(left):
            fits = (comp != of[n]) & (np.minimum(size, len(own_set)) * 100 >= np.maximum(size, len(own_set)) * percent)
            if band and fits.any():
                fits &= ~(bands == np.array(own_bands[:band])).any(axis=1)
            at = np.flatnonzero(fits)
            at = at[(brief[at] == np.frombuffer(own_brief, np.uint8)).sum(axis=1) >= least] if len(at) else at
            for x in at:
                # What an earlier link of this cell has joined needs no other.
                if comp[x] == of[n] or (i == j and right[x][1] < doc):
                    continue
                common = len(np.intersect1d(own_set, right[x][5], assume_unique=True))
                if common * 100 >= (len(own_set) + size[x] - common) * percent:
                    yield min(doc, right[x][1]), max(doc, right[x][1])
                    gone, stays = comp[x], of[n]
                    comp[comp == gone] = stays
                    of[of == gone] = stays

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def groups():
            group, held = None, []
            for batch in batches:
                keys = zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True)
                lists = [batch.column(c).to_pylist() for c in range(4, 9)]
                for at, row, shingles in zip(keys, zip(*lists, strict=True), batch.column(9), strict=True):
                    if at != group:
                        if len(held) > 1:
                            yield group, held
                        group, held = at, []
                    held.append((*row, np.frombuffer(shingles.as_buffer(), np.uint64)))
            if len(held) > 1:
                yield group, held

        for group, held in groups():
            if found := list(compare(group, held)):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["a", "b"])

    dealt = rows.repartition("band", "key", "i", "j").sortWithinPartitions("band", "key", "i", "j")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, bands: int | None = None, rows: int = ROWS) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    ``component_id`` is the smallest doc_id that can be reached over links, itself
    included; ``kept`` holds for that document. Null or empty texts have no
    shingles and stay alone. Rows whose doc_id is null are returned with a null
    component and kept. A doc_id on several rows: the rows count as one document
    that is linked with whatever any of its texts is linked with. An empty table
    gives an empty result. Other columns are not read. ``bands`` is :func:`bands_for`
    of ``percent`` if not given.
    """
    bands = bands or bands_for(percent, rows)
    known = docs.where(F.col("doc_id").isNotNull())
    seen = checkpointed(sketches(known, width, bands, rows))
    full = seen.where("n_shingles > 0")
    same = ["low", "high", "n_shingles"]
    classes = full.groupBy(*same).agg(F.min("doc_id").alias("class_id"))
    copies = full.select("doc_id", *same).join(classes, same).where("class_id < doc_id").select(F.col("class_id").alias("a"), F.col("doc_id").alias("b"))
    heads = full.join(classes.withColumnRenamed("class_id", "doc_id"), [*same, "doc_id"], "left_semi").dropDuplicates(["doc_id", *same])
    cells = heads.select("doc_id", F.posexplode("bands").alias("band", "key"))
    crowded = cells.groupBy("band", "key").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("band", "key")
    buckets = checkpointed(cells.join(crowded, ["band", "key"], "left_semi"))
    shared = buckets.select("doc_id").distinct()
    sets = checkpointed(full_sets(known, shared, width))
    linked = F.col("common") * 100 >= F.col("total") * percent
    leaders = buckets.groupBy("band", "key").agg(F.min("doc_id").alias("a"))
    pairs = buckets.join(leaders, ["band", "key"]).where("a < doc_id").select("a", F.col("doc_id").alias("b")).distinct()
    led = checkpointed(verify(sets, checkpointed(pairs)).where(linked).select("a", "b"))
    members = _open_members(buckets, components(led))
    still = members.join(heads.select("doc_id", "bands", "brief"), "doc_id")
    rest = _links_in_blocks(still, sets, percent, bands * rows)
    whole = components(led.unionByName(rest).unionByName(copies))
    out = seen.select("doc_id", "n_shingles").join(whole, "doc_id", "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    out = out.withColumn("kept", F.col("doc_id") == F.col("component_id"))
    nameless = docs.where(F.col("doc_id").isNull()).select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("kept"))
    return out.unionByName(nameless)


def _open_members(buckets: DataFrame, groups: DataFrame) -> DataFrame:
    """Members of the buckets that still hold several components."""
    placed = buckets.join(groups, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    several = placed.groupBy("band", "key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("band", "key")
    return checkpointed(placed.join(several, ["band", "key"], "left_semi"))


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each group of near duplicates, the one with the smallest doc_id (null ids last).

    Every row is a document of its own, under a key of its id and text: rows that
    repeat an id with other texts all stay, unless these are near duplicates. Rows
    of equal id and text come down to one. Texts without words stay, once for each id.
    """
    # The row travels as one struct, so no name of its columns can clash with those used here.
    keyed = docs.select(F.xxhash64("doc_id", "text").alias("key"), F.struct(*docs.columns).alias("row"))
    repeated = broadcast_if_small(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), materialize=True)
    order = F.struct(*[F.col("row")[c] for c in ("lang", "source", "n_chars")])
    several = keyed.join(repeated, "key", "left_semi").groupBy("key", F.col("row.doc_id"), F.col("row.text")).agg(F.min_by("row", order).alias("row"))
    rows = keyed.join(repeated, "key", "left_anti").unionByName(several.select("key", "row"))
    found = near_duplicates(rows.select(F.col("key").alias("doc_id"), F.col("row.text").alias("text")), width, percent)
    groups = found.select(F.col("doc_id").alias("key"), "component_id").distinct()
    named = rows.select("key", F.col("row.doc_id").alias("doc_id")).join(groups, "key")
    first = named.groupBy("component_id").agg(F.min_by("key", F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("key"))
    return rows.join(first.select("key"), "key", "left_semi").select("row.*")
