"""Mixing sources to target weights by exponential keys (Efraimidis and Spirakis).

A document's key is ``-ln(u) / weight`` with u from a hash of its id and the
weight from its text; smaller keys come first, so better documents are likelier
to be drawn and reruns agree. Per source, whole epochs are taken first; what the
target leaves beyond them goes to the documents of smallest key, prefix-summed to
the budget.

No source is sorted as a whole: keys fall into fine logarithmic buckets, whose
sums (aggregated before the shuffle) tell in which bucket the budget ends. Only
the rows of that bucket are ordered; a source then has one cutoff, and rows are
compared with it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulseloom.llm.text import word_count
from pulseloom.session import broadcast_if_small, checkpointed

WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2.0
FINE = 1024  # buckets to a doubling of the key


def quality_weight(text: Column, size: Column) -> Column:
    """Weight of a document, over 0 and at most 1: long texts of words of usual length weigh most."""
    usual = (F.length(text) >= size * 3) & (F.length(text) <= size * 15)
    return F.when(size > 0, size / (size + 50.0) * F.when(usual, 1.0).otherwise(0.25)).otherwise(F.lit(0.001))


def exponential_key(doc_id: Column, weight: Column) -> Column:
    """-ln(u) / weight, u in (0, 1) from the first 52 bits of the id's MD5."""
    bits = F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 13), 16, 10).cast("double")
    return -F.log((bits + 0.5) / F.lit(float(1 << 52))) / weight


def targets(sizes: DataFrame) -> DataFrame:
    """``sizes`` (source, source_size) with ``target``: the weighted share of 150% of all words, at most twice the source.

    Sources by code point, null last, weigh 5, 2, 1 in turn. Water filling in
    closed form: by rising ``limit / weight`` the first sources stop at their
    limit, the others share the rest by weight. One row per source.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (place % len(WEIGHTS) + 1).cast("int"))
    placed = sizes.withColumn("weight", weight).withColumn("most", F.col("source_size") * MOST).withColumn("ratio", F.col("most") / F.col("weight"))
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    full = F.coalesce(F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(every) * SHARE - full) / open_weight
    found = placed.withColumn("level", level)
    first = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(every)["level"]
    return found.withColumn("level", first).withColumn("target", F.least("most", F.col("weight") * F.col("level"))).select("source", "source_size", "target")


def _order() -> Column:
    return F.struct("key", "doc_id", "tie")


def mix(docs: DataFrame) -> DataFrame:
    """``docs`` with size, source_size, target and taken: words of the text, of its source, the source's target, and words taken.

    ``taken`` is 0, size or twice size. Null texts have size 0 and give nothing;
    a null source is a source of its own. Rows that repeat id and text are taken
    together. Columns of these names are replaced; other columns and all rows stay.
    """
    made = ["size", "source_size", "target", "taken"]
    own = [c for c in docs.columns if c not in made]
    # The row travels as one struct, so no name of its columns can clash with those used here.
    held = docs.select(F.struct(*own).alias("row"), "doc_id", "source", "text", word_count(F.col("text")).alias("size"))
    key = exponential_key(F.col("doc_id"), quality_weight(F.col("text"), F.col("size")))
    keyed = held.select("row", "doc_id", "source", "size", key.alias("key"), F.xxhash64("text").alias("tie")).withColumn("bucket", F.floor(F.log2("key") * FINE))
    return _taken(keyed, checkpointed(keyed.drop("row"))).select("row.*", *made)


def mix_sizes(docs: DataFrame) -> DataFrame:
    """Only doc_id, size, source_size, target, taken of :func:`mix`: texts are read once."""
    keyed = docs.select("doc_id", "source", "text", word_count(F.col("text")).alias("size"))
    keyed = keyed.select("doc_id", "source", "size", exponential_key(F.col("doc_id"), quality_weight(F.col("text"), F.col("size"))).alias("key"), F.xxhash64("text").alias("tie"))
    narrow = checkpointed(keyed.withColumn("bucket", F.floor(F.log2("key") * FINE)))
    return _taken(narrow, narrow).select("doc_id", "size", "source_size", "target", "taken")


def _taken(rows: DataFrame, narrow: DataFrame) -> DataFrame:
    sums = checkpointed(narrow.groupBy("source", "bucket").agg(F.sum("size").alias("words")))
    goals = targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")))
    goals = goals.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    goals = checkpointed(goals.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")))
    of = goals.withColumnRenamed("source", "of")
    same = F.col("source").eqNullSafe(F.col("of"))
    upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    running = sums.withColumn("after", F.sum("words").over(upto)).join(broadcast_if_small(of.select("of", "rest")), same).where(F.col("after") > F.col("rest"))
    ends = running.groupBy("source").agg(F.min(F.struct("bucket", "after", "words", "rest")).alias("e"))
    ends = checkpointed(ends.select(F.col("source").alias("of"), F.col("e.bucket").alias("last"), (F.col("e.after") - F.col("e.words")).alias("before"), F.col("e.rest").alias("rest")))
    inside = narrow.join(broadcast_if_small(ends), same & (F.col("bucket") == F.col("last")))
    upto = Window.partitionBy("of").orderBy("key", "doc_id", "tie").rowsBetween(Window.unboundedPreceding, 0)
    fits = inside.withColumn("start", F.col("before") + F.sum("size").over(upto) - F.col("size")).where(F.col("start") + F.col("size") / 2 <= F.col("rest"))
    cuts = fits.groupBy("of").agg(F.max(_order()).alias("cut")).withColumnRenamed("of", "cut_of")
    marks = ends.select("of", "last").join(cuts, F.col("of").eqNullSafe(F.col("cut_of")), "left").select(F.col("of").alias("end_of"), "last", "cut")
    table = checkpointed(of.join(marks, F.col("of").eqNullSafe(F.col("end_of")), "left").select("of", "source_size", "target", "epochs", "last", "cut"))
    inner = F.coalesce((F.col("bucket") < F.col("last")) | ((F.col("bucket") == F.col("last")) & (_order() <= F.col("cut"))), F.lit(False))
    # A source without a last bucket has no more left to give than its whole epochs.
    joined = rows.join(broadcast_if_small(table), same)
    return joined.withColumn("taken", (F.col("size") * (F.col("epochs") + inner.cast("long"))).cast("long"))


def draw(docs: DataFrame) -> DataFrame:
    """The mixed corpus: every document as often as it is taken (up to twice), same columns."""
    mixed = mix(docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "source", "text")).where("taken > 0")
    times = F.explode(F.sequence(F.lit(1), (F.col("taken") / F.col("size")).cast("int")))
    return mixed.select("row", times.alias("time")).select("row.*")
