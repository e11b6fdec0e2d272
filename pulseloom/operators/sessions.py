"""Sessions per (source, env): a new one starts after a pause > ``window``.

Two signals in one time cell as wide as the window always share a session, so
signals are first reduced to cells with a map-side aggregate. Cells are then
marked by a segmented scan: local sessions per (key, time bucket), in which only
the first fragment may have begun earlier; one row per bucket (first and last
instant, start of its last fragment) goes through a second scan per key, which
tells every bucket where its first fragment began. No task sees all cells of a
key, whatever the window, the span of the key or the length of a session.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulseloom.functions.analysis import HIGH_SEVERITY, max_severity
from pulseloom.session import broadcast_if_small, checkpointed

SESSION_KEYS = ("source", "env")
DEFAULT_WINDOW_US = 60_000_000
CELLS_IN_BUCKET = 4096
PAGE_ROWS = 1_000


def cell_of(ts_us: Column, window_us: int) -> Column:
    width = F.lit(max(int(window_us), 1)).cast("long")
    return ts_us - F.pmod(ts_us, width)


def with_cell(signals: DataFrame, window_us: int = DEFAULT_WINDOW_US) -> DataFrame:
    """Add ``ts_us`` (microseconds since the epoch) and ``cell`` (its cell's start)."""
    return signals.withColumn("ts_us", F.unix_micros("timestamp")).withColumn("cell", cell_of(F.col("ts_us"), window_us))


def bucket_width(window_us: int) -> int:
    """Microseconds of a time bucket: CELLS_IN_BUCKET cells, an hour at least."""
    return max(int(window_us) * CELLS_IN_BUCKET, 3_600_000_000)


def carried_starts(parts: DataFrame, window_us: int, keys: Sequence[str] = SESSION_KEYS) -> DataFrame:
    """Where the first fragment of every bucket began.

    ``parts`` has one row per key and bucket: ``first_us``, ``last_us`` and
    ``tail_start``, the local start of its last fragment. A bucket that follows
    within the window continues the last fragment of the one before it; if that is
    also that bucket's first, the start is inherited from further back.
    """
    by_bucket = Window.partitionBy(*keys).orderBy("bucket")
    before = parts.withColumns(
        {
            "_last": F.lag("last_us").over(by_bucket),
            "_tail": F.lag("tail_start").over(by_bucket),
            "_first": F.lag("first_us").over(by_bucket),
        }
    )
    apart = F.col("_last").isNull() | (F.col("first_us") - F.col("_last") > F.lit(int(window_us)))
    begun = F.when(apart, F.col("first_us")).when(F.col("_tail") > F.col("_first"), F.col("_tail"))
    # Starts grow with the buckets, so the latest one that is known is the largest so far.
    carried = F.max("_begun").over(by_bucket.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return before.withColumn("_begun", begun).select(*keys, "bucket", "first_us", carried.alias("carried_start"))


def mark_sessions(
    cells: DataFrame, window_us: int, keys: Sequence[str] = SESSION_KEYS, bucket_us: int | None = None
) -> DataFrame:
    """Add ``session_start`` to rows with ``cell``, ``first_us`` and ``last_us``.

    Several rows may share a cell. Range frames make rows of one cell peers, so
    they get the same session. The cells are written once, as both scans read them.
    """
    width = bucket_us or bucket_width(window_us)
    held = checkpointed(cells.withColumn("_bucket", cell_of(F.col("cell"), width)))
    place = [*keys, "_bucket"]
    by_cell = Window.partitionBy(*place).orderBy("cell")
    peers = by_cell.rangeBetween(Window.currentRow, Window.currentRow)
    earlier = by_cell.rangeBetween(Window.unboundedPreceding, -1)
    until_now = by_cell.rangeBetween(Window.unboundedPreceding, Window.currentRow)

    def local(rows: DataFrame) -> DataFrame:
        opened = rows.withColumn("_cell_first", F.min("first_us").over(peers)).withColumn("_previous_last", F.max("last_us").over(earlier))
        pause = F.col("_cell_first") - F.col("_previous_last")
        starts = F.when(pause.isNull() | (pause > F.lit(int(window_us))), F.col("_cell_first"))
        # Starts grow with the cells, so the latest start is the largest one so far.
        return opened.withColumn("_local", F.max(starts).over(until_now)).drop("_cell_first", "_previous_last")

    parts = (
        local(held.select(*place, "cell", "first_us", "last_us"))
        .groupBy(*place)
        .agg(F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"), F.max("_local").alias("tail_start"))
        .withColumnRenamed("_bucket", "bucket")
    )
    carried = carried_starts(parts, window_us, keys).select(
        *[F.col(k).alias(f"_at_{i}") for i, k in enumerate(keys)], F.col("bucket").alias("_at"), F.col("first_us").alias("_head"), "carried_start"
    )
    marked = local(held)
    meets = [marked[k].eqNullSafe(carried[f"_at_{i}"]) for i, k in enumerate(keys)]
    start = F.when(F.col("_local") == F.col("_head"), F.col("carried_start")).otherwise(F.col("_local"))
    joined = marked.join(carried, reduce(Column.__and__, [*meets, marked["_bucket"] == carried["_at"]]))
    return joined.select(*cells.columns, start.alias("session_start"))


def session_cells(
    signals: DataFrame, window_us: int = DEFAULT_WINDOW_US, keys: Sequence[str] = SESSION_KEYS, bucket_us: int | None = None
) -> DataFrame:
    """One row per (key, cell) with its session."""
    cells = (
        with_cell(signals, window_us)
        .groupBy(*keys, "cell")
        .agg(
            F.min("ts_us").alias("first_us"),
            F.max("ts_us").alias("last_us"),
            F.count(F.lit(1)).alias("signal_count"),
            max_severity(F.col("severity")).alias("max_severity"),
        )
    )
    return mark_sessions(cells, window_us, keys, bucket_us)


def session_summary(
    signals: DataFrame, window_us: int = DEFAULT_WINDOW_US, keys: Sequence[str] = SESSION_KEYS
) -> DataFrame:
    """Start, end, signal count and largest severity of every session."""
    return (
        session_cells(signals, window_us, keys)
        .groupBy(*keys, "session_start")
        .agg(
            F.max("last_us").alias("session_end"),
            F.sum("signal_count").alias("signal_count"),
            F.max("max_severity").alias("max_severity"),
        )
    )


def is_high(max_severity_column: Column) -> Column:
    return max_severity_column >= HIGH_SEVERITY


def high_severity_sessions(sessions: DataFrame) -> DataFrame:
    return sessions.filter(is_high(F.col("max_severity")))


def session_members(
    signals: DataFrame, window_us: int = DEFAULT_WINDOW_US, keys: Sequence[str] = SESSION_KEYS, bucket_us: int | None = None
) -> DataFrame:
    """Every signal with its session; the order in a session is (timestamp, id).

    Cells are computed once and measured. Few of them are broadcast, and the
    signals stay where they are. Otherwise both sides shuffle on (key, cell), which
    spreads a long session over many tasks; AQE splits what is left of a hot cell.
    """
    cells = broadcast_if_small(
        session_cells(signals, window_us, keys, bucket_us).select(*keys, "cell", "session_start"), materialize=True
    )
    return with_cell(signals, window_us).join(cells, [*keys, "cell"]).drop("cell")


def members_of(
    signals: DataFrame, sessions: DataFrame, window_us: int = DEFAULT_WINDOW_US, keys: Sequence[str] = SESSION_KEYS
) -> DataFrame:
    """The signals of known ``sessions`` (keys, session_start, session_end) with these columns and any others ``sessions`` has.

    The bounds tell which cells a session covers, so the signals are read once,
    for this join, and not to find sessions again.
    """
    width = F.lit(max(int(window_us), 1)).cast("long")
    covered = F.sequence(cell_of(F.col("session_start"), window_us), cell_of(F.col("session_end"), window_us), width)
    cells = broadcast_if_small(sessions.withColumn("cell", F.explode(covered)))
    return with_cell(signals, window_us).join(cells, [*keys, "cell"]).drop("cell", "session_end")


def add_position(rows: DataFrame, group: Sequence[str], order: Sequence[str], name: str = "position") -> DataFrame:
    """0-based rank of every row in its group without gathering the group.

    ``group`` + ``order`` must be unique. A range sort over all of these columns
    splits a hot group over as many tasks as its size asks for; ranks are then
    the offset of the sort partition plus the index inside it.
    """
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = (
        rows.repartitionByRange(partitions, *group, *order)
        .sortWithinPartitions(*group, *order)
        .withColumn("_slot", F.monotonically_increasing_id())
    )
    ordered = checkpointed(ordered)
    block = F.shiftright("_slot", 33)
    index = F.col("_slot").bitwiseAND(F.lit((1 << 33) - 1))
    # One row per sort partition, so this window is small whatever the data.
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ordered.groupBy(block.alias("_block"))
        .count()
        .withColumn("_offset", F.coalesce(F.sum("count").over(before), F.lit(0)))
        .select("_block", "_offset")
    )
    ranked = (
        ordered.withColumn("_block", block)
        .join(F.broadcast(offsets), "_block")
        .withColumn("_rank", F.col("_offset") + index)
        .drop("_slot", "_block", "_offset")
    )
    firsts = ranked.groupBy(*group).agg(F.min("_rank").alias("_first"))
    return ranked.join(firsts, list(group)).withColumn(name, F.col("_rank") - F.col("_first")).drop("_rank", "_first")


def paged_lists(
    positioned: DataFrame, group: Sequence[str], value: str, page_rows: int = PAGE_ROWS
) -> DataFrame:
    """Ordered lists of ``value`` in pages: page p holds positions [p*n, (p+1)*n).

    The pages of a group in order are its whole list; no array outgrows a page.
    """
    page = F.floor(F.col("position") / F.lit(page_rows)).cast("long")
    return (
        positioned.groupBy(*group, page.alias("page"))
        .agg(F.array_sort(F.collect_list(F.struct("position", F.col(value).alias("value")))).alias("_rows"))
        .select(*group, "page", F.col("_rows.value").alias("values"))
    )


def session_signal_ids(
    signals: DataFrame,
    window_us: int = DEFAULT_WINDOW_US,
    keys: Sequence[str] = SESSION_KEYS,
    page_rows: int = PAGE_ROWS,
) -> DataFrame:
    """Signal ids of every session in time order, in pages."""
    group = [*keys, "session_start"]
    members = session_members(signals, window_us, keys).select(*group, "ts_us", "id")
    return paged_lists(add_position(members, group, ["ts_us", "id"]), group, "id", page_rows)
