"""Stored signals as a table with versions, and an index that tells which ids it has.

A version is a list of files with the span of time each covers, committed by one
marker file, so a reader sees a whole version or none of it. Files lie by day and
environment; expiry drops files by their spans alone, rewrites those the cutoff goes
through, and leaves the rest alone. Ids are kept apart, in hash buckets, with a Bloom
filter of fixed size for each bucket: a micro-batch looks its ids up in the filters
and opens only the buckets that may hold one of them.

The table has one writer at a time. :meth:`SignalStore.vacuum` deletes what no
version names any more.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulseloom.operators.retention import signal_cutoff
from pulseloom.schemas import SIGNALS
from pulseloom.session import broadcast_if_small, checkpointed

BUCKETS = 16
BLOCKS = 8  # of a bucket's filter, 4 KB each
BLOCK_BITS = 32_768  # what a bitmap of Spark's holds
PROBES = 4  # bits of an id

_FILES = "load string, file string, dt date, env string, rows long, timeless long, min_us long, max_us long"
_IDS = "id string, ts_us long, env string, epoch long, bucket int"
_FILTERS = "bucket int, block int, bits binary"


class SignalStore:
    """The store below ``path``. ``buckets`` and ``blocks`` size the id index; :meth:`compact` applies a change of them."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS, blocks: int = BLOCKS):
        self.spark, self.path, self.buckets, self.blocks = spark, path.rstrip("/"), buckets, blocks

    # -- versions ------------------------------------------------------------

    def _fs(self, path: str):
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return folder.getFileSystem(self.spark._jsc.hadoopConfiguration()), folder

    def _names(self, pattern: str) -> list[str]:
        """Names of folders; they describe the table and do not grow with its rows."""
        files, folder = self._fs(f"{self.path}/{pattern}")
        found = files.globStatus(folder)
        return [s.getPath().getName() for s in found] if found else []

    def versions(self) -> list[int]:
        files, folder = self._fs(f"{self.path}/versions/v=*/_COMMITTED")
        return sorted(int(s.getPath().getParent().getName()[2:]) for s in files.globStatus(folder) or [])

    def version(self) -> int:
        """The newest complete version; 0 before the first."""
        return max(self.versions(), default=0)

    def _part(self, name: str, schema: str, version: int | None) -> DataFrame:
        number = self.version() if version is None else version
        if not number:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/versions/v={number}/{name}")

    def files(self, version: int | None = None) -> DataFrame:
        """load, file, dt, env, rows, timeless, min_us, max_us of every file of a version."""
        return self._part("files", _FILES, version)

    def limits(self, version: int | None = None) -> DataFrame:
        """env, limit_us: what lies before has been expired."""
        return self._part("limits", "env string, limit_us long", version)

    def loads(self, version: int | None = None) -> DataFrame:
        """load, epoch: where the ids of an epoch are; an epoch is here once it is stored."""
        return self._part("loads", "load string, epoch long", version)

    def filters(self, version: int | None = None) -> DataFrame:
        number = self.version() if version is None else version
        if not number:
            return self.spark.createDataFrame([], _FILTERS)
        name = self.spark.read.parquet(f"{self.path}/versions/v={number}/about").first()["filters"]
        return self.spark.read.schema(_FILTERS).parquet(f"{self.path}/filters/{name}")

    def _commit(self, files: DataFrame, limits: DataFrame, loads: DataFrame, filters: str) -> int:
        number = self.version() + 1
        folder = f"{self.path}/versions/v={number}"
        about = self.spark.createDataFrame([(filters,)], "filters string")
        # A few rows each, but the list of files, which has a row for every file.
        for name, part, parts in (("files", files, 8), ("limits", limits, 1), ("loads", loads, 1), ("about", about, 1)):
            part.coalesce(parts).write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(f"{folder}/{name}")
        files_, marker = self._fs(f"{folder}/_COMMITTED")
        files_.create(marker, True).close()
        return number

    # -- rows ------------------------------------------------------------------

    def _write(self, signals: DataFrame) -> tuple[str, DataFrame]:
        """A new load of files, of even size whether a day is hot or nearly empty, and their spans."""
        load = uuid.uuid4().hex[:12]
        folder = f"{self.path}/data/load={load}"
        dated = signals.select(*SIGNALS.names).withColumn("dt", F.to_date("timestamp"))
        dated.hint("rebalance", "dt", "env").write.partitionBy("dt", "env").parquet(folder)
        name = F.try_url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))).alias("file")
        stored = self._read([folder])
        at = F.unix_micros("timestamp")
        spans = stored.groupBy(name, "dt", "env").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("timestamp").isNull()).alias("timeless"), F.min(at).alias("min_us"), F.max(at).alias("max_us"))
        return load, spans.withColumn("load", F.lit(load)).select("load", "file", "dt", "env", "rows", "timeless", "min_us", "max_us")

    def _read(self, paths: list[str]) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], T.StructType([*SIGNALS.fields, T.StructField("dt", T.DateType()), T.StructField("load", T.StringType())]))
        partitions = [T.StructField("dt", T.DateType()), T.StructField("load", T.StringType())]
        schema = T.StructType([*SIGNALS.fields, *partitions])
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/data").parquet(*paths)

    def read(self, version: int | None = None, since: Column | None = None, until: Column | None = None) -> DataFrame:
        """The signals of a version (default: the newest), those from ``since`` to ``until`` if given.

        Only files whose span meets that time are opened. ``since`` and ``until`` are constants.
        """
        files, rows = self.files(version), []
        for bound, meets, keeps in ((since, lambda b: F.col("max_us") >= b, lambda b: F.col("timestamp") >= b), (until, lambda b: F.col("min_us") <= b, lambda b: F.col("timestamp") <= b)):
            if bound is not None:
                files = files.where(meets(F.unix_micros(bound)))
                rows.append(keeps(bound))
        # A list of files is what Spark's own listing would hold on the driver, too.
        signals = self._read([r["file"] for r in files.select("file").collect()])
        for keep in rows:
            signals = signals.where(keep)
        return signals.select(*SIGNALS.names)

    def append(self, signals: DataFrame, epoch: int) -> int:
        """Store the signals of an epoch as a new version; an epoch that is stored already changes nothing."""
        if not self.loads().where(F.col("epoch") == epoch).isEmpty():
            return self.version()
        load, spans = self._write(signals)
        ids = self._read([f"{self.path}/data/load={load}"]).select("id", F.unix_micros("timestamp").alias("ts_us"), "env", F.lit(epoch).cast("long").alias("epoch"))
        self._write_ids(ids, load)
        self._write_filters(load, self.filters())
        loads = self.loads().unionByName(self.spark.createDataFrame([(load, epoch)], "load string, epoch long"))
        return self._commit(self.files().unionByName(spans), self.limits(), loads, load)

    def expire(self, as_of: Column) -> int:
        """Drop what the retention of its environment no longer keeps, as a new version.

        A file that lies before the cutoff goes unread, one that lies behind it stays
        as it is; rows of the others are written anew. Rows without a time stay.
        """
        files = checkpointed(self.files())
        limits = files.select("env").distinct().withColumn("new_us", F.unix_micros(signal_cutoff(F.col("env"), as_of)))
        old = self.limits()
        limits = checkpointed(limits.join(old, "env", "full").select("env", F.greatest("new_us", "limit_us").alias("limit_us")))
        judged = checkpointed(files.join(F.broadcast(limits), files["env"].eqNullSafe(limits["env"]), "left").select(files["*"], "limit_us"))
        late = F.coalesce(F.col("min_us") < F.col("limit_us"), F.lit(False))
        gone = late & (F.col("max_us") < F.col("limit_us")) & (F.col("timeless") == 0)
        cut = [r["file"] for r in judged.where(late & ~gone).select("file").collect()]
        kept = judged.where(~late).drop("limit_us")
        if cut:
            held = self._read(cut)
            limit = F.broadcast(limits.select(F.col("env").alias("_env"), "limit_us"))
            fresh = held.join(limit, held["env"].eqNullSafe(F.col("_env")), "left").where("timestamp is null or unix_micros(timestamp) >= limit_us")
            _, spans = self._write(fresh)
            kept = kept.unionByName(spans)
        return self._commit(kept, limits, self.loads(), self._filters_name())

    def compact(self) -> int:
        """Join the files of each day and environment that has several, and the ids of all loads, as a new version."""
        files = checkpointed(self.files())
        several = files.groupBy("dt", "env").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("dt").alias("_dt"), F.col("env").alias("_env"))
        small = files.join(several, files["dt"].eqNullSafe(F.col("_dt")) & files["env"].eqNullSafe(F.col("_env")), "left_semi")
        kept = files.join(small.select("file"), "file", "left_anti").select(files.columns)
        paths = [r["file"] for r in small.select("file").collect()]
        if paths:
            _, spans = self._write(self._read(paths))
            kept = kept.unionByName(spans)
        load = uuid.uuid4().hex[:12]
        self._write_ids(self._live(self._ids()).drop("bucket"), load)
        self._write_filters(load, self.spark.createDataFrame([], _FILTERS))
        return self._commit(kept, self.limits(), self.loads().select(F.lit(load).alias("load"), "epoch"), load)

    def vacuum(self, keep: int = 1) -> int:
        """Delete versions but the newest ``keep``, and loads and filters none of these names; the number of folders deleted."""
        numbers = self.versions()[-keep:]
        named = {f"v={n}" for n in numbers}
        for n in numbers:
            named |= {f"load={r['load']}" for r in self.files(n).select("load").distinct().collect()}
            named |= {f"load={r['load']}" for r in self.loads(n).select("load").distinct().collect()}
            named.add(self._filters_name(n))
        dropped = 0
        for folder in ("versions", "data", "ids", "filters"):
            for name in self._names(f"{folder}/*"):
                if name not in named:
                    files, path = self._fs(f"{self.path}/{folder}/{name}")
                    dropped += bool(files.delete(path, True))
        return dropped

    # -- ids -------------------------------------------------------------------

    def _filters_name(self, version: int | None = None) -> str:
        number = self.version() if version is None else version
        return self.spark.read.parquet(f"{self.path}/versions/v={number}/about").first()["filters"]

    def _bucket(self, id_: Column) -> Column:
        return F.pmod(F.xxhash64(id_), F.lit(self.buckets)).cast("int")

    def _probes(self, ids: DataFrame) -> DataFrame:
        """For every id (with its bucket) the places of its bits."""
        place = F.explode(F.array(*[F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(self.blocks * BLOCK_BITS)) for seed in range(1, PROBES + 1)])).alias("_place")
        placed = ids.select("id", "bucket", place)
        return placed.select("id", "bucket", F.floor(F.col("_place") / BLOCK_BITS).cast("int").alias("block"), (F.col("_place") % BLOCK_BITS).cast("int").alias("bit"))

    def _write_ids(self, ids: DataFrame, load: str) -> None:
        placed = ids.withColumn("bucket", self._bucket(F.col("id")))
        dealt = placed.repartition("bucket").sortWithinPartitions("bucket", "id")
        dealt.write.partitionBy("bucket").parquet(f"{self.path}/ids/load={load}")

    def _write_filters(self, load: str, old: DataFrame) -> None:
        ids = self._ids_of([load]).select("id", "bucket")
        fresh = self._probes(ids).groupBy("bucket", "block").agg(F.bitmap_construct_agg(F.col("bit").cast("long")).alias("bits"))
        whole = old.unionByName(fresh).groupBy("bucket", "block").agg(F.bitmap_or_agg("bits").alias("bits"))
        # As many rows as buckets have blocks, whatever is stored.
        whole.coalesce(1).write.parquet(f"{self.path}/filters/{load}")

    def _ids_of(self, loads: list[str]) -> DataFrame:
        if not loads:
            return self.spark.createDataFrame([], _IDS)
        return self.spark.read.schema(_IDS).option("basePath", f"{self.path}/ids").parquet(*[f"{self.path}/ids/load={load}" for load in loads]).select("id", "ts_us", "env", "epoch", "bucket")

    def _ids(self) -> DataFrame:
        return self._ids_of([r["load"] for r in self.loads().select("load").distinct().collect()])

    def _live(self, ids: DataFrame) -> DataFrame:
        """Ids whose signal has not been expired since."""
        limits = self.limits().select(F.col("env").alias("_env"), "limit_us")
        return ids.join(F.broadcast(limits), ids["env"].eqNullSafe(F.col("_env")), "left").where("ts_us is null or limit_us is null or ts_us >= limit_us").select(ids.columns)

    def maybe_stored(self, ids: DataFrame) -> DataFrame:
        """id, bucket of the given ids the filters do not rule out."""
        asked = ids.select("id").where("id is not null").distinct().withColumn("bucket", self._bucket(F.col("id")))
        probes = self._probes(asked).join(broadcast_if_small(self.filters()), ["bucket", "block"], "left")
        byte = F.conv(F.hex(F.substring(F.col("bits"), F.floor(F.col("bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        is_set = F.coalesce(F.getbit(byte, F.col("bit") % 8) == 1, F.lit(False))
        return probes.groupBy("id", "bucket").agg(F.bool_and(is_set).alias("maybe")).where("maybe").select("id", "bucket")

    def known_ids(self, ids: DataFrame, epoch: int | None = None) -> DataFrame:
        """Which of the given ids are stored, those of ``epoch`` itself left out. Exact: filters only save reading."""
        none = self.spark.createDataFrame([], "id string")
        if not self.version():
            return none
        maybe = checkpointed(self.maybe_stored(ids))
        # At most as many numbers as there are buckets.
        opened = [r["bucket"] for r in maybe.select("bucket").distinct().collect()]
        if not opened:
            return none
        stored = self._ids().where(F.col("bucket").isin(opened))
        if epoch is not None:
            stored = stored.where(F.col("epoch") != epoch)
        return self._live(stored).join(broadcast_if_small(maybe.select("id")), "id", "left_semi").select("id").distinct()
