"""A table that micro-batches are put into by key: versions of key ranges, and a manifest for each batch."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewick.sources.shared import written

#: Rows of 16 bytes that are broadcast at most.
MOST_BROADCAST = 1_000_000


@dataclass
class UpsertTable:
    """Rows by key in a folder, cut into ranges of an integer key column.

    ``rows/_version=<batch>/_range=<r>`` has the rows of a range as a batch left them; ``manifest/batch=<batch>`` names
    the version of each range that counts after the batch. A batch reads the ranges that it touches and no others, writes
    their new versions, then its manifest: it takes effect when that is complete. One that failed midway left nothing that
    counts and is written over when it runs again; one that is complete is passed over.

    newest: whether a row of a batch replaces the one of its key, else the one that was there stays. Of rows of one key in
    a batch the one with the largest ``order`` counts (the first of equal ones by all columns). width: keys in a range;
    a range is the unit that is rewritten, so some 10**6 rows are a good size.
    """

    path: str
    keys: Sequence[str]
    range_column: str
    width: int = 1_000_000
    newest: bool = True
    order: Sequence[str] = ()

    def _exists(self, spark: SparkSession, at: str) -> bool:
        path = spark._jvm.org.apache.hadoop.fs.Path(at)
        return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)

    def _complete(self, spark: SparkSession, no: int) -> bool:
        return self._exists(spark, f"{self.path}/manifest/batch={no}/_SUCCESS")

    def _last(self, spark: SparkSession, before: int | None = None) -> int | None:
        """The latest complete batch, or the latest before one."""
        if not self._exists(spark, f"{self.path}/manifest"):
            return None
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest")
        found = [int(x.getPath().getName().split("=")[1]) for x in folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)]
        return max((n for n in found if (before is None or n < before) and self._complete(spark, n)), default=None)

    def manifest(self, spark: SparkSession, no: int) -> DataFrame:
        return spark.read.schema("_range bigint, _version bigint").parquet(f"{self.path}/manifest/batch={no}")

    def _versions(self, like: DataFrame, wanted: DataFrame) -> DataFrame:
        """The rows of the versions in wanted, a written table: partitions outside its ranges are left out by the plan, others by its rows when the query runs."""
        low, high, n = wanted.agg(F.min("_range"), F.max("_range"), F.count("*")).first()
        within = F.lit(False) if low is None else F.col("_range").between(low, high)
        wanted = wanted.where(within)
        every = like.sparkSession.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in like.schema)}, _version bigint, _range bigint").parquet(f"{self.path}/rows").where(within)
        return every.join(F.broadcast(wanted) if n <= MOST_BROADCAST else wanted, ["_range", "_version"])

    def put(self, batch: DataFrame, no: int) -> None:
        spark, names = batch.sparkSession, batch.columns
        if self._complete(spark, no):
            return
        place = F.floor(F.col(self.range_column) / self.width).cast("bigint")
        rest = [c for c in names if c not in self.keys]
        rank = F.struct(*self.order, *[c for c in rest if c not in self.order])
        fresh = batch.groupBy(*self.keys).agg(F.max(rank).alias("_row")).select(*self.keys, "_row.*").select(*names, place.alias("_range"), F.lit(True).alias("_fresh"))
        fresh = written(fresh, "fresh")
        touched = fresh.select("_range").distinct()
        last = self._last(spark, no)
        merged, manifest = fresh, touched.select("_range", F.lit(no).cast("bigint").alias("_version"))
        if last is not None:
            known = self.manifest(spark, last)
            old = self._versions(batch, written(known.join(touched, "_range", "left_semi"), "touched"))
            both = fresh.unionByName(old.select(*names, "_range", F.lit(False).alias("_fresh")))
            wins = F.max if self.newest else F.min
            merged = both.groupBy("_range", *self.keys).agg(wins(F.struct("_fresh", *rest)).alias("_row")).select(*self.keys, "_row.*", "_range")
            manifest = manifest.unionByName(known.join(touched, "_range", "left_anti"))
        merged.select(*names, "_range").repartition("_range").write.mode("overwrite").partitionBy("_range").parquet(f"{self.path}/rows/_version={no}")
        manifest.write.mode("overwrite").parquet(f"{self.path}/manifest/batch={no}")

    def read(self, spark: SparkSession, schema: DataFrame) -> DataFrame:
        """All rows as of the last complete batch; schema: a frame with the table's columns."""
        last = self._last(spark)
        return schema.limit(0) if last is None else self._versions(schema, self.manifest(spark, last)).select(*schema.columns)

    def vacuum(self, spark: SparkSession) -> int:
        """Deletes the batches' folders of rows that the last manifest doesn't name, and the manifests before it. Returns how many folders went."""
        last, gone = self._last(spark), 0
        if last is None:
            return 0
        used = {r[0] for r in self.manifest(spark, last).select("_version").distinct().collect()}  # batches, not ranges
        for folder, keep in ((f"{self.path}/rows", lambda n: n in used or n > last), (f"{self.path}/manifest", lambda n: n >= last)):
            at = spark._jvm.org.apache.hadoop.fs.Path(folder)
            fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
            for x in fs.listStatus(at):
                name = x.getPath().getName()
                if "=" in name and not keep(int(name.split("=")[1])):
                    fs.delete(x.getPath(), True)
                    gone += 1
        return gone
