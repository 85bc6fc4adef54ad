"""Applying ledger events exactly once, however often they are sent and whenever a batch runs again.

Applied keys are kept by bucket, and a bucket holds neighbouring sequence numbers of a run, so a batch of new events
and their replays reads a few buckets and never the whole log.  Of a key the first payload stays; another payload goes to quarantine, once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BLOCK = 2048  # neighbouring sequence numbers of a run that share a bucket
BUCKETS = 256


def bucket_of(run: Column, seq: Column) -> Column:
    return F.pmod(F.xxhash64(run, F.floor(seq / BLOCK)), F.lit(BUCKETS)).cast("int")


class Log:
    """The applied and the quarantined events under ``root``, in folders bucket=B/batch=N.

    A batch that runs again after a failure replaces its own folders and looks at earlier batches only, so it gives what it gave before.
    """

    def __init__(self, spark: SparkSession, root: str, schema: str):
        self.spark, self.root, self.schema = spark, root, schema
        self.read_bytes: list[int] = []  # of each batch: the size of the files whose keys it looked up

    def _folders(self, kind: str, buckets: list[int]) -> list[str]:
        jvm = self.spark._jvm.org.apache.hadoop.fs
        paths = [jvm.Path(f"{self.root}/{kind}/bucket={b}") for b in buckets]
        fs = jvm.Path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())
        return [p.toString() for p in paths if fs.exists(p)]

    def _before(self, kind: str, buckets: list[int] | None, number: int | None) -> DataFrame:
        folders = [f"{self.root}/{kind}"] if buckets is None else self._folders(kind, buckets)
        if not folders or (buckets is None and not self._any(kind)):
            return self.spark.createDataFrame([], f"{self.schema}, bucket int, batch int")
        got = self.spark.read.schema(f"{self.schema}, bucket int, batch int").option("basePath", f"{self.root}/{kind}").parquet(*folders)
        return got if number is None else got.where(F.col("batch") < number)

    def _any(self, kind: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{kind}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def _size(self, df: DataFrame) -> int:
        jvm, conf = self.spark._jvm.org.apache.hadoop.fs, self.spark._jsc.hadoopConfiguration()
        return sum(p.getFileSystem(conf).getFileStatus(p).getLen() for p in map(jvm.Path, df.inputFiles()))

    def apply(self, batch: DataFrame, number: int) -> None:
        """Adds the events (run, seq, arrival, sha, ...) of micro-batch ``number``; for ``foreachBatch``."""
        events = batch.withColumn("bucket", bucket_of(F.col("run"), F.col("seq"))).persist()
        try:
            touched = [r[0] for r in events.select("bucket").distinct().collect()]  # at most BUCKETS numbers
            applied, refused = (self._before(kind, touched, number) for kind in ("applied", "quarantine"))
            self.read_bytes.append(self._size(applied) + self._size(refused))
            once = events.withColumn("_nth", F.row_number().over(Window.partitionBy("run", "seq", "sha").orderBy("arrival"))).where("_nth = 1").drop("_nth")
            key = ["run", "seq"]
            held = once.join(applied.select(*key, F.col("sha").alias("_held")), key, "left")
            marked = held.withColumn("_first", F.coalesce("_held", F.first("sha").over(Window.partitionBy(*key).orderBy("arrival")))).persist()
            new = marked.where("_held is null and sha = _first")
            clash = marked.where("sha <> _first").join(refused.select(*key, "sha"), [*key, "sha"], "left_anti")
            for kind, rows in (("quarantine", clash), ("applied", new)):
                out = rows.drop("_held", "_first").withColumn("batch", F.lit(number)).select(*batch.columns, "bucket", "batch")
                out = out.repartition("bucket")  # so that a bucket is one file, not one of each task
                out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(f"{self.root}/{kind}")
            marked.unpersist()
        finally:
            events.unpersist()

    def applied(self) -> DataFrame:
        return self._before("applied", None, None).drop("bucket", "batch")

    def quarantined(self) -> DataFrame:
        return self._before("quarantine", None, None).drop("bucket", "batch")

    def follow(self, events: DataFrame, checkpoint: str) -> None:
        """Applies a stream of events to its present end."""
        events.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
