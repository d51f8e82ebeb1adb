"""Change feed: content hashes, classified changes, and file streams drained to their end."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import shared_folder


def hashed(files: DataFrame) -> DataFrame:
    return files.select("path", F.xxhash64(F.coalesce("content", F.lit(""))).alias("hash"))


def classify(old: DataFrame, new: DataFrame) -> DataFrame:
    """``(path, hash)`` before and after -> path, change: added, changed, removed or unchanged."""
    j = old.withColumnRenamed("hash", "before").join(new.withColumnRenamed("hash", "after"), "path", "full")
    change = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(F.col("before") == F.col("after"), "unchanged").otherwise("changed")
    return j.withColumn("change", change)


def drained(spark: SparkSession, folder: str, glob: str, transform: Callable[[DataFrame], DataFrame], mode: str = "append") -> DataFrame:
    """Run a file stream over all that is there (``availableNow``) and return what it gave, from the shared folder.

    A batch is a table of its own, so one that is run again replaces what it wrote; of a complete result the last counts.
    """
    schema, path = spark.read.parquet(f"{folder}/{glob}").schema, f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    source = spark.readStream.schema(schema).option("pathGlobFilter", glob).parquet(folder)
    last = [-1]

    def keep(df: DataFrame, epoch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/rows/batch={epoch}")
        last[0] = epoch

    result = transform(source)
    run = result.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    if last[0] < 0:
        return spark.createDataFrame([], result.schema)
    return spark.read.schema(result.schema).parquet(f"{path}/rows/batch={last[0]}" if mode == "complete" else f"{path}/rows/*")


def watch(spark: SparkSession, folder: str, schema: str, state_path: str, on_changes: Callable[[DataFrame, int], None], checkpoint: str):
    """Start a stream of ``(path, content)`` files; each batch's changes go to ``on_changes`` and the hash table is kept.

    A file without content (null) is one that was removed. The table of hashes has a generation per batch, so a batch
    that is run again reads the same one; generations before that are deleted.
    """

    def batch(df: DataFrame, epoch: int) -> None:
        files = df.groupBy("path").agg(F.max("content").alias("content"))
        now = hashed(files.where("content IS NOT NULL"))
        old = spark.read.parquet(f"{state_path}/{epoch - 1}") if epoch else spark.createDataFrame([], "path string, hash long")
        seen = old.join(files.select("path"), "path", "left_semi")
        on_changes(classify(seen, now).where("change <> 'unchanged'").select("path", "change"), epoch)
        old.join(files.select("path"), "path", "left_anti").unionByName(now).write.mode("overwrite").parquet(f"{state_path}/{epoch}")
        if epoch > 1:
            gone = spark._jvm.org.apache.hadoop.fs.Path(f"{state_path}/{epoch - 2}")
            gone.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(gone, True)

    source = spark.readStream.schema(schema).parquet(folder)
    return source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
