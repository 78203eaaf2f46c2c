"""Finished results as files: written by batch and once only, read back with what is not a result set aside, and swept by age.

A batch is a folder of JSON lines (id, options, result). A batch that runs again replaces its own folder, so a stream
that starts anew after a failure leaves each result once. Of an id that several batches wrote the last one counts, of one
batch the greatest text: when a file was written depends on which task ended first.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

# Fixed value: what an id looks like.
ID = r"^[A-Za-z0-9][A-Za-z0-9_-]{0,80}$"
STORED = "id string, options string, result string, _corrupt string"


def save(results: DataFrame, path: str, batch: int) -> None:
    """Write id, options, result (the latter two as JSON text) as the batch's files; ids that are none are left out."""
    results.where(F.col("id").rlike(ID)).select("id", "options", "result").write.mode("overwrite").option("compression", "gzip").json(f"{path}/batch={batch}")


def saving(path: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch."""
    return lambda df, batch: save(df, path, batch)


STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_to(rows: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Run a stream over what there is now, batch by batch, and wait for it. State with timers needs a store that can keep
    them on disk; it is set where the session still has the default."""
    conf = rows.sparkSession.conf
    if not conf.get(STORE).endswith("RocksDBStateStoreProvider"):
        conf.set(STORE, ROCKS)
    q = rows.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start()
    q.awaitTermination()
    return q


def scanned(spark: SparkSession, path: str) -> DataFrame:
    """id, options, result, batch, written_at, reason: every line at path; reason says why one is no result, else null."""
    d = spark.read.schema(f"{STORED}, batch long").option("columnNameOfCorruptRecord", "_corrupt").option("basePath", path).json(f"{path}/batch=*")
    d = d.select("id", "options", "result", "_corrupt", "batch", F.col("_metadata.file_modification_time").alias("written_at"))
    reason = F.when(F.col("_corrupt").isNotNull(), "not JSON").when(~F.coalesce(F.col("id").rlike(ID), F.lit(False)), "no id").when(F.col("result").isNull(), "no result")
    return d.select("id", "options", "result", "batch", "written_at", reason.alias("reason"))


def loaded(spark: SparkSession, path: str, order: tuple[str, ...] = ("batch",)) -> DataFrame:
    """id, options, result, written_at: the last result of each id, by `order` and then by its text. Without an order it does
    not matter how rows were dealt over batches."""
    d = scanned(spark, path).where("reason is null")
    return d.groupBy("id").agg(F.max(F.struct(*order, "options", "result", "written_at")).alias("x")).select("id", "x.options", "x.result", "x.written_at")


def expired(spark: SparkSession, path: str, cutoff: dt.datetime) -> DataFrame:
    """id of every result whose last file was written before cutoff."""
    return loaded(spark, path).where(F.col("written_at") < F.lit(cutoff)).select("id")


def sweep(spark: SparkSession, path: str, cutoff: dt.datetime) -> int:
    """Delete the files that were written before cutoff; how many. Names of files, not their rows, pass the driver."""
    old = spark.read.format("binaryFile").option("basePath", path).load(f"{path}/batch=*").where(F.col("modificationTime") < F.lit(cutoff)).select("path")
    n, conf = 0, spark.sparkContext._jsc.hadoopConfiguration()
    for r in old.toLocalIterator():
        p = spark._jvm.org.apache.hadoop.fs.Path(r.path)
        n += p.getFileSystem(conf).delete(p, False)
    return n


def last_rows(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Of a table that `keeping` wrote in update mode, the last row of each key."""
    d = spark.read.option("basePath", path).parquet(f"{path}/batch=*")
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("batch"), F.desc("_place")))
    return d.withColumn("_rank", rank).where("_rank = 1").drop("_rank", "_place", "batch")


def keeping(path: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: the batch's rows as Parquet in a folder of its own."""
    return lambda df, batch: df.withColumn("_place", F.monotonically_increasing_id()).write.mode("overwrite").parquet(f"{path}/batch={batch}")
