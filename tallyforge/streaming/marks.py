"""Marks that arrive in chunks: incremental upsert and running tabulation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SCHEMA = "ballot_id long, contest string, option string, ssidx int, num_votes int, ts timestamp"
KEY = ["ballot_id", "contest", "option"]


def arriving(spark: SparkSession, folder: str, files: int = 100) -> DataFrame:
    """Chunk files of marks as a stream, some files per batch."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files).parquet(folder)


def latest(rows: DataFrame) -> DataFrame:
    """The row of the highest ssidx per target."""
    rest = [c for c in rows.columns if c not in KEY]
    return rows.groupBy(*KEY).agg(F.max_by(F.struct(*rest), "ssidx").alias("r")).select(*KEY, "r.*")


def upserted(stream: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Keeps folder `table` at the latest state per target; each batch writes
    a new version beside the old one, named by the batch, so that a batch that
    runs again after a failure gives the same state. Versions before the last
    two are deleted."""

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        now, before = f"{table}/v={number}", f"{table}/v={number - 1}"
        old = spark.read.schema(batch.schema).parquet(before) if number else None
        latest(batch if old is None else batch.unionByName(old)).write.mode("overwrite").parquet(now)
        if number > 1:
            past = spark._jvm.org.apache.hadoop.fs.Path(f"{table}/v={number - 2}")
            past.getFileSystem(spark._jsc.hadoopConfiguration()).delete(past, True)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_totals(stream: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Votes per contest and window of event time; later rows than the
    watermark allows are left out."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width), "contest").agg(F.sum("num_votes").alias("votes"), F.count("*").alias("marks"))
