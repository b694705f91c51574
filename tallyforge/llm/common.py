"""What the training-data operators share: table access, written
intermediate tables, broadcasts behind a size check, edge cases.

Edge cases common to all operators: a null text counts as empty, a null
doc_id is carried through, extra columns are ignored (columns are picked by
name before anything else), an empty table gives an empty result.
"""

from __future__ import annotations

import sys
import uuid

import pyspark
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only when it was counted and is below this.
BROADCAST_BYTES = 48 << 20

# Functions sent to executors carry their code along, so that workers need not
# have this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__.rpartition(".llm")[0]])


def process_cache(name: str) -> dict:
    """A dict that lives as long as the Python worker, shared by its tasks."""
    return pyspark.__dict__.setdefault("_tallyforge_cache", {}).setdefault(name, {})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where the session
    names none, a local master (one process, as in tests) gets a temporary
    folder; on a cluster that would be each machine's own, so it is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        context = spark.sparkContext._jsc.sc().getCheckpointDir()
        if context.isDefined():
            at = context.get()
        elif spark.sparkContext.master.split("[")[0] == "local":
            import tempfile

            at = "file://" + tempfile.mkdtemp(prefix="tallyforge-")
            spark.conf.set("spark.checkpoint.dir", at)
        else:
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return at.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read back: computed
    once, lineage cut, and safe against lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tallyforge/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that written() made, once what was made of them is
    itself written, and lets Spark's cleaner drop the shuffle files of the jobs
    that are over (it acts on what the JVM's collector finds unused)."""
    import gc

    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._written_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()
    tables[0].sparkSession._jvm.System.gc()


def sized(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """df marked for broadcast if rows * row_bytes is within BROADCAST_BYTES;
    otherwise as it is, for a shuffled join."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def documents(df: DataFrame, *more: str) -> DataFrame:
    """doc_id as long and the text with nulls as empty, plus named columns."""
    return df.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        *more,
    )


def bind(value: Column, body) -> Column:
    """body(value) with value computed once: a one-element transform works as
    a let, since a lambda variable isn't recomputed at each use."""
    return F.transform(F.array(value), body).getItem(0)
