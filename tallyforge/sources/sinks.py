"""Where results go: one base address for all tables of a job."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Store:
    """Tables of a job below a base address that all executors reach. Writing
    a table anew replaces it; chunks of a table are its partitions."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")

    def path(self, name: str) -> str:
        if not name or any(p in ("", ".", "..") for p in name.split("/")):
            raise ValueError(f"table name {name!r}")
        return f"{self.base}/{name}"

    def _fs(self, name: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def exists(self, name: str) -> bool:
        fs, p = self._fs(name)
        return fs.exists(p)

    def save(self, df: DataFrame, name: str, fmt: str = "parquet", chunk: str | None = None) -> None:
        """parquet, csv (with header), json or text; `chunk` names the column
        whose values are the partitions (only those written are replaced)."""
        w = df.write.mode("overwrite").format(fmt)
        if fmt == "csv":
            w = w.option("header", True)
        if chunk:
            w = w.partitionBy(chunk).option("partitionOverwriteMode", "dynamic")
        w.save(self.path(name))

    def load(self, name: str, schema: str | None = None, fmt: str = "parquet") -> DataFrame | None:
        """The table, or None if it was never written."""
        if not self.exists(name):
            return None
        r = self.spark.read.format(fmt)
        r = r.schema(schema) if schema else r
        return (r.option("header", True) if fmt == "csv" else r).load(self.path(name))

    def drop(self, name: str) -> bool:
        fs, p = self._fs(name)
        return bool(fs.delete(p, True))

    def files(self, name: str, pattern: str = ".*") -> list[str]:
        """Names of the files below, matched whole."""
        import re

        fs, p = self._fs(name)
        if not fs.exists(p):
            return []
        found = fs.listFiles(p, True)
        out = []
        while found.hasNext():
            n = found.next().getPath().getName()
            if re.fullmatch(pattern, n):
                out.append(n)
        return sorted(out)

    def append_log(self, rows: DataFrame) -> None:
        """Adds rows of exceptions or states to the job's log."""
        rows.withColumn("at", F.current_timestamp()).write.mode("append").parquet(self.path("log"))

    def todo(self, df: DataFrame, key: str, name: str) -> DataFrame:
        """Rows whose key has no result yet."""
        done = self.load(name)
        return df if done is None else df.join(done.select(key).distinct(), key, "left_anti")


def starter_metadata(results: DataFrame) -> DataFrame:
    """A first contest file from published results (contest, option, party)."""
    o = results.where("option is not null").select("contest", "option").distinct()
    per = o.groupBy("contest").agg(F.array_join(F.sort_array(F.collect_list("option")), ",").alias("official_options"))
    blank = lambda n: F.lit("").alias(n)
    return per.select(F.col("contest").alias("official_contest_name"), F.col("contest").alias("ballot_contest_name"), F.col("contest").alias("bmd_contest_name"), F.lit(1).alias("vote_for"), F.lit(0).alias("writein_num"), "official_options", blank("description"))


def member_copies(members: DataFrame, wanted: DataFrame, base: Column) -> DataFrame:
    """Writes the content of wanted archive members (by ballot_id) to files
    below a folder that executors reach through the local file system (such as a
    shared mount); returns what was written."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        for pdf in batches:
            out = []
            for to, data in zip(pdf["to"], pdf["content"], strict=True):
                os.makedirs(os.path.dirname(to), exist_ok=True)
                with open(f"{to}.part", "wb") as f:
                    f.write(data)
                os.replace(f"{to}.part", to)  # a task that runs again writes the same file
                out.append((to, len(data)))
            yield pd.DataFrame(out, columns=["file", "size"])

    rows = members.join(wanted.select("ballot_id").distinct(), "ballot_id", "left_semi")
    return rows.select(F.concat(base, F.lit("/"), F.regexp_replace("path", r"^.*/", "")).alias("to"), "content").mapInPandas(run, "file string, size long")


def word_rows(spark: SparkSession, path: str) -> DataFrame:
    """Recognised words of tab-separated files, without any quoting."""
    schema = "level int, page_num int, block_num int, par_num int, line_num int, word_num int, `left` int, top int, width int, height int, conf double, text string"
    return spark.read.schema(schema).option("sep", "\t").option("quote", "").option("header", True).csv(path)
