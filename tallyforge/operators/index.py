"""The ballot index: filters, chunking, first-N, styles, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def chunked(df: DataFrame, most: int, order: list[str], keys: list[str] | None = None) -> DataFrame:
    """df with chunk_idx: ceil(n / most) chunks per key whose sizes differ by
    one at most, the larger first. most must be positive."""
    if most <= 0:
        raise ValueError("chunks need a positive size")
    part = Window.partitionBy(*(keys or [F.lit(0)]))
    n, i = F.count("*").over(part), F.row_number().over(part.orderBy(*order)) - 1
    k = F.ceil(n / most)
    df = df.withColumns({"n_": n, "i_": i, "k_": k})
    q, r = F.floor(F.col("n_") / F.col("k_")), F.col("n_") % F.col("k_")
    big = r * (q + 1)
    idx = F.when(F.col("i_") < big, F.floor(F.col("i_") / (q + 1))).otherwise(r + F.floor((F.col("i_") - big) / q))
    return df.withColumn("chunk_idx", idx.cast("int")).drop("n_", "i_", "k_")


def first_n(df: DataFrame, n: int, key: str, order: list[str], least: int = 0) -> DataFrame:
    """The first n rows per key, for keys that have at least `least` rows."""
    w = Window.partitionBy(key)
    return df.withColumns({"i_": F.row_number().over(w.orderBy(*order)), "n_": F.count("*").over(w)}).where(f"i_ <= {n} and n_ >= {least}").drop("i_", "n_")


def drop_while(df: DataFrame, until: Column, order: list[str], key: list[str] | None = None) -> DataFrame:
    """Rows from the first that meets the condition on."""
    w = Window.partitionBy(*(key or [F.lit(0)])).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("on_", F.max(until.cast("int")).over(w)).where("on_ = 1").drop("on_")


def included(df: DataFrame, key: str, include: DataFrame | None, exclude: DataFrame | None) -> DataFrame:
    """Semi join with the include list, or else anti join with the other."""
    if include is not None:
        return df.join(include, key, "left_semi")
    return df.join(exclude, key, "left_anti") if exclude is not None else df


def selected(df: DataFrame, order: list[str], precincts: Column | None = None, include: DataFrame | None = None, exclude: DataFrame | None = None, skip: int = 0, limit: int | None = None) -> DataFrame:
    """Ballots of the precincts, then of the lists (ballot_id), then without
    the first `skip`, then at most `limit`, in order."""
    df = included(df if precincts is None else df.where(precincts), "ballot_id", include, exclude)
    if not skip and limit is None:
        return df
    df = df.orderBy(*order)
    df = df.offset(skip) if skip else df
    return df if limit is None else df.limit(limit)


#: Bytes below which a ballot's file is a printed summary's.
SUMMARY_BYTES = 25_000


def summaries(files: DataFrame, below: int = SUMMARY_BYTES) -> DataFrame:
    """ballot_id, is_bmd of ballot files (ballot_id, size of the first one)."""
    return files.select("ballot_id", (F.col("size") < below).alias("is_bmd"))


def repeats(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Each repeat of a key after its first row, numbered from 2."""
    return df.withColumn("occurrence", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("occurrence > 1")


def keep_first(df: DataFrame, key: list[str], order: list) -> DataFrame:
    return df.withColumn("i_", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("i_ = 1").drop("i_")


def style_contests(marks: DataFrame) -> DataFrame:
    """Ordered contest list per style."""
    return marks.select("style_num", "contest").distinct().groupBy("style_num").agg(F.array_join(F.sort_array(F.collect_list("contest")), "|").alias("contests"))


def adjacency(rows: DataFrame, style: str, item: str, order: str) -> DataFrame:
    """Distinct (item, next item) per the order within styles; a null item
    starts each style and a null next item ends it."""
    w = Window.partitionBy(style).orderBy(order)
    pairs = rows.select(F.lag(item).over(w).alias("item"), F.col(item).alias("next"))
    last = rows.withColumn("e_", F.lead(item).over(w)).where("e_ is null").select(F.col(item).alias("item"), F.lit(None).cast("string").alias("next"))
    return pairs.unionByName(last).distinct()


def report(bif: DataFrame) -> DataFrame:
    """Counts of an index in one pass."""
    return bif.agg(
        F.count("*").alias("records"), F.countDistinct("ballot_id").alias("ballots"), (F.count("*") - F.countDistinct("ballot_id")).alias("duplicates"),
        F.countDistinct("precinct").alias("precincts"), F.countDistinct("party").alias("parties"), F.countDistinct("style_num").alias("styles"),
        F.count_if(F.col("is_bmd")).alias("bmd"), F.count_if(~F.col("is_bmd")).alias("non_bmd"), F.count_if(F.col("style_roi_corrupted")).alias("corrupted"),
    )
