"""Marks, gaps and boxes along one axis."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def gap_report(rows: DataFrame, key: str, pos: str, order: list[str]) -> DataFrame:
    """Per consecutive pair whose distance is over 1.5 times the key's median:
    the distance, the typical one and how many marks are missing."""
    w = Window.partitionBy(key).orderBy(*order)
    d = rows.select(key, *order, (F.col(pos) - F.lag(pos).over(w)).cast("double").alias("d")).where("d is not null")
    typical = d.groupBy(key).agg(F.median("d").alias("typical"))
    found = d.join(typical, key).where("d > 1.5 * typical and typical > 0")
    return found.withColumn("missing", (F.floor((F.col("d") + F.col("typical") / 2) / F.col("typical")) - 1).cast("long"))


def mid_gaps(rows: DataFrame, key: str, pos: str) -> DataFrame:
    """Middles between consecutive marks, and one period beyond each end."""
    w = Window.partitionBy(key).orderBy(pos)
    d = rows.select(key, F.col(pos).cast("double").alias("p"), F.lag(pos).over(w).cast("double").alias("before"), F.lead(pos).over(w).cast("double").alias("after"), F.row_number().over(w).alias("i"))
    inner = d.where("before is not null").select(key, ((F.col("p") + F.col("before")) / 2).alias("mid"))
    first = d.where("before is null and after is not null").select(key, (F.col("p") - (F.col("after") - F.col("p")) / 2).alias("mid"))
    last = d.where("after is null and before is not null").select(key, (F.col("p") + (F.col("p") - F.col("before")) / 2).alias("mid"))
    return inner.unionByName(first).unionByName(last)


def nearest(rows: DataFrame, key: str, pos: str, marks: DataFrame, mark: str, order: list[str]) -> DataFrame:
    """rows with the mark nearest to pos among those of the same key; the
    lower of two as near. As-of joins both ways by one sort per key: no pair of
    row and mark is made."""
    left = rows.withColumns({"at_": F.col(pos).cast("double"), "m_": F.lit(None).cast("double"), "side_": F.lit(1)})
    right = marks.select(key, F.col(mark).cast("double").alias("at_"), F.col(mark).cast("double").alias("m_"), F.lit(0).alias("side_"))
    both = left.unionByName(right, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy("at_", "side_", *order)
    low = F.last("m_", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    high = F.first("m_", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    df = both.withColumns({"low_": low, "high_": high}).where("side_ = 1")
    pick = F.when(F.col("high_").isNull() | (F.col("at_") - F.col("low_") <= F.col("high_") - F.col("at_")), F.col("low_")).otherwise(F.col("high_"))
    return df.withColumn("nearest", pick).drop("at_", "m_", "side_", "low_", "high_")


def not_containing(boxes: DataFrame, key: str, idx: str) -> DataFrame:
    """Boxes (x, y, w, h) without those that contain another of their key; of
    equal boxes the later one stays."""
    b = boxes.select(key, *[F.col(c).alias(f"{c}_") for c in (idx, "x", "y", "w", "h")])
    inside = (F.col("x_") >= F.col("x")) & (F.col("y_") >= F.col("y")) & (F.expr("x_ + w_ <= x + w")) & (F.expr("y_ + h_ <= y + h"))
    same = F.expr(f"x_ = x and y_ = y and w_ = w and h_ = h and {idx}_ < {idx}")
    return boxes.join(b, (boxes[key] == b[key]) & (F.col(f"{idx}_") != F.col(idx)) & inside & ~same, "left_anti")


def runs(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Islands of equal successive values: first order, length."""
    w = Window.partitionBy(key).orderBy(order)
    new = rows.withColumn("n_", F.when(F.lag(value).over(w) == F.col(value), 0).otherwise(1)).withColumn("run", F.sum("n_").over(w))
    return new.groupBy(key, "run", value).agg(F.min(order).alias("start"), F.count("*").alias("length"))


def mean_places(marks: DataFrame, key: str) -> DataFrame:
    """Mean place per key and mark number. marks: key, member, pos, x."""
    return marks.groupBy(key, "pos").agg(F.avg("x").alias("mean"))


def distortions(marks: DataFrame, key: str) -> DataFrame:
    """key, member, metric: sum of distances from the mean places."""
    d = marks.join(mean_places(marks, key), [key, "pos"])
    return d.groupBy(key, "member").agg(F.round(F.sum(F.abs(F.col("x") - F.col("mean"))), 2).alias("metric"))


def most_average(marks: DataFrame, key: str, limit: float = 1000, drop: int = 10, least: int = 40) -> DataFrame:
    """key, member, metric of the member nearest to its key's mean places, the
    first of equals. Keys of more than `least` members lose up to `drop` whose
    metric is above the limit, the last ones first, and are judged again. Fewer
    than three members: the first."""
    one = distortions(marks, key)
    w = Window.partitionBy(key)
    ranked = one.withColumn("n", F.count("*").over(w))
    far = ranked.where((F.col("n") > least) & (F.col("metric") > limit)).withColumn("i", F.row_number().over(w.orderBy(F.desc("member")))).where(F.col("i") <= drop)
    again = distortions(marks.join(far.select(key, "member"), [key, "member"], "left_anti"), key).withColumn("n", F.count("*").over(w))
    best = lambda df: df.groupBy(key).agg(F.min_by(F.struct("member", "metric"), F.struct(F.when(F.col("n") < 3, 0.0).otherwise(F.col("metric")).alias("m"), "member")).alias("r")).select(key, "r.member", "r.metric")
    return best(again)


def timing_fallback(styles: DataFrame, constant: list[int]) -> DataFrame:
    """styles (style_ord, vector) with the vector used: its own, else that of
    the first style before it that has one, else the constant."""
    own = F.when(F.size(F.coalesce("vector", F.array().cast("array<int>"))) > 0, F.col("vector"))
    w = Window.partitionBy(F.lit(0)).orderBy("style_ord").rowsBetween(Window.unboundedPreceding, -1)  # one row per style
    return styles.withColumn("used", F.coalesce(own, F.first(own, ignorenulls=True).over(w), F.lit(constant)))
