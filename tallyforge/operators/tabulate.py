"""Tabulation of evaluated marks by contest, option, precinct."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ballot_contests(votes: DataFrame) -> DataFrame:
    """One row per ballot and contest: the header row of the marks."""
    return votes.groupBy("ballot_id", "contest").agg(
        F.max("overvotes").alias("overvotes"), F.max("undervotes").alias("undervotes"), F.sum("num_votes").alias("votes"), F.sum("num_marks").alias("marks"),
        F.max("precinct").alias("precinct"), F.max("style_num").alias("style_num"),
    )


def contest_totals(votes: DataFrame, *keys: str) -> DataFrame:
    """overvotes, undervotes, votes and ballots per contest (and keys). Counts
    go through one row per ballot and contest, combined before the shuffle."""
    return ballot_contests(votes).groupBy(*keys, "contest").agg(
        F.sum("overvotes").cast("long").alias("overvotes"), F.sum("undervotes").cast("long").alias("undervotes"),
        F.sum("votes").cast("long").alias("tot_votes"), F.count("*").alias("num_ballots"),
    )


def option_totals(votes: DataFrame, options: DataFrame) -> DataFrame:
    """votes and percentage per official option; options nobody chose have 0.
    options: contest, option. A contest without votes has no percentage."""
    got = votes.groupBy("contest", "option").agg(F.sum("num_votes").cast("long").alias("votes"))
    total = got.groupBy("contest").agg(F.sum("votes").alias("t_"))
    df = options.join(got, ["contest", "option"], "left").join(total, "contest", "left")
    return df.select("contest", "option", F.coalesce("votes", F.lit(0)).cast("long").alias("votes"), F.round(F.try_divide(F.coalesce("votes", F.lit(0)) * 100.0, F.col("t_")), 4).alias("pct"))


def rolled_up(votes: DataFrame) -> DataFrame:
    """Votes by contest and precinct, by contest, and in all."""
    rows = votes.groupBy("contest", "precinct").agg(F.sum("num_votes").alias("v"))
    return rows.rollup("contest", "precinct").agg(F.sum("v").cast("long").alias("votes"), F.grouping_id().cast("int").alias("level"))


def histogram(marks: DataFrame, width: int = 10, top: int = 830) -> DataFrame:
    """Number of values per bin; the last bin is closed on the right."""
    low = F.least((F.floor(F.col("pmv") / width) * width).cast("int"), F.lit(top - width))
    return marks.where((F.col("pmv") >= 0) & (F.col("pmv") <= top)).groupBy(low.alias("bin")).agg(F.count("*").alias("n"))


def results(votes: DataFrame) -> DataFrame:
    """A row per contest with its options as an ordered list of structs."""
    per = votes.groupBy("contest", "option").agg(F.sum("num_votes").cast("long").alias("votes"))
    return per.groupBy("contest").agg(F.sort_array(F.collect_list(F.struct("option", "votes"))).alias("options"))
