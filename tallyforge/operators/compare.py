"""Comparison of audited ballots with the vendor's cast-vote records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Official options that are broadcast at most.
KNOWN_ROWS = 100_000
PARTIES = "DEM|REP|REF|NPA|GRN|PNF|LIB"


def clean_selection(c: Column, pattern: str | None = None) -> Column:
    """A CVR selection as an official option's name: the pattern's first
    group if it matches, without party before and number in brackets after."""
    if pattern:
        c = F.when(c.rlike(pattern), F.regexp_extract(c, pattern, 1)).otherwise(c)
    return F.trim(F.regexp_replace(F.regexp_replace(c, rf"^({PARTIES})\s*", ""), r"\(\d+\)$", ""))


def audit_options(votes: DataFrame) -> DataFrame:
    """Votes per ballot, contest and option; a repeated option counts once."""
    return votes.groupBy("ballot_id", "contest", "option").agg(F.max("num_votes").cast("int").alias("audit_votes"))


def cvr_unified(cvr: DataFrame, options: DataFrame) -> DataFrame:
    """Per ballot and contest: overvotes, undervotes, writeins, tot_votes and
    unrecognised selections. cvr: ballot_id, contest, slot, selection. An
    overvote (slots come in order, so in the first) silences the others."""
    known = options.select("contest", F.col("option").alias("name")).distinct()
    if known.count() <= KNOWN_ROWS:  # otherwise a shuffled join, by keys of which a few are on most rows
        known = F.broadcast(known)
    df = cvr.withColumn("name", clean_selection(F.col("selection"))).join(known.withColumn("official", F.lit(True)), ["contest", "name"], "left")
    kind = F.when(F.col("selection") == "overvote", "o").when(F.col("selection") == "undervote", "u").when(F.col("selection") == "write-in:", "w").when(F.col("official"), "v").otherwise("x")
    df = df.withColumn("kind", kind)
    n = lambda k: F.count_if(F.col("kind") == k)
    per = df.groupBy("ballot_id", "contest").agg(n("o").alias("o"), n("u").alias("u"), n("w").alias("w"), F.countDistinct(F.when(F.col("kind") == "v", F.col("name"))).alias("v"), n("x").alias("x"))
    free = lambda c: F.when(F.col("o") > 0, 0).otherwise(c).cast("int")
    return per.select("ballot_id", "contest", (F.col("o") > 0).cast("int").alias("overvotes"), free(F.col("u")).alias("undervotes"), free(F.col("w")).alias("writeins"), free(F.col("w") + F.col("v")).alias("tot_votes"), free(F.col("x")).alias("unrecognized"))


def compared_options(audit: DataFrame, cvr: DataFrame) -> DataFrame:
    """Full outer comparison per ballot, contest and option; diff is audit
    less CVR, and null where one side lacks the contest."""
    df = audit.join(cvr, ["ballot_id", "contest", "option"], "full")
    return df.select("ballot_id", "contest", "option", "audit_votes", "cvr_votes", (F.col("audit_votes") - F.col("cvr_votes")).alias("diff"))


def options_of_marks(votes: DataFrame, recorded: Column, voted: Column, *more: Column) -> DataFrame:
    """compared_options where each mark has its vendor's record beside it
    (`recorded`, `voted`), so that there is nothing to join: one aggregation by
    ballot, contest and option. more: further aggregates, null on the rows of
    the record alone. As in a join, null keys equal nothing: their two sides
    stay apart."""
    names = [f"more{i}_" for i in range(len(more))]
    per = votes.groupBy("ballot_id", "contest", "option").agg(
        F.max("num_votes").cast("int").alias("a_"), F.max(F.when(recorded, voted.cast("int"))).alias("c_"), F.count_if(recorded).alias("n_"), *[m.alias(n) for m, n in zip(more, names, strict=True)],
    )
    row = lambda a, c, own: F.struct(a.alias("audit_votes"), c.alias("cvr_votes"), *[(F.col(n) if own else F.lit(None)).alias(n) for n in names])
    none = F.lit(None).cast("int")
    apart = F.col("ballot_id").isNull() | F.col("contest").isNull() | F.col("option").isNull()
    both, audit, record = row(F.col("a_"), F.col("c_"), True), row(F.col("a_"), none, True), row(none, F.col("c_"), False)
    rows = F.when(~apart, F.array(both)).when(F.col("n_") > 0, F.array(audit, record)).otherwise(F.array(audit))
    return per.select("ballot_id", "contest", "option", F.inline(rows)).withColumn("diff", F.col("audit_votes") - F.col("cvr_votes"))


def compared_contests(options: DataFrame, *more: Column) -> DataFrame:
    """Per ballot and contest: options compared, differing, and one-sided,
    and further aggregates."""
    return options.groupBy("ballot_id", "contest").agg(
        F.count("*").alias("options"), F.count_if(F.col("diff") != 0).alias("differing"),
        F.count_if(F.col("cvr_votes").isNull()).alias("audit_only"), F.count_if(F.col("audit_votes").isNull()).alias("cvr_only"), *more,
    ).withColumn("agreed", ((F.col("differing") == 0) & (F.col("audit_only") == 0) & (F.col("cvr_only") == 0)).cast("int"))


def compared_ballots(contests: DataFrame, *more: Column) -> DataFrame:
    return contests.groupBy("ballot_id").agg(F.count("*").alias("contests"), F.sum(1 - F.col("agreed")).cast("long").alias("disagreed"), F.min("agreed").alias("agreed"), *more)
