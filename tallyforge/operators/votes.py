"""From pixel values to votes: thresholds, mark classes, contest evaluation.

Everything is window and hash aggregation keyed by ballot or (ballot, contest),
so the data are shuffled by ballot once and each ballot is evaluated where it
is; AQE splits nothing because no ballot is large.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NO_MARK, MARGINAL, DEFINITE = "NoMark", "MarginalMark", "DefiniteMark"
DEFAULT = (200.0, 245.0)
BLANK_RANGE, GAP_SHARE, GAP_OVER_MEAN = 80, 0.5, 50


def _gaps(marks: DataFrame, ballot: str, pmv: str) -> DataFrame:
    """marks with i_ (place in the ballot's sorted values), gap_ to the next
    value, most_ (the largest gap) and before_ (mean of the gaps before the
    last): windows over one partitioning and one sort order."""
    w = Window.partitionBy(ballot).orderBy(pmv, *[c for c in ("opt_ord",) if c in marks.columns])
    df = marks.select("*", (F.row_number().over(w) - 1).alias("i_"), (F.lead(pmv).over(w) - F.col(pmv)).cast("double").alias("gap_"))
    return df.select("*", F.avg("gap_").over(w.rowsBetween(Window.unboundedPreceding, -2)).alias("before_"), F.max("gap_").over(Window.partitionBy(ballot)).alias("most_"))


def _firsts(pmv: str, over) -> tuple[Column, Column, Column]:
    """Range of the values, and the middles of the first gap above half the
    largest and of the first above the mean by 50, from the third gap on."""
    first = lambda when: over(F.min(F.when(when & (F.col("i_") >= 2), F.struct("i_", (F.col(pmv) + F.col("gap_") / 2).cast("double").alias("t")))))["t"]
    return over(F.max(pmv)) - over(F.min(pmv)), first(F.col("gap_") > F.col("most_") * GAP_SHARE), first(F.col("gap_") > F.col("before_") + GAP_OVER_MEAN)


def _pair(span: Column, a: Column, b: Column) -> tuple[Column, Column]:
    none = (span < BLANK_RANGE) | (a.isNull() & b.isNull())
    one = a.isNull() | b.isNull()
    return F.when(none, DEFAULT[0]).when(one, F.coalesce(a, b) - 1).otherwise(F.least(a, b)), F.when(none, DEFAULT[1]).otherwise(F.greatest(a, b))


def adaptive_thresholds(marks: DataFrame, ballot: str = "ballot_id", pmv: str = "pmv") -> DataFrame:
    """marginal and definite threshold per ballot.

    Values are sorted; from the third gap on, the first gap above half the
    largest and the first above the mean of the gaps before its predecessor by
    50 give a threshold each, in the gap's middle. Ballots of small range, or
    without such a gap, get the defaults; one threshold alone is the definite
    one, the marginal one is one below."""
    span, a, b = _firsts(pmv, lambda c: c)
    found = _gaps(marks, ballot, pmv).groupBy(ballot).agg(span.alias("span"), a.alias("a"), b.alias("b"))
    low, high = _pair(F.col("span"), F.col("a"), F.col("b"))
    return found.select(ballot, low.alias("marginal"), high.alias("definite"))


def with_thresholds(marks: DataFrame, ballot: str = "ballot_id", pmv: str = "pmv") -> DataFrame:
    """marks with their ballot's thresholds, by windows alone: the marks are
    read once and shuffled once, by ballot, with nothing to join."""
    whole = Window.partitionBy(ballot)
    span, a, b = _firsts(pmv, lambda c: c.over(whole))
    df = _gaps(marks, ballot, pmv).select("*", span.alias("span_"), a.alias("a_"), b.alias("b_"))
    low, high = _pair(F.col("span_"), F.col("a_"), F.col("b_"))
    return df.select(*marks.columns, low.alias("marginal"), high.alias("definite"))


def classified(marks: DataFrame) -> DataFrame:
    """marks with has_indication and num_marks, by the thresholds in the
    columns marginal and definite, or by fixed ones where there are none."""
    own = {"marginal", "definite"} <= set(marks.columns)
    low, high = (F.col("marginal"), F.col("definite")) if own else (F.lit(DEFAULT[0]), F.lit(DEFAULT[1]))
    kind = F.when(F.col("pmv") < low, NO_MARK).when(F.col("pmv") < high, MARGINAL).otherwise(DEFINITE)
    return marks.withColumn("has_indication", kind).withColumn("num_marks", (kind == DEFINITE).cast("int"))


def evaluated(marks: DataFrame) -> DataFrame:
    """marks with overvotes, undervotes (of their contest) and num_votes.

    More definite marks than vote_for: one overvote, no votes. Fewer: marginal
    marks are promoted in option order until vote_for is reached; what is still
    missing are undervotes."""
    contest = Window.partitionBy("ballot_id", "contest")
    ranked = Window.partitionBy("ballot_id", "contest", "has_indication").orderBy("opt_ord")
    # The rank first: its order serves the contest's counts too.
    df = marks.select("*", F.row_number().over(ranked).alias("k_")).select(
        "*",
        F.sum("num_marks").over(contest).cast("int").alias("d_"),
        F.count_if(F.col("has_indication") == MARGINAL).over(contest).cast("int").alias("m_"),
    )
    over = F.col("d_") > F.col("vote_for")
    vote = F.when(over, 0).when(F.col("has_indication") == DEFINITE, 1).when((F.col("has_indication") == MARGINAL) & (F.col("k_") <= F.col("vote_for") - F.col("d_")), 1).otherwise(0)
    return df.select(
        *marks.columns,
        over.cast("int").alias("overvotes"),
        F.when(over, 0).otherwise(F.greatest(F.col("vote_for") - F.col("d_") - F.col("m_"), F.lit(0))).cast("int").alias("undervotes"),
        vote.cast("int").alias("num_votes"),
    )
