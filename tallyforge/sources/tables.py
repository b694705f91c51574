"""The driver's tables in the engine's shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows in a part of a large shuffle, and of a table that is broadcast at most.
PART_ROWS = 250_000
#: Parts up to which a task writes a shuffle without holding its rows (Spark's default), and parts' worth of rows that a task holds otherwise.
UNHELD_PARTS, HELD_PARTS = 200, 8


def table(spark: SparkSession, at: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{at}/{name}.parquet")


def dealt(df: DataFrame, key: str, rows: int = 20_000) -> DataFrame:
    """df dealt over tasks of about so many rows by a key, for work that is
    long per row: a small file is one task's input however many rows it has.
    Counting Parquet reads its footers only."""
    n = -(-df.count() // rows)
    return df if n < 2 else df.repartition(max(n, df.sparkSession.sparkContext.defaultParallelism), key)


def parts(df: DataFrame) -> int:
    """In how many parts df is to be shuffled for PART_ROWS in each; 0 if the
    session's own parallelism does. Counting Parquet reads its footers only."""
    n = -(-df.count() // PART_ROWS)
    own = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return n if n > min(own, df.sparkSession.sparkContext.defaultParallelism) else 0


def lookup_parts(n: int) -> int:
    """In how many parts to look up what then goes on in n: rows pass by the
    table's share, so a part may have more of them. A scan that deals rows to
    more than UNHELD_PARTS holds its whole split to sort it."""
    return n if n > UNHELD_PARTS * HELD_PARTS else min(n, UNHELD_PARTS)


def looked_up(rows: DataFrame, one: DataFrame, key: str, own: str, n: int, small: bool = True) -> DataFrame:
    """Inner join of rows with a table that has a key once, in n parts, of
    which a task holds the table's share only and sorts neither side; Spark's
    own plan for n = 0. Where the table may be small (it is counted) it is
    broadcast instead, and the rows stay where they are."""
    on = F.col(key) == F.col(own)
    if not n:
        return rows.join(one, on)
    if small and one.count() <= PART_ROWS:
        return rows.join(F.broadcast(one), on)
    return rows.repartition(n, key).join(one.repartition(n, own).hint("shuffle_hash"), on)


def marks(spark: SparkSession, at: str) -> DataFrame:
    """Order lines as measured voting targets. Only the needed columns are
    read. The join by order comes last, so the marks leave it partitioned by
    ballot and what goes on by ballot needs no other shuffle. The number of
    parts grows with the rows, so that a task's share doesn't."""
    line = table(spark, at, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag")
    order = table(spark, at, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus")
    customer = table(spark, at, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    part = table(spark, at, "part").select("p_partkey", "p_type", "p_brand")
    n = parts(line)
    orders = looked_up(order, customer, "o_custkey", "c_custkey", lookup_parts(parts(order)))
    df = looked_up(line, part, "l_partkey", "p_partkey", lookup_parts(n))
    df = looked_up(df, orders, "l_orderkey", "o_orderkey", n, small=False)
    return df.select(
        F.col("l_orderkey").alias("ballot_id"), F.col("p_type").alias("contest"), F.col("p_brand").alias("option"),
        F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("opt_ord"), (F.col("l_quantity") * 6).cast("int").alias("pmv"),
        F.col("c_nationkey").alias("precinct"), F.col("c_mktsegment").alias("party"), F.col("o_orderpriority").alias("style_num"), F.col("o_orderstatus").alias("sheet"),
        (1 + F.length("p_type") % 2).alias("vote_for"), F.col("l_returnflag").alias("flag"),
    )


def cvr(marks_df: DataFrame) -> DataFrame:
    """The vendor's votes on the same targets, which differ on a slice and
    lack some rows by design."""
    return marks_df.where("flag <> 'N'").groupBy("ballot_id", "contest", "option").agg(F.max((F.col("pmv") >= 228).cast("int")).alias("cvr_votes"))


def bif(spark: SparkSession, at: str) -> DataFrame:
    """Orders as a ballot index."""
    o, c = table(spark, at, "orders"), table(spark, at, "customer")
    df = o.join(c, o.o_custkey == c.c_custkey)
    return df.select(
        F.col("o_orderkey").alias("ballot_id"), F.col("c_nationkey").alias("precinct"), F.col("c_mktsegment").alias("party"), F.col("o_orderpriority").alias("style_num"),
        F.col("o_orderstatus").alias("sheet"), (F.col("o_totalprice") > 250000).alias("is_bmd"), (F.col("o_orderkey") % 97 == 0).alias("style_roi_corrupted"),
    )
