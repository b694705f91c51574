"""Fuzzy matching of scanned names with official ones."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text
from ..sources import tables
from .names import ratio_sql
from .registry import query

PAIRS = """a as (select distinct p_brand as grp, p_type || ' ' || p_size as ocr from part where p_partkey % 2 = 0), b as (select distinct p_brand as grp, p_type || ' ' || p_size as official from part where p_partkey % 2 = 1),
 pairs as (select grp, ocr, official, round(1 - levenshtein(ocr, official) / cast(greatest(length(ocr), length(official)) as double), 6) as metric from a join b using (grp))"""


def _pairs(spark, at):
    """Names are compared within their contest (grp) only; the lists of a
    contest are short."""
    p = tables.table(spark, at, "part").select(F.col("p_brand").alias("grp"), F.concat("p_type", F.lit(" "), F.col("p_size").cast("string")).alias("name"), (F.col("p_partkey") % 2 == 0).alias("ocr"))
    a, b = p.where("ocr").select("grp", F.col("name").alias("ocr")).distinct(), p.where("not ocr").select("grp", F.col("name").alias("official")).distinct()
    return a.join(b, "grp").withColumn("metric", F.round(text.levenshtein_ratio(F.col("ocr"), F.col("official")), 6))


@query(f"with {PAIRS}, r as (select *, row_number() over w as i, lead(metric) over w as second from pairs window w as (partition by grp, ocr order by metric desc, official)) select grp, ocr, official, metric, metric > 0.7 and metric - second < 0.3 as close from r where i = 1 and metric > 0.6")
def fuzzy_best_match(spark, at):
    w = Window.partitionBy("grp", "ocr").orderBy(F.desc("metric"), "official")
    r = _pairs(spark, at).withColumns({"i": F.row_number().over(w), "second": F.lead("metric").over(w)}).where("i = 1 and metric > 0.6")
    return r.select("grp", "ocr", "official", "metric", ((F.col("metric") > 0.7) & (F.col("metric") - F.col("second") < 0.3)).alias("close"))


@query(f"with {PAIRS}, r as (select *, row_number() over (partition by grp, ocr order by metric desc, official) as i, row_number() over (partition by grp, official order by metric desc, ocr) as j from pairs) select grp, ocr, official, metric from r where i = 1 and j = 1")
def fuzzy_mutual_assignment(spark, at):
    i = F.row_number().over(Window.partitionBy("grp", "ocr").orderBy(F.desc("metric"), "official"))
    j = F.row_number().over(Window.partitionBy("grp", "official").orderBy(F.desc("metric"), "ocr"))
    return _pairs(spark, at).withColumns({"i": i, "j": j}).where("i = 1 and j = 1").select("grp", "ocr", "official", "metric")


@query(f"with w as (select p_partkey, string_split(p_name, '') as a, string_split(p_type || ' ' || p_name, '') as b from part) select p_partkey, round({ratio_sql('a', 'b')}, 6) as ratio from w")
def indel_ratio(spark, at):
    """Ratio by insertions and deletions of successive part names."""
    p = tables.table(spark, at, "part").select("p_partkey", F.col("p_name").alias("a"), F.concat(F.col("p_type"), F.lit(" "), F.col("p_name")).alias("b"))
    return p.select("p_partkey", F.round(text.indel_ratio("a", "b"), 6).alias("ratio"))
