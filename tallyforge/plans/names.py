"""Official and scanned names compared by insertions and deletions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fuzzy
from ..sources import tables
from .registry import query


def common_sql(a: str, b: str) -> str:
    """Length of the longest common subsequence of two lists in SQL, the second
    of at most 120 entries: columns of the usual table as bits of one number."""
    masks = f"list_transform({a}, lambda c: coalesce(list_sum(list_transform(range(1, len({b}) + 1), lambda j: case when {b}[j] = c then 1::hugeint << (j - 1) else 0::hugeint end)), 0)::hugeint)"
    full = f"((1::hugeint << len({b})::integer) - 1)"
    return f"(len({b}) - bit_count(list_reduce(list_prepend({full}, {masks}), lambda v, x: ((v + (v & x)) | (v - (v & x))) & {full})))"


def ratio_sql(a: str, b: str) -> str:
    return f"(case when len({a}) + len({b}) = 0 then 1.0::double else 2.0::double * {common_sql(a, b)} / (len({a}) + len({b})) end)"


#: Names of a contest as printed and as scanned: another part's, or its own with letters misread.
NAMES = """names as (select p_partkey, p_brand as grp, p_type || ' ' || p_size as official, translate(p_type || ' ' || p_size, 'EO1', 'F0I') as scanned from part)"""
#: (pair) a and b as lists of characters, and b cut at its right and left.
CUTS = """cuts as (select *, string_split(official, '') as a, string_split(scanned, '') as b, string_split(left(scanned, least(length(official), length(scanned))), '') as l, string_split(right(scanned, least(length(official), length(scanned))), '') as r from pairs)"""
BEST = f"greatest({ratio_sql('a', 'b')}, {ratio_sql('a', 'l')}, {ratio_sql('a', 'r')})"


def _names(spark, at):
    name = F.concat("p_type", F.lit(" "), F.col("p_size").cast("string"))
    return tables.table(spark, at, "part").select("p_partkey", F.col("p_brand").alias("grp"), name.alias("official"), F.translate(name, "EO1", "F0I").alias("scanned"))


@query(f"with {NAMES}, pairs as (select p_partkey, official, 'x ' || scanned || case when p_partkey % 3 = 0 then ' and more' else '' end as scanned from names), {CUTS} select p_partkey, round({ratio_sql('a', 'b')}, 6) as whole, round({ratio_sql('a', 'l')}, 6) as at_left, round({ratio_sql('a', 'r')}, 6) as at_right, round({BEST}, 6) as best from cuts")
def justified_ratios(spark, at):
    """A scanned name against the official one: whole, cut at either end, best."""
    n = _names(spark, at)
    s = F.concat(F.lit("x "), "scanned", F.when(F.col("p_partkey") % 3 == 0, " and more").otherwise(""))
    m = lambda mode: F.round(fuzzy.justified_ratio(F.col("official"), s, mode), 6)
    return n.select("p_partkey", m("full").alias("whole"), m("left").alias("at_left"), m("right").alias("at_right"), m("best").alias("best"))


PAIRS = f"""{NAMES}, pairs as (select distinct s.grp, s.scanned, o.official from (select distinct grp, scanned from names where p_partkey % 2 = 0) as s join (select distinct grp, official from names where p_partkey % 2 = 1) as o using (grp)), {CUTS},
 measured as (select grp, scanned, official, round({BEST}, 6) as metric from cuts)"""


def _measured(spark, at):
    """Names are compared within their contest; a contest's list is printed on one ballot."""
    n = _names(spark, at)
    s, o = n.where("p_partkey % 2 = 0").select("grp", "scanned").distinct(), n.where("p_partkey % 2 = 1").select("grp", "official").distinct()
    return s.join(o, "grp").withColumn("metric", F.round(fuzzy.justified_ratio(F.col("official"), F.col("scanned")), 6))


@query(f"with {PAIRS}, r as (select *, row_number() over w as i, lead(metric) over w as second from measured window w as (partition by grp, scanned order by metric desc, official)) select grp, scanned, official, metric, coalesce(metric > 0.7 and metric - second < 0.3, false) as close from r where i = 1 and metric > 0.75")
def best_official(spark, at):
    """The official name nearest to a scanned one, and whether another is close."""
    w = Window.partitionBy("grp", "scanned").orderBy(F.desc("metric"), "official")
    r = _measured(spark, at).withColumns({"i": F.row_number().over(w), "second": F.lead("metric").over(w)}).where("i = 1 and metric > 0.75")
    return r.select("grp", "scanned", "official", "metric", F.coalesce((F.col("metric") > 0.7) & (F.col("metric") - F.col("second") < 0.3), F.lit(False)).alias("close"))


@query(f"with {PAIRS}, r as (select *, row_number() over (partition by grp, scanned order by metric desc, official) as i, row_number() over (partition by grp, official order by metric desc, scanned) as j from measured) select grp, scanned, official, metric from r where i = 1 and j = 1")
def mutual_best(spark, at):
    """Names that are each other's nearest."""
    i = F.row_number().over(Window.partitionBy("grp", "scanned").orderBy(F.desc("metric"), "official"))
    j = F.row_number().over(Window.partitionBy("grp", "official").orderBy(F.desc("metric"), "scanned"))
    return _measured(spark, at).withColumns({"i": i, "j": j}).where("i = 1 and j = 1").select("grp", "scanned", "official", "metric")


@query(f"""with w as (select p_partkey, string_split(p_name, ' ') as o, string_split(case when p_partkey % 5 = 0 then p_name || ' more' else translate(p_name, 'eo', 'c0') end, ' ') as s from part), z as (select p_partkey, len(o) = len(s) as even, unnest(list_zip(o, s)) as p from w),
 m as (select p_partkey, even, string_split(p[1], '') as a, string_split(p[2], '') as b, p[2] is null or p[1] is null as odd from z) select p_partkey, bool_and(even and not odd and coalesce({ratio_sql('a', 'b')}, 0) >= 0.6) as matches from m group by p_partkey""")
def lists_alike(spark, at):
    """Whether all names of a list match those of another in order."""
    s = F.when(F.col("p_partkey") % 5 == 0, F.concat("p_name", F.lit(" more"))).otherwise(F.translate("p_name", "eo", "c0"))
    return tables.table(spark, at, "part").select("p_partkey", fuzzy.lists_alike(F.split("p_name", " "), F.split(s, " "), 0.6).alias("matches"))


@query(f"with w as (select p_partkey, string_split(p_name, ' ') as a, string_split(case when p_partkey % 3 = 0 then 'ABSFNTEE ' else '' end || replace(p_name, 'green', 'black'), ' ') as s from part), c as (select p_partkey, a, case when p_partkey % 3 = 0 then s[2:] else s end as b from w) select p_partkey, {ratio_sql('a', 'b')} >= 0.8 as matches from c")
def header_lines(spark, at):
    """Lines of a page's header against the wanted ones; a line that says
    ABSENTEE, even misread, doesn't count."""
    s = F.concat(F.when(F.col("p_partkey") % 3 == 0, "ABSFNTEE ").otherwise(""), F.replace("p_name", F.lit("green"), F.lit("black")))
    return tables.table(spark, at, "part").select("p_partkey", fuzzy.headers_alike(F.split("p_name", " "), F.split(s, " ")).alias("matches"))


YES_NO = {"Ves|N0": "Yes|No", "yos|nc": "YES|NO", "yep|nope": "Yes|No", "For|Agalnst": "For|Against", "up|down": "For|Against"}


@query(f"""with k as (select p_partkey, [{', '.join(f"'{k}'" for k in YES_NO)}][1 + p_partkey % 5] as s, [{', '.join(f"'{v}'" for v in YES_NO.values())}][1 + p_partkey % 5] as o from part),
 l as (select p_partkey, lower(o) = 'yes|no' and regexp_matches(lower(split_part(s, '|', 1)), '[yv][eo]s') and regexp_matches(lower(split_part(s, '|', 2)), 'n[eo0qc]') as plain, string_split(replace(lower(o), '|', '='), '') as a, string_split(replace(lower(s), '|', '='), '') as b from k)
 select p_partkey, plain or {ratio_sql('a', 'b')} >= 0.75 as matches, case when plain then 1.0 else round({ratio_sql('a', 'b')}, 6) end as metric from l""")
def yes_no_options(spark, at):
    """Two short options against yes and no, or other short words."""
    i = (F.col("p_partkey") % 5).cast("int")
    rows = tables.table(spark, at, "part").select("p_partkey", F.split(F.get(F.lit(list(YES_NO)), i), r"\|").alias("s"), F.split(F.get(F.lit(list(YES_NO.values())), i), r"\|").alias("o"))
    m = rows.select("p_partkey", fuzzy.yes_no_match("s", "o").alias("m"))
    return m.select("p_partkey", "m.matches", F.round("m.metric", 6).alias("metric"))


@query("select p_partkey, case when p_partkey % 2 = 0 then p_size > 10 and p_partkey % 5 < 4 and (p_partkey % 7 < 5 or p_size < 30) else p_partkey % 7 < 5 and p_partkey % 3 > 0 end as accepted from part")
def contest_accepted(spark, at):
    """Whether regions are taken for a contest, by what of it agrees."""
    p, s = F.col("p_partkey"), F.col("p_size")
    return tables.table(spark, at, "part").select("p_partkey", fuzzy.accepted(s > 10, p % 5 < 4, p % 7 < 5, p % 3 > 0, p % 2 == 0, s >= 30).alias("accepted"))
