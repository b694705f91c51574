"""Places on pages, layouts and templates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import coords
from ..operators import geometry, images, layouts, styles
from ..sources import tables
from .registry import BIF, query

#: An order's lines as timing marks down a page.
SIDE = """side as (select l_orderkey, list(struct_pack(y := cast(100 * l_linenumber + l_partkey % 7 as integer), h := cast(20 + l_suppkey % 5 as integer)) order by l_linenumber, l_partkey, l_suppkey) as marks from lineitem group by l_orderkey)"""


def _side(spark, at):
    m = F.struct("l_linenumber", "l_partkey", "l_suppkey", (100 * F.col("l_linenumber") + F.col("l_partkey") % 7).cast("int").alias("y"), (20 + F.col("l_suppkey") % 5).cast("int").alias("h"))
    rows = tables.table(spark, at, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(m)).alias("m"))  # an order's lines are few
    return rows.select("l_orderkey", F.transform("m", lambda x: F.struct(F.lit(5).alias("x"), x["y"].alias("y"), F.lit(40).alias("w"), x["h"].alias("h"))).alias("marks"))


@query(f"with {SIDE} select l_orderkey, array_to_string(list_transform(marks, lambda m: m.y + cast(round_even(m.h / 2, 0) as integer)), ',') as mids from side")
def mid_marks(spark, at):
    """Middles of timing marks; halves go to the even number."""
    return _side(spark, at).select("l_orderkey", F.array_join(F.transform(coords.mid_marks(F.col("marks")), lambda x: x.cast("string")), ",").alias("mids"))


@query(f"""with {SIDE}, g as (select l_orderkey, list_transform(range(1, len(marks)), lambda i: cast(round_even((marks[i + 1].y + marks[i].y + marks[i].h) / 2, 0) as integer)) as inner_, len(marks) as n from side),
 e as (select *, inner_[2] - inner_[1] as period from g) select l_orderkey, case when n >= 3 then array_to_string(list_concat([inner_[1] - period], inner_, [inner_[n - 1] + period]), ',') else '' end as gaps from e""")
def page_gaps(spark, at):
    """Middles of the gaps between marks and one period beyond both ends."""
    return _side(spark, at).select("l_orderkey", F.array_join(F.transform(coords.mid_gaps(F.col("marks")), lambda x: x.cast("string")), ",").alias("gaps"))


@query(f"""with {SIDE}, t as (select l_orderkey, marks, cast(l_orderkey % 700 as integer) as y, case when l_orderkey % 11 > 0 then cast(l_orderkey % 50 as integer) end as x from side), v as (select *, coalesce(x, 43) as x0, case when x is null then 33 else y end as y0, list_transform(marks, lambda m: m.y + cast(round_even(m.h / 2, 0) as integer)) as mids from t)
 select l_orderkey, x0 as x, mids[list_position(list_transform(mids, lambda p: abs(p - y0)), list_min(list_transform(mids, lambda p: abs(p - y0))))] as y, mids[list_position(list_transform(mids, lambda p: abs(p - y0)), list_min(list_transform(mids, lambda p: abs(p - y0))))] - y0 as dy from v""")
def targets_on_ballot(spark, at):
    """Mapped targets, or the region's corner, moved to a ballot's marks."""
    k = F.col("l_orderkey")
    x, roi = F.when(k % 11 > 0, (k % 50).cast("int")), F.struct(F.lit(7).alias("x"), F.lit(7).alias("y"))
    t = coords.on_ballot(x, (k % 700).cast("int"), roi, F.col("marks"))
    return _side(spark, at).select("l_orderkey", t["x"].alias("x"), t["y"].alias("y"), t["dy"].alias("dy"))


@query(f"""with {SIDE}, s as (select l_orderkey, list_transform(marks, lambda m: m.y) as a, list_transform(range(1, len(marks) + 1), lambda i: cast(110 * i as integer)) as b, cast(l_orderkey % 900 as integer) as t, len(marks) as n from side),
 f as (select *, len(list_filter(a, lambda m: m <= t)) as i from s)
 select l_orderkey, round(case when i > 0 and i < n then b[i] + (t - a[i]) * (b[i + 1] - b[i]) / cast(a[i + 1] - a[i] as double) when i = 0 then t + b[1] - a[1] else t + b[n] - a[n] end, 6) as y from f where len(list_distinct(a)) = n and a = list_sort(a)""")
def unstretched_places(spark, at):
    """Coordinates moved from a ballot's marks to the standard ones."""
    ys = F.transform("marks", lambda m: m["y"])
    rows = _side(spark, at).select("l_orderkey", ys.alias("a")).where((F.size(F.array_distinct("a")) == F.size("a")) & (F.col("a") == F.sort_array("a")))
    standard = F.transform(F.sequence(F.lit(1), F.size("a")), lambda i: i * 110)
    return rows.select("l_orderkey", F.round(coords.unstretched((F.col("l_orderkey") % 900).cast("int"), F.col("a"), standard), 6).alias("y"))


@query("""with m as (select l_orderkey, list(l_linenumber) filter (l_suppkey % 2 = 0) as a, list(l_linenumber) filter (l_suppkey % 2 = 1) as b, list(l_linenumber) filter (l_returnflag = 'R') as c, list(l_linenumber) filter (l_returnflag = 'A') as d from lineitem group by l_orderkey)
 select l_orderkey, coalesce(len(a) = len(b), false) and coalesce(c is null or d is null or len(c) = len(d), true) as fine from m""")
def consistent_marks(spark, at):
    """As many marks on both sides of a page; a back without any is fine."""
    got = lambda c: F.when(F.count_if(c) > 0, F.collect_list(F.when(c, F.col("l_linenumber"))))
    m = tables.table(spark, at, "lineitem").groupBy("l_orderkey").agg(got(F.col("l_suppkey") % 2 == 0).alias("a"), got(F.col("l_suppkey") % 2 == 1).alias("b"), got(F.col("l_returnflag") == "R").alias("c"), got(F.col("l_returnflag") == "A").alias("d"))
    return m.select("l_orderkey", coords.consistent(*map(F.col, "abcd")).alias("fine"))


@query("select p_partkey from (select p_partkey, p_size * 20 as x, p_partkey % 100 as y, 30 as w, 12 as h from part) where x >= 195 and y >= 5 and x + w <= 605")
def boxes_in_region(spark, at):
    """Boxes inside a region with some slack; a missing height doesn't bind."""
    b = tables.table(spark, at, "part").select("p_partkey", (F.col("p_size") * 20).alias("x"), (F.col("p_partkey") % 100).alias("y"), F.lit(30).alias("w"), F.lit(12).alias("h"))
    return images.in_region(b, F.lit(200), F.lit(10), F.lit(400), F.lit(None).cast("int"), 5).select("p_partkey")


@query("select n_nationkey, array_to_string(coalesce(own, first_value(own ignore nulls) over (order by n_nationkey rows between unbounded preceding and 1 preceding), [7, 8]), ',') as used from (select n_nationkey, case when n_nationkey % 4 = 2 then [cast(n_nationkey as integer), 1] end as own from nation)")
def timing_fallbacks(spark, at):
    """Timing vectors per style: its own, the first one known, or a constant."""
    k = F.col("n_nationkey")
    rows = tables.table(spark, at, "nation").select(k.alias("style_ord"), F.when(k % 4 == 2, F.array(k.cast("int"), F.lit(1))).alias("vector"))
    used = geometry.timing_fallback(rows, [7, 8])
    return used.select(F.col("style_ord").alias("n_nationkey"), F.array_join(F.transform("used", lambda x: x.cast("string")), ",").alias("used"))


@query("select p_brand as style_num, greatest(min(p_size) - 1, 0) as max_orphans from part group by p_brand")
def orphan_regions(spark, at):
    rows = tables.table(spark, at, "part").select(F.col("p_brand").alias("style_num"), F.col("p_size").alias("min_rois_num"))
    return styles.orphan_regions(rows).select("style_num", F.col("max_orphans"))


@query("with d as (select l_orderkey, list(cast(l_suppkey % 9 as bigint) order by l_linenumber, l_partkey, l_suppkey) filter (l_orderkey % 5 > 0) as v from lineitem group by l_orderkey) select l_orderkey, cast(coalesce(list_sum(v), 0) as bigint) as total, coalesce(v[1], 0) as first from d")
def determinant_sums(spark, at):
    """Sum of a ballot's determinants, and the first; 0 where it has none."""
    d = F.collect_list(F.when(F.col("l_orderkey") % 5 > 0, F.struct("l_linenumber", "l_partkey", "l_suppkey")))
    rows = tables.table(spark, at, "lineitem").groupBy("l_orderkey").agg(F.sort_array(d).alias("s"))
    v = F.transform("s", lambda x: x["l_suppkey"] % 9)
    return rows.select("l_orderkey", layouts.determinant_sum(v).alias("total"), layouts.determinant_sum(v, first=True).alias("first"))


@query("""with s(vendor, layout, ord, w_col, w_min, w_max, h_min, h_max) as (values ('ES&S', '3col', 0, 530, 510, 550, 45, 2500), ('ES&S', '2col', 0, 795, 760, 815, 45, 2500), ('ES&S', '1&2col', 0, 795, 760, 815, 45, 2500), ('ES&S', '1&2col', 1, 1590, 1570, 1610, 45, 500), ('ES&S', '1col', 0, 1590, 1570, 1610, 45, 500),
  ('Dominion', '3col', 0, 520, 500, 540, 45, 1600), ('Dominion', '2col', 0, 778, 758, 798, 45, 1000), ('Dominion', '1&2col', 0, 778, 758, 798, 45, 1000), ('Dominion', '1&2col', 1, 1557, 1537, 1577, 45, 500), ('Dominion', '1col', 0, 1557, 1537, 1577, 45, 500)),
 b as (select p_partkey, case when p_partkey % 2 = 0 then 'ES&S' else 'Dominion' end as vendor, ['3col', '2col', '1&2col', '1col'][1 + p_partkey % 4] as layout, 500 + 26 * p_size as w, 40 + p_partkey % 600 as h from part)
 select p_partkey, ord, w_col from b join s using (vendor, layout) where w >= w_min and w <= w_max and h >= h_min and h <= h_max""")
def layout_boxes(spark, at):
    """Boxes of a column width that their page's layout has."""
    p = F.col("p_partkey")
    b = tables.table(spark, at, "part").select(
        "p_partkey", F.when(p % 2 == 0, "ES&S").otherwise("Dominion").alias("vendor"), F.get(F.lit(["3col", "2col", "1&2col", "1col"]), (p % 4).cast("int")).alias("layout"),
        (500 + 26 * F.col("p_size")).alias("w"), (40 + p % 600).alias("h"),
    )
    return layouts.fitting(b, layouts.box_sizes(spark)).select("p_partkey", "ord", "w_col")


@query("select p_partkey, p_partkey % 3 = 1 and (20.0 * p_size) / (1 + p_partkey % 90) <= 5 as maybe_bmd from part")
def summary_guess(spark, at):
    """Single pages that are not long strips."""
    p = F.col("p_partkey")
    return tables.table(spark, at, "part").select("p_partkey", layouts.maybe_summary(p % 3, 20 * F.col("p_size"), 1 + p % 90).alias("maybe_bmd"))


@query(f"with {BIF}, rois as (select distinct p_brand as style_num, p_type as contest from part), s as (select ballot_id, 'Brand#' || (1 + ballot_id % 5) || (1 + precinct % 5) as style_num from bif) select ballot_id, count(*) as targets from s join rois using (style_num) group by ballot_id")
def targets_of_tasks(spark, at):
    """Ballots of a task list with their style's mapped targets."""
    rois = tables.table(spark, at, "part").select(F.col("p_brand").alias("style_num"), F.col("p_type").alias("contest")).distinct()
    style = F.concat(F.lit("Brand#"), (1 + F.col("ballot_id") % 5).cast("string"), (1 + F.col("precinct") % 5).cast("string"))
    return tables.bif(spark, at).select("ballot_id", style.alias("style_num")).join(rois, "style_num").groupBy("ballot_id").agg(F.count("*").alias("targets"))


@query("""with l as (select l_orderkey as ballot_id, 'S' || l_orderkey % 2 as style_num, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) - 1 as line_ord, cast(l_partkey as varchar) as text from lineitem),
 lay(style_num, contest_ord, contest, vote_for) as (values ('S0', 0, 'Mayor', 1), ('S0', 1, 'Board', 2), ('S1', 0, 'Bond', 1)), starts as (select *, coalesce(sum(1 + vote_for) over (partition by style_num order by contest_ord rows between unbounded preceding and 1 preceding), 0) as first from lay),
 t as (select ballot_id, style_num, list(text order by line_ord) as t from l group by all) select ballot_id, contest, t[cast(first + 1 as integer)] as ocr_contest, array_to_string(t[cast(first + 2 as integer):cast(first + 1 + vote_for as integer)], '|') as ocr_options from t join starts using (style_num)""")
def summary_contests(spark, at):
    """Printed summaries: a line for each contest's name and for each vote."""
    o = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    lines = tables.table(spark, at, "lineitem").select(F.col("l_orderkey").alias("ballot_id"), F.concat(F.lit("S"), (F.col("l_orderkey") % 2).cast("string")).alias("style_num"), (F.row_number().over(o) - 1).alias("line_ord"), F.col("l_partkey").cast("string").alias("text"))
    layout = spark.createDataFrame([("S0", 0, "Mayor", 1), ("S0", 1, "Board", 2), ("S1", 0, "Bond", 1)], "style_num string, contest_ord int, contest string, vote_for int")
    return images.summary_contests(lines, layout).select("ballot_id", "contest", "ocr_contest", F.array_join("ocr_options", "|").alias("ocr_options"))


@query("""with c as (select l_orderkey as ballot_id, 'S' || l_orderkey % 2 as style_num, lpad(cast(l_partkey % 40 as varchar), 6, '0') as key, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) - 1 as i, count(*) over (partition by l_orderkey) = 1 + l_orderkey % 4 as complete from lineitem),
 t as (select unnest(['S0', 'S1']) as style_num, lpad(cast(k as varchar), 6, '0') as key, case when k % 7 = 0 then 'writein_0' else 'option ' || k end as "option" from range(0, 40, 3) as r(k))
 select ballot_id, "option", complete, case when "option" = 'writein_0' then 'name ' || i end as writein_name, count(*) as n from c join t using (style_num, key) group by all""")
def barcode_votes(spark, at):
    """Targets that a printed summary's barcodes name, with written names."""
    m = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey")))
    rows = tables.table(spark, at, "lineitem").groupBy("l_orderkey").agg(m.alias("m"))
    codes = rows.select(
        F.col("l_orderkey").alias("ballot_id"), F.concat(F.lit("S"), (F.col("l_orderkey") % 2).cast("string")).alias("style_num"), F.transform("m", lambda x: F.lpad((x["l_partkey"] % 40).cast("string"), 6, "0")).alias("coords"),
        F.transform("m", lambda x, i: F.concat(F.lit("name "), i.cast("string"))).alias("names"), (1 + F.col("l_orderkey") % 4).alias("declared"),
    )
    k = F.col("id")
    map_ = spark.range(0, 40, 3).select(F.explode(F.array(F.lit("S0"), F.lit("S1"))).alias("style_num"), F.lit("c").alias("contest"), F.when(k % 7 == 0, "writein_0").otherwise(F.concat(F.lit("option "), k.cast("string"))).alias("option"), F.lpad(k.cast("string"), 6, "0").alias("ev_coord_str"))
    return images.barcode_votes(codes, map_).groupBy("ballot_id", "option", "complete", "writein_name").agg(F.count("*").alias("n"))
