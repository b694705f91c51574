"""The ballot index: reports, filters, chunks, styles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import index
from ..sources import tables
from .registry import BIF, MARKS, query


@query(f"with {BIF} select count(*) as records, count(distinct ballot_id) as ballots, count(*) - count(distinct ballot_id) as duplicates, count(distinct precinct) as precincts, count(distinct party) as parties, count(distinct style_num) as styles, count(*) filter (where is_bmd) as bmd, count(*) filter (where not is_bmd) as non_bmd, count(*) filter (where style_roi_corrupted) as corrupted from bif")
def bif_report(spark, at):
    return index.report(tables.bif(spark, at))


@query(f"with {BIF} select sheet, count(*) as n, count(distinct precinct) as precincts from bif group by sheet")
def bif_sheet_counts(spark, at):
    return tables.bif(spark, at).groupBy("sheet").agg(F.count("*").alias("n"), F.countDistinct("precinct").alias("precincts"))


@query(f"with {BIF} select precinct, string_agg(distinct style_num, '|' order by style_num) as styles, count(distinct style_num) as n from bif group by precinct")
def style_per_card(spark, at):
    return tables.bif(spark, at).groupBy("precinct").agg(F.array_join(F.sort_array(F.collect_set("style_num")), "|").alias("styles"), F.countDistinct("style_num").alias("n"))


@query("select l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(i as integer) as occurrence from (select *, row_number() over (partition by l_orderkey, l_linenumber order by l_partkey, l_suppkey) as i from lineitem) where i > 1")
def bif_duplicates(spark, at):
    l = tables.table(spark, at, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return index.repeats(l, ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey"])


@query(f"with {BIF} select ballot_id, style_num, is_bmd from bif where not style_roi_corrupted and not is_bmd and style_num in ('1-URGENT', '2-HIGH') and precinct not in (1, 2)")
def extraction_filter(spark, at):
    b = tables.bif(spark, at).where("not style_roi_corrupted and not is_bmd")
    keep = spark.createDataFrame([("1-URGENT",), ("2-HIGH",)], "style_num string")
    return b.join(F.broadcast(keep), "style_num", "left_semi").where("precinct not in (1, 2)").select("ballot_id", "style_num", "is_bmd")


@query(f"with {BIF} select ballot_id, precinct from bif where ballot_id in (select l_orderkey from lineitem where l_quantity >= 50)")
def ballotid_include(spark, at):
    ids = tables.table(spark, at, "lineitem").where("l_quantity >= 50").select(F.col("l_orderkey").alias("ballot_id"))
    return index.included(tables.bif(spark, at).select("ballot_id", "precinct"), "ballot_id", ids, None)


@query(f"with {BIF} select ballot_id, precinct from bif where ballot_id not in (select l_orderkey from lineitem where l_quantity >= 50)")
def ballotid_exclude(spark, at):
    ids = tables.table(spark, at, "lineitem").where("l_quantity >= 50").select(F.col("l_orderkey").alias("ballot_id"))
    return index.included(tables.bif(spark, at).select("ballot_id", "precinct"), "ballot_id", None, ids)


@query(f"with {BIF} select ballot_id, precinct from bif order by ballot_id limit 200 offset 50")
def skip_limit(spark, at):
    return tables.bif(spark, at).select("ballot_id", "precinct").orderBy("ballot_id").offset(50).limit(200)


@query(f"with {BIF}, m as (select precinct, min(ballot_id) filter (where style_num = '5-LOW') as f from bif group by precinct) select ballot_id, precinct, style_num from bif join m using (precinct) where ballot_id >= f")
def dropwhile(spark, at):
    b = tables.bif(spark, at).select("ballot_id", "precinct", "style_num")
    return index.drop_while(b, F.col("style_num") == "5-LOW", ["ballot_id"], ["precinct"])


@query(f"with {BIF}, r as (select *, row_number() over (partition by style_num, precinct order by ballot_id) as i, count(*) over (partition by style_num, precinct) as n from bif) select ballot_id, precinct, style_num from r where i <= 5 and n >= 3")
def template_first_n(spark, at):
    b = tables.bif(spark, at).withColumn("key", F.concat_ws("/", "style_num", F.col("precinct").cast("string")))
    return index.first_n(b, 5, "key", ["ballot_id"], 3).select("ballot_id", "precinct", "style_num")


@query(f"""with {BIF}, n as (select *, count(*) over (partition by sheet, precinct) as n, row_number() over (partition by sheet, precinct order by ballot_id) - 1 as i from bif), k as (select *, cast(ceil(n / 60.0) as bigint) as k from n), q as (select *, n // k as q, n % k as r from k)
 select ballot_id, sheet, precinct, cast(case when i < r * (q + 1) then i // (q + 1) else r + (i - r * (q + 1)) // q end as integer) as chunk_idx, sheet || '_chunk_' || lpad(cast(case when i < r * (q + 1) then i // (q + 1) else r + (i - r * (q + 1)) // q end as varchar), 4, '0') as chunk_name from q""")
def extraction_chunks(spark, at):
    b = tables.bif(spark, at).select("ballot_id", "sheet", "precinct")
    df = index.chunked(b, 60, ["ballot_id"], ["sheet", "precinct"])
    return df.withColumn("chunk_name", F.concat("sheet", F.lit("_chunk_"), F.lpad(F.col("chunk_idx").cast("string"), 4, "0")))


@query(f"with {MARKS} select style_num, string_agg(distinct contest, '|' order by contest) as contests from marks group by style_num")
def style_contests(spark, at):
    return index.style_contests(tables.marks(spark, at))


@query(f"with {MARKS}, s as (select cast(precinct * 10 + length(contest) % 3 as integer) as style, contest from marks where pmv > 297), l as (select style, string_agg(distinct contest, '|' order by contest) as contests from s group by style) select a.style, b.style as similar_to, a.contests from l a join l b on a.contests = b.contests and a.style <> b.style")
def similar_styles(spark, at):
    m = tables.marks(spark, at).where("pmv > 297").select((F.col("precinct") * 10 + F.length("contest") % 3).alias("style_num"), "contest")
    l = index.style_contests(m)
    return l.withColumnRenamed("style_num", "style").join(l.select(F.col("style_num").alias("similar_to"), "contests"), "contests").where("style <> similar_to").select("style", "similar_to", "contests")


@query(f"with {MARKS}, s as (select cast(precinct * 10 + length(contest) % 3 as integer) as style, contest from marks where pmv > 297), l as (select style, string_agg(distinct contest, '|' order by contest) as contests from s group by style) select style, min(style) over (partition by contests) as canonical from l")
def reduce_styles(spark, at):
    m = tables.marks(spark, at).where("pmv > 297").select((F.col("precinct") * 10 + F.length("contest") % 3).alias("style_num"), "contest")
    l = index.style_contests(m)
    least = l.groupBy("contests").agg(F.min("style_num").alias("canonical"))
    return l.join(least, "contests").select(F.col("style_num").alias("style"), "canonical")


@query("""with s as (select distinct o_orderpriority as style, cast(date_trunc('month', o_orderdate) as varchar) || o_orderstatus as item from orders), p as (select lag(item) over (partition by style order by item) as item, item as nxt from s union all select item, null from (select item, lead(item) over (partition by style order by item) as n from s) where n is null) select distinct item, nxt as next from p""")
def contest_tree(spark, at):
    o = tables.table(spark, at, "orders")
    s = o.select(F.col("o_orderpriority").alias("style"), F.concat(F.date_format(F.date_trunc("month", "o_orderdate"), "yyyy-MM-dd HH:mm:ss"), "o_orderstatus").alias("item")).distinct()
    return index.adjacency(s, "style", "item", "item")


@query(f"with {BIF}, look as (select party, precinct, min(style_num) as card_style, count(distinct style_num) as n from bif group by all) select ballot_id, b.party, b.precinct, card_style, n > 1 as ambiguous from bif b left join look using (party, precinct)")
def style_lookup_join(spark, at):
    b = tables.bif(spark, at)
    look = b.groupBy("party", "precinct").agg(F.min("style_num").alias("card_style"), F.countDistinct("style_num").alias("n"))
    return b.join(look, ["party", "precinct"], "left").select("ballot_id", "party", "precinct", "card_style", (F.col("n") > 1).alias("ambiguous"))


@query(f"with {BIF} select ballot_id, party, case party when 'BUILDING' then '100' when 'MACHINERY' then '200' end as style_strict, coalesce(case party when 'BUILDING' then '100' when 'MACHINERY' then '200' end, style_num) as style_or_own from bif")
def party_style_map(spark, at):
    m = F.create_map(*[F.lit(x) for x in ("BUILDING", "100", "MACHINERY", "200")])
    return tables.bif(spark, at).select("ballot_id", "party", F.element_at(m, F.col("party")).alias("style_strict"), F.coalesce(F.element_at(m, F.col("party")), "style_num").alias("style_or_own"))


@query(f"with {BIF} select ballot_id, case style_num when '5-LOW' then '4-NOT SPECIFIED' when '3-MEDIUM' then '2-HIGH' else style_num end as style_num from bif")
def merged_style_substitute(spark, at):
    merged = spark.createDataFrame([("5-LOW", "4-NOT SPECIFIED"), ("3-MEDIUM", "2-HIGH")], "style_num string, other string")
    return tables.bif(spark, at).join(F.broadcast(merged), "style_num", "left").select("ballot_id", F.coalesce("other", "style_num").alias("style_num"))


@query("select l_suppkey as card_code, count(distinct p_type) as types from lineitem join part on l_partkey = p_partkey group by l_suppkey having count(distinct p_type) > 1")
def mapping_inconsistency(spark, at):
    l, p = tables.table(spark, at, "lineitem"), tables.table(spark, at, "part")
    return l.join(p, l.l_partkey == p.p_partkey).groupBy(F.col("l_suppkey").alias("card_code")).agg(F.countDistinct("p_type").alias("types")).where("types > 1")


@query("select case when event_type = 'error' then 'Failed' else 'Completed' end as status, count(*) as n, round(count(*) * 100.0 / (select count(*) from events), 2) as pct from events group by all")
def tracker_status(spark, at):
    e = tables.table(spark, at, "events")
    per = e.groupBy(F.when(F.col("event_type") == "error", "Failed").otherwise("Completed").alias("status")).agg(F.count("*").alias("n"))
    total = per.agg(F.sum("n").alias("t_"))  # one row
    return per.join(F.broadcast(total)).select("status", "n", F.round(F.col("n") * 100.0 / F.col("t_"), 2).alias("pct"))


@query("select user_id, round(avg(case when event_type <> 'error' then 1.0 else 0.0 end) * 100, 2) as success from events group by user_id")
def mapping_success(spark, at):
    return tables.table(spark, at, "events").groupBy("user_id").agg(F.round(F.avg(F.when(F.col("event_type") != "error", 1.0).otherwise(0.0)) * 100, 2).alias("success"))


@query("select l_orderkey, l_linenumber, l_returnflag as chunk, null::integer as extra from lineitem where l_returnflag = 'A' union all select l_orderkey, l_linenumber, l_returnflag, cast(l_quantity as integer) from lineitem where l_returnflag = 'R'")
def union_chunks(spark, at):
    l = tables.table(spark, at, "lineitem")
    part = lambda flag: l.where(F.col("l_returnflag") == flag).select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("chunk"))
    b = l.where("l_returnflag = 'R'").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("chunk"), F.col("l_quantity").cast("int").alias("extra"))
    return part("A").unionByName(b, allowMissingColumns=True)


@query("select l_orderkey, l_partkey, l_suppkey, l_linenumber from (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as i from lineitem) where i = 1")
def dedupe_keep_first(spark, at):
    l = tables.table(spark, at, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    return index.keep_first(l, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"])


@query("select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events")
def json_props(spark, at):
    return tables.table(spark, at, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("(select c_custkey as k from customer except select o_custkey from orders)")
def set_difference(spark, at):
    c, o = tables.table(spark, at, "customer"), tables.table(spark, at, "orders")
    return c.select(F.col("c_custkey").alias("k")).distinct().join(o.select(F.col("o_custkey").alias("k")), "k", "left_anti")


@query("(select c_nationkey as k from customer intersect select s_nationkey from supplier)")
def set_intersection(spark, at):
    c, s = tables.table(spark, at, "customer"), tables.table(spark, at, "supplier")
    return c.select(F.col("c_nationkey").alias("k")).intersect(s.select("s_nationkey"))


@query("select o_custkey as k, max_by(o_orderkey, struct_pack(a := o_orderdate, b := o_orderkey)) as last_order, count(*) as n from orders group by o_custkey")
def keyed_last_wins(spark, at):
    return tables.table(spark, at, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("last_order"), F.count("*").alias("n"))


@query(f"with {BIF} select ballot_id, case when ballot_id % 11 = 0 then 'fixed' else style_num end as style_num from bif")
def point_update(spark, at):
    b = tables.bif(spark, at).select("ballot_id", "style_num")
    changes = b.where("ballot_id % 11 = 0").select("ballot_id", F.lit("fixed").alias("new"))
    return b.join(changes, "ballot_id", "left").select("ballot_id", F.coalesce("new", "style_num").alias("style_num"))


@query(f"with {BIF}, r as (select ballot_id, precinct, md5('seed-7:' || ballot_id) as h from bif), k as (select *, row_number() over (partition by precinct order by h, ballot_id) as i from r) select ballot_id, precinct from k where i <= 3")
def audit_draw(spark, at):
    """Seeded random draw of three ballots per precinct."""
    b = tables.bif(spark, at).select("ballot_id", "precinct").withColumn("h", F.md5(F.concat(F.lit("seed-7:"), F.col("ballot_id").cast("string"))))
    return index.first_n(b, 3, "precinct", ["h", "ballot_id"]).drop("h")
