"""Timing marks, boxes, vectors."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import geometry
from ..sources import tables
from .registry import query

EVENTS = "ev as (select event_id, user_id, event_type, epoch_us(ts) // 1000000 as pos from events)"
BOXES = """boxes as (select l_orderkey as page, cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as integer) as idx, cast(l_partkey % 40 as integer) as x, cast(l_suppkey * 13 % 90 as integer) as y, cast(l_quantity as integer) as w, cast(l_linenumber * 5 as integer) as h from lineitem)"""


def _events(spark, at):
    # Whatever the session's time zone: the table's time stamps have none.
    seconds = F.datediff(F.to_date("ts"), F.lit("1970-01-01")).cast("long") * 86400 + F.hour("ts") * 3600 + F.minute("ts") * 60 + F.floor(F.second("ts"))
    return tables.table(spark, at, "events").select("event_id", "user_id", "event_type", seconds.alias("pos"))


def _boxes(spark, at):
    l = tables.table(spark, at, "lineitem")
    idx = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    return l.select(F.col("l_orderkey").alias("page"), idx.alias("idx"), (F.col("l_partkey") % 40).cast("int").alias("x"), (F.col("l_suppkey") * 13 % 90).cast("int").alias("y"), F.col("l_quantity").cast("int").alias("w"), (F.col("l_linenumber") * 5).cast("int").alias("h"))


@query(f"""with {EVENTS}, d as (select *, pos - lag(pos) over (partition by user_id order by pos, event_id) as d from ev), t as (select user_id, median(d) as typical from d where d is not null group by user_id)
 select event_id, user_id, pos, cast(d as double) as d, cast(typical as double) as typical, cast(floor((d + typical / 2) / typical) - 1 as bigint) as missing from d join t using (user_id) where d > 1.5 * typical and typical > 0""")
def timing_gap_report(spark, at):
    return geometry.gap_report(_events(spark, at), "user_id", "pos", ["pos", "event_id"]).select("event_id", "user_id", "pos", "d", "typical", "missing")


@query(f"""with {EVENTS}, u as (select distinct user_id, pos from ev), d as (select user_id, cast(pos as double) as p, lag(pos) over w as b, lead(pos) over w as a from u window w as (partition by user_id order by pos))
 select user_id, (p + b) / 2.0 as mid from d where b is not null union all select user_id, p - (a - p) / 2.0 from d where b is null and a is not null union all select user_id, p + (p - b) / 2.0 from d where a is null and b is not null""")
def midgaps(spark, at):
    return geometry.mid_gaps(_events(spark, at).select("user_id", "pos").distinct(), "user_id", "pos")


@query(f"""with {EVENTS}, m as (select distinct user_id, pos as mark from ev where event_type = 'view' or event_id % 5 = 0), j as (select event_id, ev.user_id, pos, mark, row_number() over (partition by event_id order by abs(pos - mark), mark) as i from ev join m using (user_id))
 select event_id, user_id, pos, cast(mark as double) as nearest from j where i = 1""")
def nearest_mark_all(spark, at):
    e = _events(spark, at)
    m = e.where("event_type = 'view' or event_id % 5 = 0").select("user_id", F.col("pos").alias("mark")).distinct()
    # A row whose user has no mark has none; the inner join of the equivalent drops it.
    return geometry.nearest(e.select("event_id", "user_id", "pos"), "user_id", "pos", m, "mark", ["event_id"]).where("nearest is not null").select("event_id", "user_id", "pos", "nearest")


@query("""with bands as (select p_size as band, cast(floor(min(p_retailprice)) as integer) as y, cast(floor(max(p_retailprice) - min(p_retailprice)) as integer) as h from part group by p_size), t as (select s_suppkey, abs(s_acctbal) as y0 from supplier)
 select s_suppkey, coalesce(min(band), 0) as band, count(band) as several from t left join bands on y0 > y and y0 < y + h group by s_suppkey""")
def containing_mark(spark, at):
    bands = tables.table(spark, at, "part").groupBy(F.col("p_size").alias("band")).agg(F.floor(F.min("p_retailprice")).cast("int").alias("y"), F.floor(F.max("p_retailprice") - F.min("p_retailprice")).cast("int").alias("h"))
    t = tables.table(spark, at, "supplier").select("s_suppkey", F.abs("s_acctbal").alias("y0"))
    # At most one band per size code (a fixed small set), so it is broadcast for the range join.
    j = t.join(F.broadcast(bands), F.expr("y0 > y and y0 < y + h"), "left")
    return j.groupBy("s_suppkey").agg(F.coalesce(F.min("band"), F.lit(0)).alias("band"), F.count("band").alias("several"))


@query("""with r as (select l_suppkey as k, l_quantity as v, row_number() over (partition by l_suppkey order by l_quantity) - 1 as i, count(*) over (partition by l_suppkey) as n from lineitem)
 select k, round(avg(v), 2) as average, min(v) as least, max(v) as most, max(v) filter (where i = n // 2) as upper_median from r group by k""")
def list_stats(spark, at):
    w = Window.partitionBy("l_suppkey")
    l = tables.table(spark, at, "lineitem").select(F.col("l_suppkey"), F.col("l_quantity").alias("v"), (F.row_number().over(w.orderBy("l_quantity")) - 1).alias("i"), F.count("*").over(w).alias("n"))
    return l.groupBy(F.col("l_suppkey").alias("k")).agg(F.round(F.avg("v"), 2).alias("average"), F.min("v").alias("least"), F.max("v").alias("most"), F.max(F.when(F.col("i") == F.floor(F.col("n") / 2), F.col("v"))).alias("upper_median"))


VECTORS = "v as (select vec_id, label, unnest(embedding) as x, unnest(range(len(embedding))) as pos from embeddings), m as (select label, pos, avg(cast(x as double)) as mean from v group by label, pos)"


def _vectors(spark, at):
    return tables.table(spark, at, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("pos", "x")).withColumn("x", F.col("x").cast("double"))


@query(f"with {VECTORS} select label, cast(pos as integer) as pos, round(mean, 4) + 0.0 as mean from m")
def template_mean_vector(spark, at):
    return _vectors(spark, at).groupBy("label", "pos").agg((F.round(F.avg("x"), 4) + F.lit(0.0)).alias("mean"))


def _distortion(spark, at):
    v = _vectors(spark, at)
    mean = v.groupBy("label", "pos").agg(F.avg("x").alias("mean"))
    return v.join(mean, ["label", "pos"]).groupBy("label", "vec_id").agg(F.round(F.sum(F.abs(F.col("x") - F.col("mean"))), 4).alias("metric"), F.round(F.max(F.abs(F.col("x") - F.col("mean"))), 4).alias("most"))


@query(f"with {VECTORS} select label, vec_id, round(sum(abs(x - mean)), 4) as metric, round(max(abs(x - mean)), 4) as most from v join m using (label, pos) group by label, vec_id")
def distortion(spark, at):
    return _distortion(spark, at)


@query(f"with {VECTORS}, d as (select label, vec_id, round(sum(abs(x - mean)), 4) as metric from v join m using (label, pos) group by label, vec_id), r as (select *, row_number() over (partition by label order by metric, vec_id) as i from d) select label, vec_id, metric from r where i = 1")
def most_average(spark, at):
    return _distortion(spark, at).groupBy("label").agg(F.min_by(F.struct("vec_id", "metric"), F.struct("metric", "vec_id")).alias("r")).select("label", "r.vec_id", "r.metric")


@query("""with q as (select vec_id, label, embedding from embeddings where vec_id % 50 = 0), d as (select q.vec_id as query_id, q.label, row_number() over (partition by q.vec_id order by round(list_distance(cast(q.embedding as double[]), cast(e.embedding as double[])), 6), e.vec_id) as i, round(list_distance(cast(q.embedding as double[]), cast(e.embedding as double[])), 6) as dist from q join embeddings e on q.label = e.label and q.vec_id <> e.vec_id)
 select label, count(*) as points, count(*) filter (where d1 < 0.95 * d2) as matches from (select label, query_id, max(dist) filter (where i = 1) as d1, max(dist) filter (where i = 2) as d2 from d where i <= 2 group by all) group by label""")
def knn_ratio_matches(spark, at):
    """Ratio test of the two nearest of the same label. The queries are a
    stated set; per query only the two best are kept, as partial aggregates."""
    e = tables.table(spark, at, "embeddings")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "label", F.col("embedding").alias("q"))
    j = q.join(e, "label").where("query_id <> vec_id")
    square = F.aggregate(F.zip_with("q", "embedding", lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda s, x: s + x)
    j = j.select("label", "query_id", "vec_id", F.round(F.sqrt(square), 6).alias("dist"))
    i = F.row_number().over(Window.partitionBy("query_id").orderBy("dist", "vec_id"))
    two = j.withColumn("i", i).where("i <= 2").groupBy("label", "query_id").agg(F.max(F.when(F.col("i") == 1, F.col("dist"))).alias("d1"), F.max(F.when(F.col("i") == 2, F.col("dist"))).alias("d2"))
    return two.groupBy("label").agg(F.count("*").alias("points"), F.count_if(F.col("d1") < 0.95 * F.col("d2")).alias("matches"))


@query(f"""with {BOXES}, d as (select page, x // 20 as col, y, h, lag(y + h, 1, 0) over (partition by page, x // 20 order by y, idx) as prev from boxes)
 select page, cast(col as integer) as col, prev as y, y - prev as h from d where y > prev + 10""")
def fill_column_gaps(spark, at):
    b = _boxes(spark, at).withColumn("col", F.floor(F.col("x") / 20).cast("int"))
    w = Window.partitionBy("page", "col").orderBy("y", "idx")
    d = b.withColumn("prev", F.lag(F.col("y") + F.col("h"), 1, 0).over(w)).where("y > prev + 10")
    return d.select("page", "col", F.col("prev").alias("y"), (F.col("y") - F.col("prev")).alias("h"))


@query(f"with {BOXES} select page, idx, cast(row_number() over (partition by page order by x // 20, y, x, idx) as integer) as reading from boxes")
def reading_order(spark, at):
    r = F.row_number().over(Window.partitionBy("page").orderBy(F.floor(F.col("x") / 20), "y", "x", "idx"))
    return _boxes(spark, at).select("page", "idx", r.alias("reading"))


@query(f"with {BOXES} select page, idx from boxes o where not exists (select 1 from boxes i where i.page = o.page and i.idx <> o.idx and i.x >= o.x and i.y >= o.y and i.x + i.w <= o.x + o.w and i.y + i.h <= o.y + o.h and not (i.x = o.x and i.y = o.y and i.w = o.w and i.h = o.h and i.idx < o.idx))")
def contained_boxes(spark, at):
    return geometry.not_containing(_boxes(spark, at), "page", "idx").select("page", "idx")


@query(f"with {BOXES}, specs(s, w0, w1, h0, h1) as (values ('small', 1, 15, 5, 15), ('wide', 10, 50, 5, 20)) select page, idx, s as spec from boxes join specs on w between w0 and w1 and h between h0 and h1")
def size_filter(spark, at):
    specs = spark.createDataFrame([("small", 1, 15, 5, 15), ("wide", 10, 50, 5, 20)], "spec string, w0 int, w1 int, h0 int, h1 int")
    b = _boxes(spark, at).join(F.broadcast(specs), F.expr("w between w0 and w1 and h between h0 and h1"))
    return b.select("page", "idx", "spec")


@query(f"with {BOXES} select page, cast(min(x) as integer) as x, cast(min(y) as integer) as y, cast(max(x + w) - min(x) as integer) as w, cast(max(h) as integer) as h, count(*) as n from boxes group by page")
def bounding_boxes(spark, at):
    return _boxes(spark, at).groupBy("page").agg(F.min("x").alias("x"), F.min("y").alias("y"), (F.max(F.col("x") + F.col("w")) - F.min("x")).alias("w"), F.max("h").alias("h"), F.count("*").alias("n"))


@query("""with n as (select conv_id, turn, role, case when lag(role) over (partition by conv_id order by turn) = role then 0 else 1 end as n from conversations), r as (select *, sum(n) over (partition by conv_id order by turn) as run from n)
 select conv_id, cast(run as bigint) as run, role, min(turn) as start, count(*) as length from r group by conv_id, run, role""")
def runs(spark, at):
    c = tables.table(spark, at, "conversations").select("conv_id", "turn", "role")
    return geometry.runs(c, "conv_id", "turn", "role").select("conv_id", "run", "role", "start", "length")


@query("""select event_id, user_id, last_value(case when event_type in ('purchase', 'view') then event_type end ignore nulls) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row) as header from events""")
def carry_forward_header(spark, at):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    e = tables.table(spark, at, "events")
    return e.select("event_id", "user_id", F.last(F.when(F.col("event_type").isin("purchase", "view"), F.col("event_type")), ignorenulls=True).over(w).alias("header"))


@query("""with s as (select user_id, event_id, value, row_number() over (partition by user_id order by event_id) as i, stddev_pop(value) over (partition by user_id order by event_id rows between current row and 4 following) as sd, count(*) over (partition by user_id order by event_id rows between current row and 4 following) as n from events), r as (select *, row_number() over (partition by user_id order by round(sd, 6), i) as k from s where n = 5) select user_id, cast(i as bigint) as start, round(sd, 4) as sd from r where k = 1""")
def calmest_window(spark, at):
    w = Window.partitionBy("user_id").orderBy("event_id")
    ahead = w.rowsBetween(0, 4)
    s = tables.table(spark, at, "events").select("user_id", F.row_number().over(w).cast("long").alias("i"), F.stddev_pop("value").over(ahead).alias("sd"), F.count("*").over(ahead).alias("n")).where("n = 5")
    return s.groupBy("user_id").agg(F.min_by(F.struct("i", "sd"), F.struct(F.round("sd", 6), F.col("i"))).alias("r")).select("user_id", F.col("r.i").alias("start"), F.round("r.sd", 4).alias("sd"))
