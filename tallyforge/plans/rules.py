"""Scalar rules, lookups and validations as queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import coords, payload, text
from ..operators import images, styles, validate
from ..sources import tables
from .registry import BIF, query


def _part(spark, at):
    return tables.table(spark, at, "part")


@query(
    """select p_partkey, regexp_replace(case when length(w) <= 4 then regexp_replace(regexp_replace(w, '[WN][ODU0GCAo]', 'NO', 'g'), '[YV][EFeo][sS]', 'YES', 'g') else w end, '[*\\-_,~{}+<>=|;0]', '', 'g') as line from (select p_partkey, """
    + "".join("regexp_replace(" for _ in text.SUMMARY_WORDS)
    + "trim(regexp_replace(upper(p_brand || ' judce ' || p_type || ' wayor ' || p_name || ' +'), '\\s*[{+>]+$', ''))"
    + "".join(f", '{p}', '{to}', 'g')" for p, to in text.SUMMARY_WORDS)
    + " as w from part)"
)
def summary_lines(spark, at):
    raw = F.concat("p_brand", F.lit(" judce "), "p_type", F.lit(" wayor "), "p_name", F.lit(" +"))
    return _part(spark, at).select("p_partkey", text.summary_line(raw).alias("line"))


_MIXED = text.SUMMARY_WORDS + [(p.replace("t[il[oaqp]", "t[il\\[oaqp]"), to) for p, to in text.MIXED_WORDS]


@query("select p_partkey, " + "regexp_replace(" * len(_MIXED) + "trim(p_name || ' [x Govemor of the Boord, Artic1e !V Amendmant Schoo1 Genera1 Loca1 Distnct ' || p_type || ' wote for Judga Jushce ')" + "".join(f", '{p}', '{to}', 'g')" for p, to in _MIXED) + " as line, replace(replace(p_name || 'Nufiez (tm)', 'Nufiez', 'Nuniez'), '(tm)', '\"') as name from part")
def mixed_case_words(spark, at):
    raw = F.concat("p_name", F.lit(" [x Govemor of the Boord, Artic1e !V Amendmant Schoo1 Genera1 Loca1 Distnct "), "p_type", F.lit(" wote for Judga Jushce "))
    rows = tables.dealt(_part(spark, at).select("p_partkey", "p_name", "p_type"), "p_partkey")
    return rows.select("p_partkey", text.mixed_words(raw).alias("line"), text.mixed_words(F.concat("p_name", F.lit("Nufiez (tm)")), names=True).alias("name"))


@query(f"select doc_id, md5(replace(replace(replace(replace(replace(replace(translate(coalesce(text, ''), '{''.join(text._BARE).replace(chr(39), chr(39) * 2)}', '{''.join(text._BARE.values()).replace(chr(39), chr(39) * 2)}'), 'ß', 'ss'), 'æ', 'ae'), 'Æ', 'AE'), 'œ', 'oe'), 'Œ', 'OE'), '…', '...')) as plain from documents")
def plain_text(spark, at):
    return tables.table(spark, at, "documents").select("doc_id", F.md5(text.plain(F.coalesce("text", F.lit("")))).alias("plain"))


@query("select p_partkey, array_to_string(list_transform(range(1, len(s)), lambda i: length(array_to_string(s[1:i], 'e'))), ',') as places from (select p_partkey, string_split(p_name, 'e') as s from part)")
def substring_positions(spark, at):
    return _part(spark, at).select("p_partkey", F.array_join(F.transform(text.positions(F.col("p_name"), "e"), lambda x: x.cast("string")), ",").alias("places"))


@query("select p_partkey, case when n > 702 then chr(cast(65 + ((n - 703) // 676) % 26 as integer)) else '' end || case when n > 26 then chr(cast(65 + ((n - 27) // 26) % 26 as integer)) else '' end || chr(cast(65 + (n - 1) % 26 as integer)) || '1' as title from (select p_partkey, 1 + p_partkey % 18000 as n from part)")
def column_titles(spark, at):
    return _part(spark, at).select("p_partkey", text.column_title(1 + F.col("p_partkey") % 18000).alias("title"))


@query("select p_partkey, case when p_size % 12 < 10 then cast(p_size % 12 as integer) end as number from part")
def number_words(spark, at):
    words = F.lit([*text.UNITS, "ten", "many"])
    return _part(spark, at).select("p_partkey", text.number_word(F.concat(F.lit("Vote for: "), F.initcap(F.get(words, F.col("p_size") % 12)), F.lit(", please"))).alias("number"))


@query("select p_partkey, lpad(cast(p_size as varchar), 2, '0') || lpad(cast(p_partkey % 90 as varchar), 2, '0') || cast(1 + p_partkey % 2 as varchar) || '1' as coord, not (p_size % 10 = 0 and p_partkey % 90 < 10 or p_size = 0 or p_partkey % 90 = 0) as fine from part")
def coordinate_texts(spark, at):
    p = F.col("p_partkey")
    made, fine = coords.coordinate_text(F.col("p_size"), p % 90, p % 2, F.lit(0))
    # A lost zero and quotes, as such numbers come back from a spreadsheet.
    return _part(spark, at).select("p_partkey", text.coordinate(F.concat(F.lit("'"), F.regexp_replace(made, "^0", ""), F.lit("'"))).alias("coord"), fine.alias("fine"))


@query("""with r as (select p_partkey, p_size * 20 as x, cast(p_partkey % 100 as integer) as y, 30 as w, 12 as h, (['tl', 'tr', 'bl', 'br'])[1 + p_partkey % 4] as ref from part)
 select p_partkey, cast(x + case when ref in ('tr', 'br') then w else 0 end - 5 as integer) as tx, cast(y + case when ref in ('bl', 'br') then h else 0 end + 3 as integer) as ty from r""")
def target_offsets(spark, at):
    p = F.col("p_partkey")
    roi = F.struct((F.col("p_size") * 20).alias("x"), (p % 100).cast("int").alias("y"), F.lit(30).alias("w"), F.lit(12).alias("h"), F.lit(0).alias("blk_x"), F.lit(0).alias("blk_w"))
    ref = F.get(F.lit(["tl", "tr", "bl", "br"]), (p % 4).cast("int"))
    t = coords.target(roi, ref, F.lit(-5), F.lit(3))
    return _part(spark, at).select("p_partkey", t["x"].cast("int").alias("tx"), t["y"].cast("int").alias("ty"))


GAPS = list(range(20, 2800, 40))


@query(f"""with g as (select {GAPS} as g), s as (select p_partkey, p_size as y, cast(p_partkey % 30 as integer) as h, p_partkey % 5 = 0 as px from part), v as (select s.*, g, case when px then y * 50 + 71 else y end as ys from s, g),
 t as (select *, case when px then g[1 + cast(list_position(list_transform(g, lambda x: abs(x - ys)), list_min(list_transform(g, lambda x: abs(x - ys)))) as integer) - 1] else g[1 + ys] end as top from v),
 b as (select *, case when px then top + least(h * 40, 2800 - top) else null end as bs from t)
 select p_partkey, cast(top as integer) as y, cast(case when px then g[list_position(list_transform(g, lambda x: abs(x - bs)), list_min(list_transform(g, lambda x: abs(x - bs))))] - top else g[1 + ys + least(h, {len(GAPS)} - ys - 1)] - top end as integer) as h from b""")
def page_regions(spark, at):
    """Regions given by gap numbers, or by pixels that snap to gaps."""
    p, px = F.col("p_partkey"), F.col("p_partkey") % 5 == 0
    y = F.when(px, F.col("p_size") * 50 + 71).otherwise(F.col("p_size"))
    h = F.when(px, p % 30 * 40).otherwise(p % 30)
    r = coords.region(F.format_string("{'y': %d, 'h': %d, 'x': 7}", y, h), F.lit(GAPS))
    rows = tables.dealt(_part(spark, at).select("p_partkey", "p_size"), "p_partkey")
    return rows.select("p_partkey", r.alias("r")).select("p_partkey", "r.y", "r.h")


@query("select l_orderkey, l_linenumber, count(*) as n from lineitem group by all having count(*) > 1")
def unexpected_repeats(spark, at):
    return validate.several(tables.table(spark, at, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("select l_partkey, count(*) as n from lineitem where bit_count(l_partkey) % 2 = 0 group by l_partkey")
def even_parity_codes(spark, at):
    return validate.even_parity(tables.table(spark, at, "lineitem"), "l_partkey")


@query("select p_partkey, p_size from part where p_size >= 10 and p_size < 25")
def style_range(spark, at):
    return styles.excluded_types(_part(spark, at).select("p_partkey", "p_size"), 10, 25, "p_size")


@query("select l_orderkey, bool_and(l_linestatus = 'F') as all_f, cast(count(*) filter (where l_linestatus = 'F') as integer) as n_f from lineitem group by l_orderkey")
def all_of_list(spark, at):
    s = tables.table(spark, at, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_linestatus").alias("s"))  # an order's lines are few
    return s.select("l_orderkey", F.forall("s", lambda x: x == "F").alias("all_f"), F.size(F.filter("s", lambda x: x == "F")).alias("n_f"))


@query("""with r as (select l_orderkey, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as i, row_number() over (partition by l_orderkey order by l_quantity, l_linenumber, l_partkey, l_suppkey) as j from lineitem)
 select l_orderkey, string_agg(cast(i - 1 as varchar), ',' order by j) as inverse from r group by l_orderkey""")
def inverse_permutation(spark, at):
    w = Window.partitionBy("l_orderkey")
    o = ["l_linenumber", "l_partkey", "l_suppkey"]
    r = tables.table(spark, at, "lineitem").select("l_orderkey", F.row_number().over(w.orderBy(*o)).alias("i"), F.row_number().over(w.orderBy("l_quantity", *o)).alias("j"))
    p = r.groupBy("l_orderkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "j"))), lambda x: x["j"]).alias("p"))
    inverse = F.transform(F.sequence(F.lit(1), F.size("p")), lambda k: (F.array_position("p", k) - 1).cast("string"))
    return p.select("l_orderkey", F.array_join(inverse, ",").alias("inverse"))


@query("select c_custkey, r_name from customer left join nation on c_nationkey = n_nationkey left join region on n_regionkey = r_regionkey")
def chained_lookup(spark, at):
    n = tables.table(spark, at, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")
    r = tables.table(spark, at, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    return tables.table(spark, at, "customer").join(n, "c_nationkey", "left").join(r, "n_regionkey", "left").select("c_custkey", "r_name")


@query(f"with {BIF}, f as (select party, precinct, arg_min(style_num, ballot_id) as style_num, count(*) > 1 as several from bif group by all) select cast(precinct as varchar) as precinct, party, style_num, several from f")
def first_match_lookup(spark, at):
    rows = validate.first_match(tables.bif(spark, at).select("party", "precinct", "style_num", "ballot_id"), ["party", "precinct"], ["ballot_id"])
    return rows.select("precinct", "party", "style_num", "several")


@query(f"with {BIF}, done as (select style_num, bool_or(style_roi_corrupted) as failed from bif where style_num <> '5-LOW' group by all) select distinct bif.style_num, coalesce(failed, true) as style_failed from bif left join done using (style_num)")
def mapping_failed_styles(spark, at):
    b = tables.bif(spark, at)
    done = b.where("style_num <> '5-LOW'").groupBy("style_num").agg(F.bool_or("style_roi_corrupted").alias("style_failed_to_map"))
    return styles.mapping_failed(b.select("style_num").distinct(), done)


@query(f"with {BIF} select style_num, sheet, count(*) as n from bif where sheet = 'F' group by all")
def styles_on_sheet(spark, at):
    b = tables.bif(spark, at)
    sheets = b.select("sheet").distinct().select(F.col("sheet").alias("contest"), F.when(F.col("sheet") == "F", 0).otherwise(1).alias("sheet0"))
    rows = styles.on_sheet(b.select("style_num", F.col("sheet").alias("contest")), sheets, 0)
    return rows.groupBy("style_num", F.col("contest").alias("sheet")).agg(F.count("*").alias("n"))


@query("""with c as (select p_partkey, lpad(bin(p_partkey * 37 + 5), 20, '0') as code from part)
 select p_partkey, cast(list_sum(list_transform(range(1, 17), lambda i: case when reverse(code)[20 - i + 1] = '1' then cast(power(2, i - 1) as bigint) else 0 end)) as integer) as card_code, cast(list_sum(list_transform(range(1, 5), lambda i: case when code[20 - i + 1] = '1' then cast(power(2, i - 1) as bigint) else 0 end)) as integer) as sheet_page from c""")
def bar_codes(spark, at):
    code = F.lpad(F.bin(F.col("p_partkey") * 37 + 5), 20, "0")
    card, page = payload.bar_code(code)
    return _part(spark, at).select("p_partkey", card.alias("card_code"), page.alias("sheet_page"))


@query("select p_partkey, p_partkey as ballot, cast(p_size * 3 as bigint) as style, cast(p_size as bigint) as precinct, cast(p_partkey % 7 as bigint) as n from part")
def header_codes(spark, at):
    code = F.format_string("%010d%010d%03d%03d", "p_partkey", F.col("p_size") * 3, "p_size", F.col("p_partkey") % 7)
    h = payload.header_code(code)
    return _part(spark, at).select("p_partkey", h["ballot"].alias("ballot"), h["style"].alias("style"), h["precinct"].alias("precinct"), h["count"].alias("n"))


@query("select conv_id as page, role as block, string_agg(text, ' ' order by turn) as text, cast(min(turn) as integer) as x, cast(max(turn + length(text)) - min(turn) as integer) as w, count(*) as n from conversations where text is not null group by all")
def words_to_lines(spark, at):
    c = tables.table(spark, at, "conversations").where("text is not null")
    words = c.select(F.col("conv_id").alias("page"), F.col("role").alias("block"), F.lit(0).alias("line"), F.col("turn").alias("word"), F.col("turn").cast("int").alias("x"), F.lit(0).alias("y"), F.length("text").alias("w"), F.lit(9).alias("h"), "text")
    return images.lines_of_words(words).select("page", "block", "text", "x", F.col("w").cast("int").alias("w"), "n")


@query("""with v as (select label, unnest(embedding) as e, unnest(range(len(embedding))) as pos from embeddings), m as (select label, pos, avg(cast(e as double)) as mean from v group by all)
 select label, cast(pos as integer) as pos, round((mean - min(mean) over w) / (max(mean) over w - min(mean) over w) * 255, 2) + 0.0 as level from m window w as (partition by label)""")
def template_levels(spark, at):
    """A template's mean values stretched to 0..255."""
    v = tables.table(spark, at, "embeddings").select("label", F.posexplode("embedding").alias("pos", "e"))
    m = v.groupBy("label", "pos").agg(F.avg(F.col("e").cast("double")).alias("mean"))
    w = Window.partitionBy("label")
    low, high = F.min("mean").over(w), F.max("mean").over(w)
    return m.select("label", "pos", (F.round((F.col("mean") - low) / (high - low) * 255, 2) + 0.0).alias("level"))


@query("""with given(name, value) as (values ('chunk', '200'), ('vendor', 'C'), ('odd', '1')), spec(name, fmt, required, choices) as (values ('chunk', 'int', true, null), ('vendor', null, true, ['A', 'B']), ('source', null, true, null))
 select coalesce(s.name, g.name) as name, case when s.name is null then 'unknown' when g.name is null and required then 'missing' when choices is not null and not list_contains(choices, value) then 'not among the choices' when fmt = 'int' and not regexp_full_match(value, '[+-]?\\d[\\d,]*') then 'format' end as problem
 from spec s full join given g using (name) where problem is not null""")
def setting_errors(spark, at):
    values = spark.createDataFrame([("chunk", "200"), ("vendor", "C"), ("odd", "1")], "name string, value string")
    spec = spark.createDataFrame([("chunk", "int", True, None), ("vendor", None, True, ["A", "B"]), ("source", None, True, None)], "name string, format string, required boolean, choices array<string>")
    return validate.setting_errors(values, spec)


@query("select o_custkey as k, string_agg(cast(o_orderkey as varchar), ',' order by o_orderkey) as keys from orders group by o_custkey")
def group_by_attribute(spark, at):
    o = tables.table(spark, at, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list("o_orderkey")).alias("k"))
    return o.select(F.col("o_custkey").alias("k"), F.array_join(F.transform("k", lambda x: x.cast("string")), ",").alias("keys"))
