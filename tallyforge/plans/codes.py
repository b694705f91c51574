"""Codes, paths and text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bits, payload, text
from ..sources import tables
from .registry import query


def _values(rows) -> str:
    return ", ".join(str(r) for r in rows)


@query(
    f"""with m(mask, value, a) as (values {_values(bits.mask_rows())}), c as (select p_partkey, ([33, 49, 41, 37, 35, 16])[1 + p_partkey % 6] as party, (p_partkey * 7919) % 65536 as core, p_partkey % 3 as tail from part),
 k as (select *, (party::bigint << 48) | (core::bigint << 20) | tail as code from c), s as (select k.*, (select coalesce(sum(a), 0) from m where (core & mask) = value) as style from k)
 select p_partkey, code, cast(case when bit_count(code) % 2 = 1 and style <= 211 then style + case party when 33 then 0 when 49 then 1000 when 41 then 2000 when 37 then 3000 when 35 then 4000 end end as integer) as style from s"""
)
def card_code_decode(spark, at):
    p = F.col("p_partkey")
    party = F.element_at(F.array(*[F.lit(x) for x in (33, 49, 41, 37, 35, 16)]), (1 + p % 6).cast("int"))
    code = F.shiftleft(party.cast("long"), 48).bitwiseOR(F.shiftleft((p * 7919) % 65536, 20)).bitwiseOR(p % 3)
    return tables.table(spark, at, "part").select("p_partkey", code.alias("code")).withColumn("style", bits.card_style(F.col("code")))


@query(
    """with c as (select p_partkey, p_size as bt, p_partkey % 10 as variety, ((p_partkey % 57) + 57) % 57 as core from part), s as (select *, (((core - 1) % 6) + 6) % 6 as sl from c)
 select p_partkey, cast(case when core > 54 then core - 54 else cast(floor(sl / 2.0) as bigint) + 1 end as varchar) || cast(case when core > 54 then 0 else cast(floor((core - 1) / 6.0) as bigint) + 1 end as varchar) || cast(case when core > 54 then 2 else sl % 2 + 1 end as varchar) || cast(variety as varchar) || lpad(cast(bt as varchar), 3, '0') as style,
 cast(case when core > 54 then 1 else sl % 2 end as integer) as sheet0 from s"""
)
def effective_style_num(spark, at):
    style, sheet = bits.effective_style(F.col("p_partkey"), F.col("p_size"), F.col("p_partkey") % 10)
    return tables.table(spark, at, "part").select("p_partkey", style.alias("style"), sheet.alias("sheet0"))


@query("select p_partkey, cast(c >> 16 as integer) as style, c & 255 = 1 and (c >> 8) & 255 in (1, 2) as clean from (select p_partkey, (p_partkey << 16) | ((p_partkey % 4) << 8) | case when p_size = 7 then 2 else 1 end as c from part)")
def logical_style(spark, at):
    p = F.col("p_partkey")
    code = F.shiftleft(p, 16).bitwiseOR(F.shiftleft(p % 4, 8)).bitwiseOR(F.when(F.col("p_size") == 7, 2).otherwise(1))
    style, clean = payload.logical_style(code)
    return tables.table(spark, at, "part").select("p_partkey", style.alias("style"), clean.alias("clean"))


@query("select page_id, case when len(p) - 1 > 3 then p[4] end as folder3, case when len(p) - 1 > 2 then p[3] end as folder2, regexp_extract(url, '^([a-z]+)://', 1) as scheme, regexp_extract(url, '://([^/?#]+)', 1) as host from (select *, regexp_split_to_array(url, '[/\\\\]') as p from pages)")
def path_attributes(spark, at):
    u = F.col("url")
    return tables.table(spark, at, "pages").select("page_id", text.folder(u, 3).alias("folder3"), text.folder(u, 2).alias("folder2"), F.regexp_extract(u, "^([a-z]+)://", 1).alias("scheme"), F.regexp_extract(u, "://([^/?#]+)", 1).alias("host"))


@query("select o_orderkey, regexp_replace(regexp_replace(regexp_replace(regexp_extract(p, '([^/\\\\]*)$', 1), '\\.[^.]*$', ''), '[^0-9_]', '', 'g'), '^(\\d{5}_\\d{5}_\\d{5,})_\\d+$', '\\1') as ballot_id from (select o_orderkey, o_orderstatus || '\\' || o_orderpriority || '/' || lpad(cast(o_orderkey % 100000 as varchar), 5, '0') || '_' || lpad(cast(o_custkey % 1000 as varchar), 5, '0') || '_' || lpad(cast(o_orderkey as varchar), 6, '0') || case when o_orderkey % 2 = 0 then '_1' else 'F' end || '.pbm' as p from orders)")
def path_ballot_id(spark, at):
    o = tables.table(spark, at, "orders")
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
    p = F.concat("o_orderstatus", F.lit("\\"), "o_orderpriority", F.lit("/"), pad(F.col("o_orderkey") % 100000, 5), F.lit("_"), pad(F.col("o_custkey") % 1000, 5), F.lit("_"), pad(F.col("o_orderkey"), 6), F.when(F.col("o_orderkey") % 2 == 0, "_1").otherwise("F"), F.lit(".pbm"))
    return o.select("o_orderkey", text.ballot_id(p).alias("ballot_id"))


PATTERNS = ["https?://m\\..*", ".*#top", ".*/(en|fr)/\\d+"]


@query("select page_id, " + " or ".join(f"regexp_full_match(url, '{p}')" for p in PATTERNS) + " as matches from pages")
def regex_fullmatch_list(spark, at):
    return tables.table(spark, at, "pages").select("page_id", text.full_match_any(F.col("url"), PATTERNS).alias("matches"))


@query("""select doc_id, md5(trim(regexp_replace(regexp_replace(translate(text, 'é‘’“”', 'e''''""'), '[^a-zA-Z0-9\\s."()]', '', 'g'), '^.?[O0]\\s?', ''), ' ')) as clean from documents""")
def ocr_sanitize(spark, at):
    return tables.table(spark, at, "documents").select("doc_id", F.md5(text.sanitized(F.col("text"))).alias("clean"))


RULES = [("rn", "m"), ("\\bVOTE FDR\\b", "VOTE FOR"), ("[|]", "I"), ("0(?=[A-Z])", "O")]


@query("select doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, 'rn', 'm', 'g'), '[|]', 'I', 'g'), '([a-z])0([a-z])', '\\1o\\2', 'g')) as fixed from documents")
def word_corrections(spark, at):
    fixed = text.folded(F.col("text"), [("rn", "m"), ("[|]", "I"), ("([a-z])0([a-z])", "$1o$2")])
    return tables.table(spark, at, "documents").select("doc_id", F.md5(fixed).alias("fixed"))


@query(f"""with n as (select p_partkey, case when regexp_matches(raw, '(?i){text.WRITE_INS}') then 'write-in:' else raw end as raw from (select p_partkey, case p_partkey % 5 when 0 then '(c) ' || p_name when 1 then p_name || ' DFM' when 2 then 'Wnte-in ' || p_size when 3 then 'Vas' else p_name end as raw from part))
 select p_partkey, regexp_replace(regexp_replace(regexp_replace(raw, '^\\s*(@|\\([cr]\\))*\\s*', ''), '\\s*({text.PARTY_END})$', ''), '^[YV][ea]s$', 'Yes') as name from n""")
def name_clean(spark, at):
    p = tables.table(spark, at, "part")
    k = F.col("p_partkey") % 5
    raw = F.when(k == 0, F.concat(F.lit("(c) "), "p_name")).when(k == 1, F.concat("p_name", F.lit(" DFM"))).when(k == 2, F.concat(F.lit("Wnte-in "), F.col("p_size").cast("string"))).when(k == 3, "Vas").otherwise(F.col("p_name"))
    return p.select("p_partkey", text.clean_name(raw).alias("name"))


@query("select doc_id, cast(case when text is null or text = '' then 0 else length(text) - length(replace(text, chr(10), '')) + 1 end as integer) as lines from documents")
def line_count(spark, at):
    return tables.table(spark, at, "documents").select("doc_id", text.line_count(F.col("text")).alias("lines"))


@query("select doc_id, md5(trim(regexp_replace(text, '\\s+', ' ', 'g'), ' ')) as line from documents")
def combine_lines(spark, at):
    return tables.table(spark, at, "documents").select("doc_id", F.md5(text.one_line(F.col("text"))).alias("line"))


@query("select page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) as title, len(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) as links, array_to_string(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1), '|') as targets from pages")
def scrape_pages(spark, at):
    links = F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), 1)
    return tables.table(spark, at, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.size(links).cast("long").alias("links"), F.array_join(links, "|").alias("targets"))


@query("select p_partkey, cast(regexp_extract(h, 'vote_for\\s*=\\s*(\\d+)', 1) as integer) as vote_for from (select p_partkey, '#contest vote_for=' || (1 + p_size % 4) as h from part)")
def vote_for_header(spark, at):
    h = F.concat(F.lit("#contest vote_for="), (1 + F.col("p_size") % 4).cast("string"))
    return tables.table(spark, at, "part").select("p_partkey", F.regexp_extract(h, r"vote_for\s*=\s*(\d+)", 1).try_cast("int").alias("vote_for"))


@query("select event_id, lpad(cast(s // 3600 as varchar), 2, '0') || ':' || lpad(cast(s % 3600 // 60 as varchar), 2, '0') || ':' || lpad(cast(s % 60 as varchar), 2, '0') as t from (select event_id, event_id * 37 % 86400 as s from events)")
def show_time(spark, at):
    s = F.col("event_id") * 37 % 86400
    return tables.table(spark, at, "events").select("event_id", F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60).alias("t"))


@query("select p_partkey, i as ord, trim(o) as \"option\" from (select p_partkey, unnest(string_split(p_name, ' ')) as o, unnest(range(len(string_split(p_name, ' ')))) as i from part)")
def options_from_cell(spark, at):
    return tables.table(spark, at, "part").select("p_partkey", F.posexplode(F.split("p_name", " ")).alias("ord", "o")).select("p_partkey", F.col("ord").cast("long").alias("ord"), F.trim("o").alias("option"))
