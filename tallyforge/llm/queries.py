"""The queries opN_<name>: each applies one operator, with its production
parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, classifier, html_text, mixing, packing, pii, quality_rules, secret_scan, simhash, suffix_dedup
from .common import table


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secrets(table(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.mixed(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), carry=["doc_id"])
    return rows.select("doc_id", "n_tokens", *[f"p_{d}" for d in mixing.DOMAINS], "rate", "copies")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id"])


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicated(table(spark, sf_dir, "documents")).drop("kept")


def op5_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where(F.col("vec_id") % 50 == 0))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_texts(table(spark, sf_dir, "pages"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(packing.pack(table(spark, sf_dir, "documents")))


def queries() -> dict:
    return {f.__name__: f for f in (op1_secrets, op2_mixing, op3_quality_rules, op4_suffix_dedup, op5_classifier, op6_pii, op7_simhash, op8_nearest, op9_html_text, op10_packing)}


def quality_sql() -> str:
    """op3 as SQL: the counts, then the cutoffs by the exact binomial tail."""
    q = quality_rules
    cuts = ", ".join(f"('{f}', {i}, {c!r})" for f, cs in q.CUTOFFS.items() for i, c in enumerate(cs))
    rates = " union all ".join(f"select doc_id, lang, base_failed, '{f}' as f, {f} as v from feats" for f in q.CUTOFFS)
    return f"""with t as (select doc_id, coalesce(lang, '') as lang, coalesce(text, '') as text from documents),
 w as (select *, list_filter(regexp_split_to_array(text, '[ \\t-\\r]+'), lambda x: x <> '') as w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \\t-\\r]')) as lines from t),
 win as (select doc_id, i, array_to_string(w[i:i + 4], ' ') as s from w, unnest(range(1, len(w) - 3)) as u(i)),
 twice as (select * from (select *, count(*) over (partition by doc_id, s) as k from win) where k > 1),
 cover as (select doc_id, sum(least(5, i - coalesce(before, i - 5))) as n from (select *, lag(i) over (partition by doc_id order by i) as before from twice) group by doc_id),
 counted as (select w.doc_id, lang, text, len(w) as n_words, cast(length(array_to_string(w, '')) as bigint) as word_chars, cast(length(text) - length(regexp_replace(text, '[#*$%&|<>]+', '', 'g')) as bigint) as n_symbols,
  cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines, len(lines) as n_lines, cast(coalesce(cover.n, 0) as bigint) as n_repeat_words from w left join cover using (doc_id)),
 feats as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
  case when word_chars > 0 then n_symbols / word_chars else 0 end as symbol_rate, case when word_chars > 0 then (length(text) - length(regexp_replace(text, '[A-Z]+', '', 'g'))) / word_chars else 0 end as upper_rate,
  case when n_lines > 0 then n_dup_lines / n_lines else 0 end as dup_line_rate, case when n_words > 0 then (length(text) - length(regexp_replace(text, '[!?]+', '', 'g'))) / n_words else 0 end as mark_rate from counted),
 rates as ({rates}), cuts(f, i, c) as (values {cuts}),
 good as (select doc_id from labels where quality is not null group by doc_id having min(quality) = 1),
 g as (select feats.doc_id, lang, substr(md5(cast(feats.doc_id as varchar)), 1, 1) < '{q.PICKED}' as pick, {", ".join(q.CUTOFFS)} from feats join good using (doc_id) where not base_failed),
 sizes as (select lang, count(*) filter (not pick) as held from g group by lang), langs as (select count(*) + 1 as m from sizes),
 strata as (select lang, case when held >= ceil(ln({q.DELTA} / m) / ln(1 - {q.EPSILON})) then 'own ' || lang else 'joint' end as stratum from sizes, langs),
 long as (select g.doc_id, stratum, pick, u.f, u.v from g join strata using (lang), unnest([{{'f': 'none', 'v': 0.0}}, {", ".join(f"{{'f': '{f}', 'v': {f}}}" for f in q.CUTOFFS)}]) as t(u)),
 found as (select stratum, f, i from (select stratum, long.f, i, count(*) as n, count(*) filter (v > c) as k from long join cuts on long.f = cuts.f where pick group by all) where k <= {q.EPSILON / (2 * len(q.CUTOFFS))!r} * n),
 strictest as (select stratum, f, max(i) as i from found group by stratum, f),
 settings as (select stratum, f, s, c from (select * from strictest, unnest([{", ".join(map(str, q.NOTCHES))}]) as u(s)) as z join cuts using (f) where cuts.i = z.i - s),
 held as (select doc_id, stratum, s, bool_or(coalesce(v > c, false)) as gone from (select * from long, unnest([{", ".join(map(str, q.NOTCHES))}]) as u(s) where not pick) as l left join settings using (stratum, f, s) group by all),
 tested as (select stratum, s, list_sum(list_transform(range(k + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({q.EPSILON}) + (n - j) * ln(1 - {q.EPSILON})))) <= {q.DELTA} / m as fine
  from (select stratum, s, count(*) as n, count(*) filter (gone) as k from held group by all), langs),
 passed as (select stratum, min(s) as s from (select *, coalesce(max(case when not fine then s end) over (partition by stratum), -1) as stop from tested) where s > stop group by stratum),
 cutoff as (select d.lang, settings.f, settings.c from (select distinct lang from feats) as d left join strata using (lang) join settings on settings.stratum = coalesce(strata.stratum, 'joint') join passed on passed.stratum = settings.stratum and passed.s = settings.s),
 bad as (select distinct doc_id from rates join cutoff using (lang, f) where v > c)
 select feats.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and bad.doc_id is null as kept from feats left join bad on bad.doc_id = feats.doc_id"""


def oracle_sql() -> dict[str, str]:
    """The others are beyond SQL (fitted models, seeded hashes, tokenizers,
    automata) or, byte by byte, far too slow in it (op4)."""
    return {"op3_quality_rules": quality_sql()}
