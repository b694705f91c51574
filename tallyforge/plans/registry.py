"""Queries and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

_QUERIES: dict[str, Callable] = {}
_SQL: dict[str, str] = {}

#: The base tables of sources.tables as SQL, for the queries' equivalents.
MARKS = """marks as (select l_orderkey as ballot_id, p_type as contest, p_brand as "option", l_linenumber as o1, l_partkey as o2, l_suppkey as o3,
 cast(l_quantity * 6 as integer) as pmv, c_nationkey as precinct, c_mktsegment as party, o_orderpriority as style_num, o_orderstatus as sheet,
 1 + length(p_type) % 2 as vote_for, l_returnflag as flag
 from lineitem join part on l_partkey = p_partkey join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey)"""
GAPS = """idx as (select ballot_id, pmv, row_number() over (partition by ballot_id order by pmv, o1, o2, o3) - 1 as i,
  lead(pmv) over (partition by ballot_id order by pmv, o1, o2, o3) - pmv as gap from marks),
 gaps as (select *, max(gap) over (partition by ballot_id) as most, avg(gap) over (partition by ballot_id order by i rows between unbounded preceding and 2 preceding) as before, pmv + gap / 2.0 as t from idx),
 firsts as (select ballot_id, max(pmv) - min(pmv) as rng, arg_min(t, i) filter (where i >= 2 and gap > most * 0.5) as a, arg_min(t, i) filter (where i >= 2 and gap > before + 50) as b from gaps group by ballot_id),
 thresholds as (select ballot_id,
  cast(case when rng < 80 or (a is null and b is null) then 200 when a is null or b is null then coalesce(a, b) - 1 else least(a, b) end as double) as marginal,
  cast(case when rng < 80 or (a is null and b is null) then 245 else greatest(coalesce(a, b), coalesce(b, a)) end as double) as definite from firsts)"""
CLASSES = """classes as (select marks.*, case when pmv < marginal then 'NoMark' when pmv < definite then 'MarginalMark' else 'DefiniteMark' end as has_indication,
  case when pmv >= definite then 1 else 0 end as num_marks from marks join thresholds using (ballot_id))"""
VOTES = """ranked as (select *, sum(num_marks) over (partition by ballot_id, contest) as d, count(*) filter (where has_indication = 'MarginalMark') over (partition by ballot_id, contest) as m,
  row_number() over (partition by ballot_id, contest, has_indication order by o1, o2, o3) as k from classes),
 votes as (select *, cast(d > vote_for as integer) as overvotes, cast(case when d > vote_for then 0 else greatest(vote_for - d - m, 0) end as integer) as undervotes,
  cast(case when d > vote_for then 0 when has_indication = 'DefiniteMark' then 1 when has_indication = 'MarginalMark' and k <= vote_for - d then 1 else 0 end as integer) as num_votes from ranked)"""
HEADS = """heads as (select ballot_id, contest, max(overvotes) as overvotes, max(undervotes) as undervotes, sum(num_votes) as votes, sum(num_marks) as marks, max(precinct) as precinct, max(style_num) as style_num from votes group by all)"""
COMPARED = """audit as (select ballot_id, contest, "option", max(num_votes) as audit_votes from votes group by all),
 cvr as (select ballot_id, contest, "option", max(cast(pmv >= 228 as integer)) as cvr_votes from marks where flag <> 'N' group by all),
 options as (select ballot_id, contest, "option", audit_votes, cvr_votes, audit_votes - cvr_votes as diff from audit full join cvr using (ballot_id, contest, "option")),
 contests as (select *, cast(differing = 0 and audit_only = 0 and cvr_only = 0 as integer) as agreed from (select ballot_id, contest, count(*) as options, count(*) filter (where diff <> 0) as differing,
  count(*) filter (where cvr_votes is null) as audit_only, count(*) filter (where audit_votes is null) as cvr_only from options group by all)),
 ballots as (select ballot_id, count(*) as contests, cast(sum(1 - agreed) as bigint) as disagreed, min(agreed) as agreed from contests group by all)"""
BIF = """bif as (select o_orderkey as ballot_id, c_nationkey as precinct, c_mktsegment as party, o_orderpriority as style_num, o_orderstatus as sheet, o_totalprice > 250000 as is_bmd, o_orderkey % 97 = 0 as style_roi_corrupted from orders join customer on o_custkey = c_custkey)"""
VOTED = f"with {MARKS}, {GAPS}, {CLASSES}, {VOTES}"


def query(sql: str | None = None):
    """Registers a function (spark, sf_dir) -> DataFrame with its SQL."""

    def add(f: Callable) -> Callable:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def load() -> None:
    from . import ballots, codes, layout, listing, matching, names, places, records, rules  # noqa: F401


def queries() -> dict[str, Callable]:
    load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    load()
    return dict(_SQL)
