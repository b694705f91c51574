"""Queries on keys and tables larger than the test tables'."""

import re

import duckdb
import pytest

from tallyforge.plans import registry
from tallyforge.sources import tables

SF = "/root/testdata/sf0.001"
GROWN = {"customer": ["c_custkey"], "part": ["p_partkey"], "orders": ["o_orderkey", "o_custkey"], "lineitem": ["l_orderkey", "l_partkey", "l_suppkey"]}


@pytest.fixture(scope="module")
def grown(tmp_path_factory):
    """The tables with keys from ten million up, and views of them in DuckDB."""
    at = tmp_path_factory.mktemp("grown")
    c = duckdb.connect()
    for t, keys in GROWN.items():
        moved = ", ".join(f"{k} + 12345670 as {k}" for k in keys)
        c.sql(f"copy (select * replace ({moved}) from '{SF}/{t}.parquet') to '{at}/{t}.parquet' (format parquet)")
        c.sql(f"create view {t} as select * from '{at}/{t}.parquet'")
    return str(at), c


def same(spark, grown, name):
    at, duck = grown
    df = registry.queries()[name](spark, at)
    r = duck.sql(registry.oracle_sql()[name])
    assert sorted(r.columns) == sorted(df.columns)
    assert sorted((tuple(x) for x in df.select(*[f"`{c}`" for c in r.columns]).collect()), key=repr) == sorted(r.fetchall(), key=repr)


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_long_record_numbers(spark, grown):
    same(spark, grown, "vendor_sessions")


def test_region_parsed_once(spark):
    """Each row's specification is parsed once, not for each gap."""
    assert plan(registry.queries()["page_regions"](spark, SF)).count("from_json") == 1


def test_payload_opened_once(spark):
    assert plan(registry.queries()["ranked_payloads"](spark, SF)).count("unhex") == 1


@pytest.mark.parametrize("name", ["page_regions", "ranked_payloads", "mixed_case_words"])
def test_one_file_over_several_tasks(spark, tmp_path, name):
    duckdb.sql(f"copy (select * replace (p_partkey + i * 1000000 as p_partkey) from '{SF}/part.parquet', range(110) r(i)) to '{tmp_path}/part.parquet' (format parquet, row_group_size 100000)")
    n = spark.read.parquet(f"{tmp_path}/part.parquet").count()
    assert n > 20_000
    assert "RepartitionByExpression" in plan(registry.queries()[name](spark, str(tmp_path)))


def test_dealt(spark):
    few = spark.range(20_000)
    assert tables.dealt(few, "id") is few
    many = tables.dealt(spark.range(50_000).coalesce(1), "id")
    assert many.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and many.count() == 50_000


VOTES = ["cvr_unified", "compare_options", "cmp_summary", "precinct_discrepancy", "evaluate_votes", "tabulate_contests", "pivot_options"]


@pytest.mark.parametrize("name", VOTES)
def test_votes_in_many_parts(spark, grown, monkeypatch, name):
    monkeypatch.setattr(tables, "PART_ROWS", 100)
    same(spark, grown, name)


def test_parts_grow_with_rows(spark, monkeypatch):
    """A task's share of the marks stays the same whatever their number."""
    rows = tables.table(spark, SF, "lineitem").count()
    monkeypatch.setattr(tables, "PART_ROWS", 100)
    assert registry.queries()["evaluate_votes"](spark, SF).rdd.getNumPartitions() == -(-rows // 100)
    assert tables.parts(spark.range(300)) == 0


@pytest.mark.parametrize("name", ["compare_options", "cmp_summary", "precinct_discrepancy"])
def test_marks_read_once(spark, name):
    assert plan(registry.queries()[name](spark, SF)).count("Relation [l_orderkey") == 1


def test_options_of_marks_as_joined(spark):
    """Null names equal nothing, as in a join of both sides."""
    from pyspark.sql import functions as F

    from tallyforge.operators import compare

    rows = [(1, "a", "x", 1, 1, True), (1, "a", "x", 0, 0, True), (1, "a", "y", 1, 1, False), (1, None, "x", 1, 0, True), (1, "a", None, 0, None, True), (2, None, None, 1, 1, False), (2, "b", "x", 1, 1, None)]
    df = spark.createDataFrame(rows, "ballot_id long, contest string, option string, num_votes int, vote int, recorded boolean")
    cvr = df.where("recorded").groupBy("ballot_id", "contest", "option").agg(F.max("vote").alias("cvr_votes"))
    joined = compare.compared_options(compare.audit_options(df), cvr)
    own = compare.options_of_marks(df, F.col("recorded"), F.col("vote"), F.sum("num_votes"))
    assert sorted(map(repr, own.drop("more0_").collect())) == sorted(map(repr, joined.collect()))
    assert own.agg(F.sum("more0_")).collect()[0][0] == 5


def test_lookups_in_few_parts(spark, monkeypatch):
    """A scan deals rows to so few parts that it needn't hold them; the marks
    still end in parts of PART_ROWS."""
    rows = tables.table(spark, SF, "lineitem").count()
    monkeypatch.setattr(tables, "PART_ROWS", 20)
    n = -(-rows // 20)
    assert tables.UNHELD_PARTS < n < tables.UNHELD_PARTS * tables.HELD_PARTS
    p = plan(tables.marks(spark, SF))
    dealt = {k: {int(x) for x in re.findall(rf"RepartitionByExpression \[{k}#\d+L?\], (\d+)", p)} for k in ("l_partkey", "l_orderkey")}
    assert dealt == {"l_partkey": {tables.UNHELD_PARTS}, "l_orderkey": {n}}
    assert [tables.lookup_parts(x) for x in (0, 7, 201, 1600, 1601)] == [0, 7, 200, 200, 1601]


@pytest.mark.parametrize("name", ["compare_contests", "compare_options", "contest_set_mismatch", "discrepancy_list", "option_discrepancy"])
def test_comparison_in_many_parts(spark, grown, monkeypatch, name):
    """The marks are read once, nothing is joined to compare, and lookups in
    fewer parts than the ballots give the SQL's rows."""
    monkeypatch.setattr(tables, "PART_ROWS", 100)
    monkeypatch.setattr(tables, "UNHELD_PARTS", 16)
    p = plan(registry.queries()[name](spark, grown[0]))
    assert p.count("Relation [l_orderkey") == 1 and "FullOuter" not in p
    assert re.search(r"RepartitionByExpression \[l_partkey#\d+L?\], 16\b", p)
    same(spark, grown, name)


def shuffles(df) -> list:
    """Keys and number of parts of each shuffle that is planned."""
    p = df._jdf.queryExecution().executedPlan().toString()
    return [(tuple(re.findall(r"(\w+)#", keys)), int(n)) for keys, n in re.findall(r"Exchange hashpartitioning\((.*?), (\d+)\)", p)]


@pytest.mark.parametrize("name", ["compare_options", "contest_set_mismatch", "discrepancy_list", "option_discrepancy"])
def test_comparison_shuffles(spark, monkeypatch, name):
    """From the marks on nothing is shuffled but combined totals; the parts of
    the marks grow with their number, so that a task's share doesn't."""
    monkeypatch.setattr(tables, "PART_ROWS", 500)
    totals = [("contest", "option")] if name == "option_discrepancy" else []
    for at in (SF, "/root/testdata/sf0.01"):
        n = -(-tables.table(spark, at, "lineitem").count() // 500)
        found = shuffles(registry.queries()[name](spark, at))
        assert {x for x in found if "orderkey" in x[0][0]} == {(("l_orderkey",), n), (("o_orderkey",), n)}
        assert [keys for keys, _ in found if not keys[0].endswith("key")] == totals
