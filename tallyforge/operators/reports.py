"""Reports: small tables of results as HTML, style dictionaries as JSON."""

from __future__ import annotations

import html
import itertools
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that a page shows; a report over more goes on on another page.
ROWS = 10_000


def summary(compared: DataFrame, flags: DataFrame) -> DataFrame:
    """One row: ballots processed, styles, matched, differing, blank and
    overvoted. compared: ballot_id, style_num, agreed; flags: ballot_id, blank,
    overvoted."""
    return compared.join(flags, "ballot_id", "left").agg(
        F.count("*").alias("processed"), F.countDistinct("style_num").alias("styles"), F.count_if(F.col("agreed") == 1).alias("matched"), F.count_if(F.col("agreed") == 0).alias("differing"),
        F.count_if(F.col("blank")).alias("blank"), F.count_if(F.col("overvoted")).alias("overvoted"),
    )


def precincts(contests: DataFrame, precinct_of: DataFrame, at_least: float = 0.0) -> DataFrame:
    """Per precinct: ballots, those that differ, their share of the precinct's
    and of all ballots in percent; shares from the threshold on, largest first."""
    per = contests.groupBy("ballot_id").agg(F.min("agreed").alias("agreed")).join(precinct_of, "ballot_id")
    rows = per.groupBy("precinct").agg(F.count("*").alias("ballots"), F.count_if(F.col("agreed") == 0).alias("differing"))
    total = rows.agg(F.sum("ballots").alias("all"))
    df = rows.join(F.broadcast(total))  # one row
    df = df.withColumn("share", F.round(F.try_divide(F.col("differing") * 100.0, F.col("ballots")), 2)).withColumn("share_of_all", F.round(F.try_divide(F.col("differing") * 100.0, F.col("all")), 2))
    return df.where(F.col("share") >= at_least).drop("all").orderBy(F.desc("share"), F.desc("ballots"), "precinct")


def differences(options: DataFrame) -> DataFrame:
    """ballot_id, contest, vote_difference (JSON of option to difference) of
    contests that differ."""
    d = options.where("diff <> 0").groupBy("ballot_id", "contest").agg(F.sort_array(F.collect_list(F.struct("option", "diff"))).alias("d"))
    return d.select("ballot_id", "contest", F.to_json(F.map_from_entries("d")).alias("vote_difference"))


def option_differences(rows: DataFrame) -> DataFrame:
    """Per contest and option: contests with a difference there, and how many
    the audit counts one more, from the JSON of differences()."""
    m = rows.select("contest", F.explode(F.from_json("vote_difference", "map<string,int>")).alias("option", "diff"))
    return m.groupBy("contest", "option").agg(F.count_if(F.col("diff") != 0).alias("disagreed"), F.count_if(F.col("diff") > 0).alias("audit_more"))


def style_json(styles: DataFrame, options: DataFrame) -> DataFrame:
    """style_num, json: contests of a style with their options. styles:
    style_num, contests; options: contest, options."""
    rows = styles.select("style_num", F.posexplode("contests").alias("i", "contest")).join(options, "contest", "left")
    per = rows.groupBy("style_num").agg(F.sort_array(F.collect_list(F.struct("i", "contest", "options"))).alias("c"))
    return per.select("style_num", F.to_json(F.struct("style_num", F.transform("c", lambda x: F.struct(x["contest"].alias("contest"), x["options"].alias("options"))).alias("contests"))).alias("json"))


def pages(df: DataFrame, title: str, rows: int = ROWS) -> Iterator[str]:
    """A whole table as HTML pages of so many rows each. Rows come to the
    driver partition by partition and are not held together."""
    some, at, more = df.toLocalIterator(), 0, True
    while more or not at:
        own = list(itertools.islice(some, rows))
        more, at = len(own) == rows, at + 1
        if own or at == 1:
            yield _html(df.columns, own, title if at == 1 else f"{title} ({at})", "")


def page(df: DataFrame, title: str, rows: int = ROWS) -> str:
    """The start of a table as one HTML page; of more rows than a page shows it
    says so. pages() has them all."""
    got = df.limit(rows + 1).collect()
    return _html(df.columns, got[:rows], title, f"<p>More than {rows} rows; the first are shown.</p>" if len(got) > rows else "")


def _html(columns: list[str], rows: list, title: str, more: str) -> str:
    cell = lambda tag, v: f"<{tag}>{html.escape('' if v is None else str(v))}</{tag}>"
    head = "".join(cell("th", c) for c in columns)
    body = "".join("<tr>" + "".join(cell("td", v) for v in r) + "</tr>" for r in rows)
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1>{more}<table><tr>{head}</tr>{body}</table></body></html>"
