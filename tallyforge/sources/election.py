"""Election files: user-edited CSV, contest metadata, cast-vote records."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def stripped_lines(text: str) -> str:
    """The text without comment lines (# or "#), empty lines and lines of
    commas only."""
    keep = [x for x in text.splitlines() if x.strip().strip(",").strip() and not x.startswith(("#", '"#'))]
    return "\n".join(keep) + "\n"


def user_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A user-edited CSV (comments, quoted cells over several lines) with the
    named columns as strings, blank cells as null, and row_ord."""
    schema = ", ".join(["row_ord long", *(f"`{c}` string" for c in columns)])

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for text in pdf["value"]:
                rows = list(csv.DictReader(io.StringIO(stripped_lines(text))))
                yield pd.DataFrame([{"row_ord": i, **{c: (r.get(c) or "").strip() or None for c in columns}} for i, r in enumerate(rows)], columns=["row_ord", *columns])

    return spark.read.text(path, wholetext=True).mapInPandas(parse, schema)


EIF = ["official_contest_name", "ballot_contest_name", "bmd_contest_name", "vote_for", "writein_num", "official_options", "description", "descr_num", "sheet", "party"]


def contests(eif: DataFrame) -> DataFrame:
    """Contest metadata from an EIF: names on one line, options as arrays,
    write-in slots, counts of lines. A repeated contest keeps its first row;
    vote_for defaults to 1, write-ins to 1 or, with a description, 0."""
    num = lambda c: F.regexp_replace(c, r"[^\d+-]", "").try_cast("int")
    lines = lambda c: F.when(F.col(c).isNull(), 0).otherwise(F.size(F.split(c, "\n")))
    first = F.row_number().over(Window.partitionBy("official_contest_name").orderBy("row_ord"))
    df = eif.where("official_contest_name is not null").withColumn("i_", first).where("i_ = 1")
    options = F.filter(F.transform(F.split(F.coalesce("official_options", F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    options = F.when(F.lower(F.col("official_options")).startswith("no candidate"), F.array().cast("array<string>")).otherwise(options)
    writeins = F.coalesce(num(F.col("writein_num")), F.when(F.col("description").isNotNull(), 0).otherwise(1))
    df = df.select(
        F.trim(F.regexp_replace("official_contest_name", r"\s+", " ")).alias("contest"), F.col("row_ord").alias("contest_ord"),
        F.coalesce(F.regexp_replace("ballot_contest_name", r"\s+", " "), "official_contest_name").alias("ballot_contest_name"),
        F.coalesce("bmd_contest_name", "official_contest_name").alias("bmd_contest_name"), F.coalesce(num(F.col("vote_for")), F.lit(1)).alias("vote_for"),
        writeins.alias("writein_num"), options.alias("official_options"), lines("description").alias("descr_num"), lines("ballot_contest_name").alias("contest_name_num"),
        (F.coalesce(num(F.col("sheet")), F.lit(1)) - 1).alias("sheet0"),
    )
    slots = F.when(F.col("writein_num") > 0, F.transform(F.sequence(F.lit(0), F.col("writein_num") - 1), lambda i: F.concat(F.lit("writein_"), i.cast("string")))).otherwise(F.array().cast("array<string>"))
    return df.withColumn("writein_options", slots).withColumn("min_rois_num", F.col("contest_name_num") + F.col("descr_num") + F.size("official_options") + F.col("writein_num"))


def ballot_options(contest_rows: DataFrame, bof: DataFrame) -> DataFrame:
    """contest, opt_ord, option, ballot_option: the override if there is one."""
    o = contest_rows.select("contest", F.posexplode("official_options").alias("opt_ord", "option"))
    b = bof.select(F.col("official_contest_name").alias("contest"), F.col("official_option").alias("option"), F.col("ballot_option").alias("b_"))
    return o.join(b, ["contest", "option"], "left").select("contest", "opt_ord", "option", F.coalesce("b_", "option").alias("ballot_option"))


def carried_headers(names: list[str]) -> list[str | None]:
    """The contest of each column: 'Unnamed: n' belongs to the one before."""
    out: list[str | None] = []
    for n in names:
        out.append(n if n and not n.startswith("Unnamed") else (out[-1] if out else None))
    return out


def long_cvr(wide: DataFrame, ids: list[str]) -> DataFrame:
    """A wide CVR (id columns, then one or more columns per contest) as
    ballot_id, precinct, style_num, contest, slot, selection; blanks dropped.
    The first id column is the ballot, the next precinct and style."""
    contest_of = carried_headers(wide.columns)
    seen: dict[str, int] = {}
    parts = []
    for c, contest in zip(wide.columns, contest_of, strict=True):
        if c not in ids:
            slot = seen[contest] = seen.get(contest, -1) + 1
            parts.append(F.struct(F.lit(contest).alias("contest"), F.lit(slot).alias("slot"), F.nullif(F.trim(F.col(f"`{c}`").cast("string")), F.lit("")).alias("selection")))
    names = ["ballot_id", "precinct", "style_num"]
    own = [F.col(f"`{c}`").cast("string").alias(n) for c, n in zip(ids, names, strict=False)]
    return wide.select(*own, F.explode(F.array(*parts)).alias("e")).select(*names[: len(own)], "e.*").where("selection is not null")


SESSION = "Sessions array<struct<TabulatorId: int, BatchId: int, RecordId: int, SessionType: string, Original: struct<BallotTypeId: int, Cards: array<struct<Id: int>>>>>"


def sessions(json_rows: DataFrame) -> DataFrame:
    """Rows of JSON text (column value) of vendor sessions as one row per
    session; the card is the first, or 0."""
    s = json_rows.select(F.explode(F.from_json("value", SESSION)["Sessions"]).alias("s"))
    return s.select(
        F.format_string("%05d_%05d_%06d", "s.TabulatorId", "s.BatchId", "s.RecordId").alias("ballot_id"), F.col("s.SessionType").alias("session_type"),
        F.col("s.Original.BallotTypeId").alias("ballot_type_id"), F.coalesce(F.get("s.Original.Cards", F.lit(0))["Id"], F.lit(0)).alias("card_code"),
    )


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """A vendor manifest: one row per entry of its List."""
    return spark.read.option("multiLine", True).json(path).select(F.explode("List").alias("e")).select("e.*")


def style_matrix(wide: DataFrame, contest: str) -> DataFrame:
    """A contest by style matrix of 1 and blank as (style_num, contest) rows."""
    styles = [c for c in wide.columns if c != contest]
    rows = wide.select(contest, *[F.col(f"`{c}`").cast("string").alias(c) for c in styles]).unpivot([contest], styles, "style_num", "v")
    return rows.where(F.col("v").contains("1")).select("style_num", F.col(contest).alias("contest"))


def vendor_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per session of the CvrExport_<n>.json members of archives."""
    from . import archives

    found = archives.members(spark, path, content=True, pattern=r"(?:.*/)?CvrExport_\d+\.json")
    return sessions(found.select(F.col("content").cast("string").alias("value")))


def overrides(spark: SparkSession, lines: list[str], names: list[str]) -> DataFrame:
    """Settings whose values are short comma-separated rows, as a table of
    texts; quotes are removed."""
    rows = [tuple(x.strip() for x in next(csv.reader([line], skipinitialspace=True))) for line in lines]
    if bad := [r for r in rows if len(r) != len(names)]:
        raise ValueError(f"not {len(names)} fields: {bad[0]}")
    return spark.createDataFrame(rows, ", ".join(f"`{n}` string" for n in names))


def overridden(rows: DataFrame, key: str, value: str, changes: DataFrame) -> DataFrame:
    """rows with value replaced where changes (key, value) have the key."""
    new = changes.select(key, F.col(value).alias("new_"))
    return rows.join(new, key, "left").withColumn(value, F.coalesce("new_", value)).drop("new_").select(*rows.columns)
