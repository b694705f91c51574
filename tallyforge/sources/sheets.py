"""Spreadsheets: cells of .xlsx files, and drawn cells that mean write-ins."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WRITEIN = "write-in:"
CELLS = "file string, row int, col int, value string"


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _column(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", ref)[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


def cells(data: bytes) -> Iterator[tuple[int, int, str]]:
    """(row, column, text) of the first sheet, both from 0; cells that hold a
    drawing are write-ins."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        shared: list[str] = []
        if "xl/sharedStrings.xml" in names:
            for _, e in ElementTree.iterparse(z.open("xl/sharedStrings.xml")):
                if _local(e.tag) == "si":
                    shared.append("".join(t.text or "" for t in e.iter() if _local(t.tag) == "t"))
                    e.clear()
        drawn: set[tuple[int, int]] = set()
        if "xl/drawings/drawing1.xml" in names:
            for a in ElementTree.parse(z.open("xl/drawings/drawing1.xml")).iter():
                if _local(a.tag) == "from":
                    at = {_local(x.tag): int(x.text) for x in a if _local(x.tag) in ("row", "col")}
                    drawn.add((at["row"], at["col"]))
        for _, e in ElementTree.iterparse(z.open("xl/worksheets/sheet1.xml")):
            if _local(e.tag) == "row":
                r = int(e.get("r")) - 1
                for c in e:
                    at = (r, _column(c.get("r")))
                    v = next((x.text or "" for x in c.iter() if _local(x.tag) in ("v", "t")), "")
                    if at not in drawn and v:
                        yield *at, shared[int(v)] if c.get("t") == "s" else v
                e.clear()
        for at in sorted(drawn):
            yield *at, WRITEIN


def read(spark: SparkSession, path: str) -> DataFrame:
    """All cells of the files, long: file, row, col, value. A file is one task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, data in zip(pdf["path"], pdf["content"], strict=True):
                rows = [(name.rsplit("/", 1)[-1], *c) for c in cells(data)]
                yield pd.DataFrame(rows, columns=["file", "row", "col", "value"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, CELLS)


def cast_votes(cell_rows: DataFrame, ids: int = 3) -> DataFrame:
    """ballot_id, precinct, style_num, contest, slot, selection from cells with
    a header row. A blank or 'Unnamed' header belongs to the contest before."""
    named = cell_rows.where("row = 0 and value not like 'Unnamed%'").select("file", F.col("col").alias("from_"), F.col("value").alias("contest"))
    spans = named.withColumn("to_", F.expr("lead(from_, 1, 1000000) over (partition by file order by from_)"))
    data = cell_rows.where(F.col("row") > 0)
    own = data.where(F.col("col") < ids).groupBy("file", "row").pivot("col", list(range(ids))).agg(F.first("value"))
    own = own.select("file", "row", *[F.col(str(i)).alias(n) for i, n in enumerate(("ballot_id", "precinct", "style_num")[:ids])])
    votes = data.where(F.col("col") >= ids).join(spans, "file").where("col >= from_ and col < to_")
    return votes.join(own, ["file", "row"]).select(*own.columns[2:], "contest", (F.col("col") - F.col("from_")).alias("slot"), F.trim("value").alias("selection")).where("selection <> ''")
