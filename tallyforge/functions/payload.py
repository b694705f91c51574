"""Votes in the binary payloads of machine-marked ballots, and other codes.

Bytes are taken apart with built-in functions; contests are cut out of the bit
string by a running sum of their widths."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import bind


def byte(data: Column, at: Column | int) -> Column:
    """The byte at an offset from 0, as int; null beyond the end."""
    return F.conv(F.nullif(F.hex(F.substring(data, F.lit(at) + 1, F.lit(1))), F.lit("")), 16, 10).cast("int")


def little(data: Column, at: Column | int, n: int) -> Column:
    """n bytes at an offset, the lowest first."""
    return sum((byte(data, F.lit(at) + i).cast("long") * 256**i for i in range(n)), F.lit(0))


def part(data: Column, start: Column | int, stop: Column | int) -> Column:
    return F.substring(data, F.lit(start) + 1, F.greatest(F.lit(stop) - F.lit(start), F.lit(0)))


def bits(data: Column) -> Column:
    """Bytes as a string of 0 and 1, the highest bit first."""

    def of(data: Column) -> Column:
        n = F.octet_length(data)
        four = lambda i: F.lpad(F.conv(F.hex(F.substring(data, 4 * i + 1, F.lit(4))), 16, 2), 8 * F.least(n - 4 * i, F.lit(4)), F.lit("0"))
        return F.when(n == 0, "").otherwise(F.array_join(F.transform(F.sequence(F.lit(0), F.floor((n - 1) / 4).cast("int")), four), ""))

    return bind(data, of)


@F.pandas_udf(T.ArrayType(T.StringType()))
def names_in(tail: pd.Series) -> pd.Series:
    """Written-in names: a count, then for each what follows the next zero byte
    and one more, up to a zero byte."""

    def one(data: bytes | None) -> list[str]:
        out = []
        if data:
            rest = bytes(data[1:])
            for _ in range(data[0]):
                rest = rest[rest.find(b"\0") + 2 :]
                out.append(rest.partition(b"\0")[0].decode("utf-8", "replace"))
        return out

    return tail.map(one)


def opened(payload: Column) -> Column:
    """struct(sheet, card0, card1, bits array of both blocks, tails array) of a
    payload in hex. A ballot of one sheet has no first block."""
    return bind(F.unhex(payload), _opened)


def _opened(d: Column) -> Column:
    one = byte(d, 16) == 1
    a = F.when(one, 0).otherwise(byte(d, 21))
    first, second = part(d, 25, F.lit(25) + a), part(d, a + 25, a + 22 + F.when(one, byte(d, 21)).otherwise(byte(d, a + 25)))
    second = F.when(one, second).otherwise(part(d, a + 29, a + 22 + byte(d, a + 25)))
    sub2 = F.when(one, byte(d, 22)).otherwise(byte(d, a + 26))
    tail = lambda c, n: part(c, n, F.octet_length(c))
    return F.struct(
        byte(d, 16).alias("sheet"), little(d, 17, 2).cast("int").alias("card0"), F.when(one, 0).otherwise(little(d, a + 21, 2)).cast("int").alias("card1"),
        F.array(bits(F.when(one, F.lit(b"")).otherwise(first)), bits(second)).alias("bits"),
        F.array(F.when(one, F.lit(b"")).otherwise(tail(first, byte(d, 23))), tail(second, sub2 + 5)).alias("tails"),
    )


def votes(ballots: DataFrame, layout: DataFrame) -> DataFrame:
    """ballot_id, contest, selections. ballots: ballot_id, ballot_type_id, qr
    (hex); layout: ballot_type_id, contest_ord, contest, vote_for, block (0 or
    1), options. No vote: BLANK CONTEST; too few: UNDER_VOTE_BY n first."""
    own = Window.partitionBy("ballot_type_id", "block").orderBy("contest_ord").rowsBetween(Window.unboundedPreceding, -1)
    layout = layout.withColumn("at", F.coalesce(F.sum(F.size("options")).over(own), F.lit(0)))
    q = ballots.withColumn("q", opened(F.col("qr"))).select("ballot_id", "ballot_type_id", "q.bits", F.array(names_in(F.col("q.tails")[0]), names_in(F.col("q.tails")[1])).alias("names"))
    df = q.join(layout, "ballot_type_id")
    own_bits = F.substring(F.get("bits", F.col("block")), F.col("at").cast("int") + 1, F.size("options"))
    df = df.withColumn("own", own_bits).withColumn("marked", F.filter("options", lambda o, i: F.substring(F.col("own"), i + 1, F.lit(1)) == "1"))
    before = Window.partitionBy("ballot_id", "block").orderBy("contest_ord").rowsBetween(Window.unboundedPreceding, -1)
    slots = F.size(F.filter("marked", lambda o: o == "Write-in"))
    df = df.withColumn("used", F.coalesce(F.sum(slots).over(before), F.lit(0)).cast("int"))
    earlier = lambda i: F.size(F.filter(F.slice("marked", F.lit(1), i), lambda o: o == "Write-in"))
    named = F.transform("marked", lambda o, i: F.when(o == "Write-in", F.concat(o, F.lit(" "), F.coalesce(F.get(F.get("names", F.col("block")), F.col("used") + earlier(i)), F.lit("")))).otherwise(o))
    few = F.col("vote_for") - F.size("marked")
    said = F.when(F.size("marked") == 0, F.array(F.lit("BLANK CONTEST"))).when(few > 0, F.concat(F.array(F.concat(F.lit("UNDER_VOTE_BY "), few.cast("string"))), named)).otherwise(named)
    return df.select("ballot_id", "contest", said.alias("selections"))


def ranked(payload: Column, options: int, ranks: int) -> Column:
    """struct(precinct, style, marks): of a ranked contest's payload in hex,
    for each rank the numbers (from 0) of the options marked."""
    d = F.unhex(F.replace(payload, F.lit(" "), F.lit("")))
    field = lambda d: bits(part(d, 19, F.lit(15) + little(d, 15, 2)))
    marks = lambda f: F.transform(F.sequence(F.lit(0), F.lit(ranks - 1)), lambda r: F.filter(F.sequence(F.lit(0), F.lit(options - 1)), lambda o: F.substring(f, r * options + o + 1, F.lit(1)) == "1"))
    return bind(d, lambda d: F.struct(little(d, 6, 4).alias("precinct"), little(d, 11, 4).alias("style"), bind(field(d), marks).alias("marks")))


def bar_code(code: Column) -> tuple[Column, Column]:
    """(card code, sheet and page) of a bar code of 0 and 1: the style is in the
    reversed bits, the last four bits aren't reversed."""
    return F.conv(F.right(F.reverse(code), F.lit(16)), 2, 10).cast("int"), F.conv(F.right(code, F.lit(4)), 2, 10).cast("int")


def header_code(code: Column) -> Column:
    """The four fields of a summary ballot's header code."""
    cut = lambda a, n: F.substring(code, a, n).try_cast("long")
    return F.struct(cut(1, 10).alias("ballot"), cut(11, 10).alias("style"), cut(21, 3).alias("precinct"), cut(24, 3).alias("count"))


def logical_style(code: Column) -> tuple[Column, Column]:
    """(style, clean): the style's number is above the low 16 bits, whose low
    byte is 1 and whose high byte is 1 or 2 on all known ballots."""
    low, high = code.bitwiseAND(F.lit(0xFF)), F.shiftright(code, 8).bitwiseAND(F.lit(0xFF))
    return F.shiftright(code, 16).cast("int"), (low == 1) & high.isin(1, 2)
