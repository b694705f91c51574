"""Codes on ballots."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def mask_rows() -> list[tuple[int, int, int]]:
    """(mask, value, add): one of four low bits counts 1 to 4; one or two of
    six middle bits count in fours; the three top bits have values of their own."""
    low = [(0x3C, 0x20 >> i, i + 1) for i in range(4)]
    six = [0x800 >> i for i in range(6)]
    chosen = [(b,) for b in six] + list(itertools.combinations(six, 2))
    middle = [(0xFC0, sum(c), 4 * k) for k, c in enumerate(chosen, 1)]
    top = [(0xE000, v << 13, a) for v, a in zip((6, 5, 4, 3, 1), (24, 108, 168, 252, 336), strict=True)]
    return low + middle + top


PARTY = {0x21: 0, 0x31: 1, 0x29: 2, 0x25: 3, 0x23: 4}


def card_style(code: Column) -> Column:
    """Style of an edge code (long): null on even parity, beyond 211 or an
    unknown party; a party adds its thousands."""
    core = F.shiftright(code, 20).bitwiseAND(F.lit(0xFFFF))
    style = sum((F.when(core.bitwiseAND(F.lit(m)) == v, a).otherwise(0) for m, v, a in mask_rows()), F.lit(0))
    party = F.shiftright(code, 48).bitwiseAND(F.lit(0xFF))
    add = F.lit(None).cast("int")
    for digits, p in PARTY.items():
        add = F.when(party == digits, 1000 * p).otherwise(add)
    return F.when((F.bit_count(code) % 2 == 1) & (style <= 211), style + add).cast("int")


def effective_style(card_code: Column, ballot_type: Column, variety: Column) -> tuple[Column, Column]:
    """(style string, sheet from 0) of a card code: party, language and sheet
    follow from the code modulo 57. Divisions round down, also below zero."""
    core = F.pmod(card_code, F.lit(57))
    late = core > 54
    sl = F.pmod(core - 1, F.lit(6))
    sheet = F.when(late, 2).otherwise(sl % 2 + 1)
    lang = F.when(late, core - 54).otherwise(F.floor(sl / 2) + 1)
    party = F.when(late, 0).otherwise(F.floor((core - 1) / 6) + 1)
    text = F.concat(*[x.cast("int").cast("string") for x in (lang, party, sheet, variety)], F.lpad(ballot_type.cast("string"), 3, "0"))
    return text, (sheet - 1).cast("int")


def masks(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(mask_rows(), "mask int, value int, add int")
