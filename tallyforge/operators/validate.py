"""Checks that give rows of violations instead of stopping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EXCEPTION = "stage string, key string, code string, message string"


def columns(df: DataFrame, required: list[str]) -> list[str]:
    """What is wrong with a table's columns: missing or repeated ones."""
    own = [c.strip() for c in df.columns]
    return [f"missing {c}" for c in required if c not in own] + [f"repeated {c}" for c in dict.fromkeys(own) if own.count(c) > 1]


def trimmed(df: DataFrame) -> DataFrame:
    """Column names and text cells without space around them."""
    df = df.toDF(*[c.strip() for c in df.columns])
    return df.select(*[F.trim(F.col(f"`{c}`")).alias(c) if t == "string" else F.col(f"`{c}`") for c, t in df.dtypes])


def headers_equal(df: DataFrame, wanted: list[str]) -> list[tuple[int, str | None, str | None]]:
    """(place, found, wanted) wherever the header isn't the expected one."""
    n = max(len(df.columns), len(wanted))
    at = lambda xs, i: xs[i] if i < len(xs) else None
    return [(i, at(df.columns, i), at(wanted, i)) for i in range(n) if at(df.columns, i) != at(wanted, i)]


def exceptions(rows: DataFrame, stage: str, key: str, code: Column, message: Column) -> DataFrame:
    """Rows with a code that isn't null as exceptions of a stage."""
    return rows.select(F.lit(stage).alias("stage"), F.col(key).cast("string").alias("key"), code.alias("code"), message.cast("string").alias("message")).where("code is not null")


def inconsistent(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Keys with more than one value. Distinct pairs first, so that a key of
    many rows is not gathered anywhere."""
    return rows.select(key, value).where(F.col(value).isNotNull()).distinct().groupBy(key).agg(F.count("*").alias("values")).where("values > 1")


def even_parity(rows: DataFrame, code: str) -> DataFrame:
    """Rows per code with an even number of one bits."""
    return rows.where(F.bit_count(code) % 2 == 0).groupBy(code).agg(F.count("*").alias("n"))


def several(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys with more than one row where one is expected."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def first_match(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the first, with whether there were others."""
    w = Window.partitionBy(*keys)
    df = rows.withColumns({k: F.trim(F.col(k).cast("string")) for k in keys}).withColumns({"i_": F.row_number().over(w.orderBy(*order)), "n_": F.count("*").over(w)})
    return df.where("i_ = 1").withColumn("several", F.col("n_") > 1).drop("i_", "n_")


KINDS = {
    "localpath": r"[^<>|?*\x00]+", "s3path": r"s3://[^/]+/.*", "filename": r"[^/\\<>|?*\x00]+", "url": r"https?://[^\s/]+(/\S*)?", "regex": r".*\([^?].*\).*", "int": r"[+-]?\d[\d,]*", "bool": r"(?i)yes|no|true|false|t|f|y|n|1|0",
}


def setting_errors(values: DataFrame, spec: DataFrame) -> DataFrame:
    """name, problem. values: name, value; spec: name, format (of KINDS or
    null), required (boolean), choices (array or null)."""
    df = spec.join(values.withColumn("given", F.lit(True)), "name", "full")
    odd = F.lit(False)
    for kind, pattern in KINDS.items():
        odd = odd | ((F.col("format") == kind) & ~F.col("value").rlike(f"^(?:{pattern})$"))
    known = spec.select("name", F.lit(True).alias("known"))
    problem = (
        F.when(F.col("known").isNull(), "unknown").when(F.col("given").isNull() & F.col("required"), "missing")
        .when(F.col("value").isNotNull() & F.col("choices").isNotNull() & ~F.array_contains("choices", F.coalesce("value", F.lit(""))), "not among the choices")
        .when(F.col("value").isNotNull() & F.col("format").isNotNull() & odd, "format")
    )
    return df.join(known, "name", "left").select("name", problem.alias("problem")).where("problem is not null")
