"""Ballot styles: which contests they hold, learned from cast-vote records or
from the vendor's manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def from_manifests(ballot_types: DataFrame, contest_links: DataFrame, contests: DataFrame) -> DataFrame:
    """ballot_type, contests (in the links' order). ballot_types: Id,
    Description; contest_links: BallotTypeId, ContestId, ord; contests: Id,
    Description."""
    names = contests.select(F.col("Id").alias("ContestId"), F.col("Description").alias("contest"))
    rows = contest_links.join(names, "ContestId", "left").groupBy("BallotTypeId").agg(F.sort_array(F.collect_list(F.struct("ord", "contest"))).alias("c"))
    own = ballot_types.select(F.col("Id").alias("BallotTypeId"), F.col("Description").alias("ballot_type"))
    return own.join(rows, "BallotTypeId", "left").select("BallotTypeId", "ballot_type", F.coalesce(F.transform("c", lambda x: x["contest"]), F.array().cast("array<string>")).alias("contests"))


def external_types(external: DataFrame, manifest: DataFrame, cards: DataFrame) -> DataFrame:
    """card_code, ballot_type_id: cards to external id to ballot type."""
    e = external.select("external_id", F.explode("card_codes").alias("card_code"))
    m = manifest.select(F.col("ExternalId").cast("int").alias("external_id"), F.col("Id").alias("ballot_type_id"))
    return cards.join(e, "card_code", "left").join(m, "external_id", "left").select("card_code", "ballot_type_id")


def from_records(long_cvr: DataFrame, order: DataFrame) -> DataFrame:
    """style_num, contests: the contests any of a style's ballots has a value
    for, in the header's order. order: contest, contest_ord."""
    seen = long_cvr.where("selection is not null").select("style_num", "contest").distinct().join(order, "contest")
    return seen.groupBy("style_num").agg(F.transform(F.sort_array(F.collect_list(F.struct("contest_ord", "contest"))), lambda x: x["contest"]).alias("contests"))


def ballot_styles(cvr: DataFrame, order: list[str], style: Column | None = None) -> DataFrame:
    """ballot_id, style_num; a repeated ballot's last row counts."""
    w = Window.partitionBy("ballot_id").orderBy(*[F.desc(c) for c in order])
    return cvr.withColumn("style_num", F.lit(None).cast("string") if style is None else style).withColumn("i_", F.row_number().over(w)).where("i_ = 1").select("ballot_id", "style_num")


def option_names(long_cvr: DataFrame) -> DataFrame:
    """Distinct options per contest, sorted, write-ins last."""
    o = long_cvr.where(~F.col("selection").isin("overvote", "undervote")).select("contest", F.col("selection").alias("option")).distinct()
    return o.groupBy("contest").agg(F.transform(F.sort_array(F.collect_list(F.struct((F.col("option") == "write-in:").alias("last"), "option"))), lambda x: x["option"]).alias("options"))


def merged(base: DataFrame, over: DataFrame, key: str) -> DataFrame:
    """Rows of both; where both have a key, those of `over`."""
    return base.join(over.select(key).distinct(), key, "left_anti").unionByName(over, allowMissingColumns=True)


def on_sheet(style_contests: DataFrame, contests: DataFrame, sheet0: int) -> DataFrame:
    """Contests of styles that are printed on one sheet."""
    return style_contests.join(contests.where(F.col("sheet0") == sheet0).select("contest"), "contest", "left_semi")


def mapping_failed(styles: DataFrame, mapped: DataFrame) -> DataFrame:
    """styles with style_failed; a style that was not mapped at all failed."""
    return styles.join(mapped.select("style_num", "style_failed_to_map"), "style_num", "left").withColumn("style_failed", F.coalesce("style_failed_to_map", F.lit(True))).drop("style_failed_to_map")


def canonical(styles: DataFrame) -> DataFrame:
    """style_num, same_as: the first style with an equal contest list."""
    return styles.withColumn("same_as", F.min("style_num").over(Window.partitionBy(F.to_json("contests"))))


def orphan_regions(candidates: DataFrame) -> DataFrame:
    """Regions per style that may be left over: one less than the fewest that
    any candidate contest needs."""
    return candidates.groupBy("style_num").agg(F.greatest(F.min("min_rois_num") - 1, F.lit(0)).alias("max_orphans"))


def excluded_types(rows: DataFrame, low: int | None, high: int | None, style: str = "style_num") -> DataFrame:
    """Rows whose style number is in [low, high); a missing limit doesn't
    bind, a style that is no number is out."""
    n = F.col(style).try_cast("int")
    keep = n.isNotNull()
    keep = keep if low is None else keep & (n >= low)
    return rows.where(keep if high is None else keep & (n < high))
