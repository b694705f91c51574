"""Layouts of pages: vendors' box sizes, determinants, guesses by shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A column's width, its least and largest width, least and
# largest height in pixels, by vendor and number of columns; the column sizes
# of each page layout, narrower ones first.
SIZES = {
    ("ES&S", "3col"): (530, 510, 550, 45, 2500), ("ES&S", "2col"): (795, 760, 815, 45, 2500), ("ES&S", "1col"): (1590, 1570, 1610, 45, 500),
    ("Dominion", "3col"): (520, 500, 540, 45, 1600), ("Dominion", "2col"): (778, 758, 798, 45, 1000), ("Dominion", "1col"): (1557, 1537, 1577, 45, 500),
}
LAYOUTS = {"3col": ["3col"], "2col": ["2col"], "1&2col": ["2col", "1col"], "1col": ["1col"]}
# Voting target's width and height, blocks' offset and usual
# height, least and largest height of an option's block, by vendor and side of
# the target; margins cut around options and whole regions (top, bottom, left,
# right); a target's usual offset from a corner.
PARAMETERS = {
    ("ES&S", "left"): {"target": (36, 26), "block": (27, 110), "option_height": (60, 105), "option_crop": (5, 5, 50, 10), "full_crop": (5, 5, 5, 5), "target_offset": ("tl", 32, 26), "adjust_target_x": True},
    ("Dominion", "left"): {"target": (36, 26), "option_height": (60, 105), "option_crop": (2, 5, 60, 75), "full_crop": (2, 2, 2, 5), "target_offset": ("tl", 32, 26), "adjust_target_x": True},
    ("Dominion", "right"): {
        "target": (36, 26), "option_height": (60, 160), "option_crop": (2, 2, 2, 70), "full_crop": (2, 2, 2, 5), "target_offset": ("tr", -45, 22),
        "yes_offset": ("br", -45, -62), "no_offset": ("br", -45, -22), "adjust_target_x": False,
    },
}


def box_sizes(spark: SparkSession) -> DataFrame:
    """vendor, layout, ord, w_col, w_min, w_max, h_min, h_max."""
    rows = [(v, layout, i, *SIZES[v, c]) for layout, columns in LAYOUTS.items() for v in ("ES&S", "Dominion") for i, c in enumerate(columns)]
    return spark.createDataFrame(rows, "vendor string, layout string, ord int, w_col int, w_min int, w_max int, h_min int, h_max int")


def parameters(vendor: str, side: str, h_max_option: int | None = None) -> dict:
    """A vendor's layout constants; a setting may raise the option height."""
    if (vendor, side) not in PARAMETERS:
        raise ValueError(f"no layout for {vendor} with targets at the {side}")
    got = dict(PARAMETERS[vendor, side])
    if h_max_option:
        got["option_height"] = (got["option_height"][0], h_max_option)
    return got


def fitting(boxes: DataFrame, sizes: DataFrame) -> DataFrame:
    """Boxes (vendor, layout, w, h) with each size of their layout that they
    meet. The sizes are some ten constant rows."""
    return boxes.join(F.broadcast(sizes), ["vendor", "layout"]).where("w >= w_min and w <= w_max and h >= h_min and h <= h_max")


def determinant_sum(values: Column, first: bool = False) -> Column:
    """Sum of an array, or its first value; 0 for none."""
    if first:
        return F.coalesce(F.get(values, F.lit(0)), F.lit(0))
    return F.coalesce(F.aggregate(values, F.lit(0).cast("long"), lambda s, x: s + x), F.lit(0))


def maybe_summary(pages: Column, height: Column, width: Column, ratio: float = 5) -> Column:
    """A guess that a ballot is a printed summary: one page that is no strip."""
    return (pages == 1) & (height / width <= ratio)


def columns_in_use(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key, columns: those with any value in a group, in the table's order."""
    used = [F.when(F.count(f"`{c}`") > 0, c) for c in columns]
    return rows.groupBy(key).agg(F.array_compact(F.array(*used)).alias("columns"))


def numbered(rows: DataFrame, key: list[str], order: str, name: Column, content: Column) -> DataFrame:
    """A list's items under names with their place: name-1.ext and so on.
    Empty items are left out, their places stay taken. rows: key, order (from 0)."""
    root, ext = F.regexp_extract(name, r"^(.*?)(\.[^./\\]*)?$", 1), F.regexp_extract(name, r"^(.*?)(\.[^./\\]*)?$", 2)
    kept = rows.where(content.isNotNull() & (F.octet_length(content) > 0))
    return kept.select(*key, F.concat(root, F.lit("-"), (F.col(order) + 1).cast("string"), ext).alias("name"), content.alias("content"))
