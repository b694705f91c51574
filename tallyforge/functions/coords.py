"""Places on a page: targets, timing marks, regions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bind

MARK = "array<struct<x: int, y: int, w: int, h: int>>"
#: Largest extents of a page in pixels.
HEIGHT, WIDTH = 2800, 1785


def mid_marks(marks: Column, axis: str = "y") -> Column:
    """Middles of timing marks; halves go to the even number."""
    size = {"y": "h", "x": "w"}[axis]
    return F.transform(marks, lambda m: m[axis] + F.bround(m[size] / 2).cast("int"))


def mid_gaps(marks: Column) -> Column:
    """Middles of the gaps between marks, one period more at both ends; none
    for fewer than three marks."""
    n = F.size(marks)
    inner = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.bround((F.get(marks, i)["y"] + F.get(marks, i - 1)["y"] + F.get(marks, i - 1)["h"]) / 2).cast("int"))
    period = F.get(inner, F.lit(1)) - F.get(inner, F.lit(0))
    return F.when(n >= 3, F.concat(F.array(F.get(inner, F.lit(0)) - period), inner, F.array(F.get(inner, n - 2) + period))).otherwise(F.array().cast("array<int>"))


def nearest(places: Column, at: Column) -> Column:
    """The place nearest to a coordinate, the first of equally near ones;
    the coordinate itself if there is none."""

    def of(at: Column) -> Column:
        best = F.array_min(F.transform(places, lambda p, i: F.struct(F.abs(p - at).alias("d"), i.alias("i"), p.alias("p"))))
        return F.coalesce(best["p"], at)

    return bind(at, of)


def containing(marks: Column, at: Column, axis: str = "y", first: int = 0) -> Column:
    """Number of the first mark that a coordinate lies inside, counted from
    `first`; 0 if there is none."""
    size = {"y": "h", "x": "w"}[axis]
    hit = F.transform(marks, lambda m, i: F.when((at > m[axis]) & (at < m[axis] + m[size]), i + first))
    return F.coalesce(F.get(F.filter(hit, lambda x: x.isNotNull()), F.lit(0)), F.lit(0)).cast("int")


def coordinate_text(x: Column, y: Column, page0: Column, sheet0: Column) -> tuple[Column, Column]:
    """(XXYYPS, fine): a pair of zeros says that a mark wasn't found."""
    text = F.format_string("%02d%02d%d%d", x, y, page0 + 1, sheet0 + 1)
    return text, ~text.contains("00")


def target(roi: Column, ref: Column, dx: Column, dy: Column, text_rows: bool = False) -> Column:
    """struct(x, y): the offset added to the region's corner tl, tr, bl or br.
    Regions from text rows are placed by their block's edge and own middle."""
    right, low = ref.isin("tr", "br"), ref.isin("bl", "br")
    if text_rows:
        return F.struct((roi["blk_x"] + F.when(right, roi["blk_w"]).otherwise(0) + dx).alias("x"), roi["y"].alias("y"))
    return F.struct((roi["x"] + F.when(right, roi["w"]).otherwise(0) + dx).alias("x"), (roi["y"] + F.when(low, roi["h"]).otherwise(0) + dy).alias("y"))


def on_ballot(x: Column, y: Column, roi: Column, side: Column, top: Column | None = None) -> Column:
    """struct(x, y, dx, dy): a mapped target (or, if it is null or no number,
    the region's corner plus a fixed offset) moved to this ballot's marks."""
    bad = x.isNull() | y.isNull() | F.isnan(x.cast("double")) | F.isnan(y.cast("double"))
    x0 = F.when(bad, roi["x"] + 36).otherwise(x).cast("int")
    y0 = F.when(bad, roi["y"] + 26).otherwise(y).cast("int")
    y1 = nearest(mid_marks(side, "y"), y0)
    x1 = nearest(mid_marks(top, "x"), x0) if top is not None else x0
    return F.struct(x1.alias("x"), y1.alias("y"), (x1 - x0).alias("dx"), (y1 - y0).alias("dy"))


REGION = "y int, h int, x int, w int, h_min int, p int, s int, r int, ox int, oy int, h_or_v string, styles array<string>, exstyles array<string>"


def region(spec: Column, gaps: Column) -> Column:
    """struct of a region's pixels from its specification, a JSON text (also
    with single quotes): heights that are numbers of gaps, or pixels that snap to
    the nearest gap. Null if it doesn't parse or leaves the page."""
    s = F.from_json(spec, REGION, {"allowSingleQuotes": "true", "allowUnquotedFieldNames": "true"})
    return bind(F.struct(s.alias("s"), gaps.alias("g")), lambda b: _region(b["s"], b["g"]))


def _region(s: Column, gaps: Column) -> Column:
    n = F.size(gaps)
    by_index = (s["y"] >= 0) & (s["y"] < n)
    x = F.coalesce(s["x"], F.lit(0))
    w = F.coalesce(s["w"], F.lit(WIDTH) - x)
    at = F.get(gaps, s["y"])
    rows = F.least(F.coalesce(s["h"], n - s["y"] - 1), n - s["y"] - 1)
    top = F.when(by_index, at).otherwise(nearest(gaps, s["y"]))
    below = lambda y: F.when(by_index, F.get(gaps, s["y"] + rows)).otherwise(nearest(gaps, y + F.least(F.coalesce(s["h"], F.lit(HEIGHT) - y), F.lit(HEIGHT) - y)))
    period = F.get(gaps, F.lit(1)) - F.get(gaps, F.lit(0))
    least = F.coalesce(s["h_min"], F.lit(0))
    got = lambda y, bottom: F.struct(
        x.alias("x"), y.alias("y"), w.alias("w"), (bottom - y).alias("h"), F.when(by_index, least * period - period / 2).otherwise(least).alias("h_min"), F.coalesce(s["p"], F.lit(0)).alias("p"),
        F.coalesce(s["s"], F.lit(0)).alias("s"), F.coalesce(s["r"], F.lit(1)).alias("r"), F.coalesce(s["h_or_v"], F.lit("h")).alias("h_or_v"), s["styles"].alias("styles"), s["exstyles"].alias("exstyles"),
    )
    fits = s["y"].isNotNull() & (n > 0) & (x + w <= WIDTH)
    return F.when(fits, bind(top, lambda y: bind(below(y), lambda bottom: F.when(bottom <= HEIGHT, got(y, bottom)))))


def consistent(left: Column, right: Column, back_left: Column, back_right: Column) -> Column:
    """As many marks on both sides of a page; the back may have none."""
    return F.coalesce(F.size(left) == F.size(right), F.lit(False)) & F.coalesce((F.size(back_left) == F.size(back_right)) | back_left.isNull() | back_right.isNull(), F.lit(True))


def unstretched(at: Column, marks: Column, standard: Column) -> Column:
    """A coordinate moved from a ballot's marks (ascending) to the standard
    ones: linear between the marks around it, shifted beyond the ends."""
    n = F.least(F.size(marks), F.size(standard))
    i = F.size(F.filter(F.slice(marks, F.lit(1), n), lambda m: m <= at)) - 1
    low, high = F.get(marks, i), F.get(marks, i + 1)
    inside = (i >= 0) & (i < n - 1)
    moved = F.get(standard, i) + (at - low) * (F.get(standard, i + 1) - F.get(standard, i)) / (high - low)
    end = F.when(i < 0, F.lit(0)).otherwise(n - 1)
    return F.when(n < 1, at).when(inside, moved).otherwise(at + F.get(standard, end) - F.get(marks, end)).cast("double")
