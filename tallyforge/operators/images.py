"""What is done on boxes, text lines and pixels of pages."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def in_region(boxes: DataFrame, x: Column, y: Column, w: Column, h: Column, slack: int = 0) -> DataFrame:
    """Boxes inside a region; an extent that is null doesn't bind."""
    free = lambda limit, test: limit.isNull() | test
    keep = free(x, F.col("x") >= x - slack) & free(y, F.col("y") >= y - slack)
    keep = keep & free(x + w, F.col("x") + F.col("w") <= x + w + slack) & free(y + h, F.col("y") + F.col("h") <= y + h + slack)
    return boxes.where(keep)


def lines_of_words(words: DataFrame) -> DataFrame:
    """Recognised words united to lines: text in order, box, number of words.
    words: page, block, line, word, x, y, w, h, text."""
    per = words.groupBy("page", "block", "line").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("word", "text"))), lambda s: s["text"]), " ").alias("text"), F.min("x").alias("x"), F.min("y").alias("y"),
        (F.max(F.col("x") + F.col("w")) - F.min("x")).alias("w"), F.max("h").alias("h"), F.count("*").alias("n"),
    )
    return per


def summary_contests(lines: DataFrame, layout: DataFrame) -> DataFrame:
    """ballot_id, contest_ord, contest, ocr_contest, ocr_options of printed
    summaries: each contest takes a line for its name and one for each vote.
    lines: ballot_id, style_num, line_ord (from 0), text; layout: style_num,
    contest_ord, contest, vote_for. Contests beyond the last line are null."""
    w = Window.partitionBy("style_num").orderBy("contest_ord").rowsBetween(Window.unboundedPreceding, -1)
    starts = layout.withColumn("at", F.coalesce(F.sum(1 + F.col("vote_for")).over(w), F.lit(0)).cast("int"))
    texts = lines.groupBy("ballot_id", "style_num").agg(F.transform(F.sort_array(F.collect_list(F.struct("line_ord", "text"))), lambda s: s["text"]).alias("t"))
    df = texts.join(starts, "style_num")
    return df.select("ballot_id", "contest_ord", "contest", F.get("t", F.col("at")).alias("ocr_contest"), F.slice("t", F.col("at") + 2, F.col("vote_for")).alias("ocr_options"))


def barcode_votes(codes: DataFrame, roismap: DataFrame) -> DataFrame:
    """Targets that a summary's barcodes name. codes: ballot_id, style_num,
    coords (in order), names (same order, of write-ins), declared (the number
    that the header says); roismap: style_num, contest, option, ev_coord_str."""
    from ..functions.text import coordinate

    rows = codes.select("ballot_id", "style_num", "names", (F.size("coords") == F.col("declared")).alias("complete"), F.posexplode("coords").alias("i", "c")).withColumn("key", coordinate(F.col("c")))
    targets = roismap.select("style_num", "contest", "option", coordinate(F.col("ev_coord_str")).alias("key"))
    df = rows.join(targets, ["style_num", "key"])
    name = F.when(F.col("option").startswith("writein"), F.get("names", F.col("i")))
    return df.select("ballot_id", "contest", "option", F.lit("DefiniteMark").alias("has_indication"), F.lit(1).alias("num_marks"), name.alias("writein_name"), "complete")


def ratio_matches(points: DataFrame, others: DataFrame, ratio: float = 0.7) -> DataFrame:
    """Points per image pair whose nearest point is nearer than `ratio` times
    the second. points, others: image, point, v (array). Distances are taken
    within the pairs of images given by column pair only."""
    o = others.select("pair", F.col("v").alias("u_"))
    square = F.aggregate(F.zip_with("v", "u_", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    d = points.join(o, "pair").select("pair", "point", F.sqrt(square).alias("d"))
    near = d.withColumn("i_", F.row_number().over(Window.partitionBy("pair", "point").orderBy("d"))).where("i_ <= 2")
    two = near.groupBy("pair", "point").agg(F.min("d").alias("a"), F.max("d").alias("b"), F.count("*").alias("n")).where("n = 2")
    return two.groupBy("pair").agg(F.count_if(F.col("a") < ratio * F.col("b")).alias("matches"), F.count("*").alias("points"))


@F.pandas_udf(T.DoubleType())
def mean_square(a: pd.Series, b: pd.Series) -> pd.Series:
    """Mean squared difference of two images (PBM, PGM or PNG), the smaller
    one padded with white."""
    from .mapping import read_image

    def one(x: bytes, y: bytes) -> float:
        p, q = read_image(x).astype(float), read_image(y).astype(float)
        h, w = max(p.shape[0], q.shape[0]), max(p.shape[1], q.shape[1])
        p, q = (np.pad(m, ((0, h - m.shape[0]), (0, w - m.shape[1])), constant_values=255.0) for m in (p, q))
        return float(((p - q) ** 2).mean())

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)])


def cut(image: np.ndarray, x: int, y: int, w: int, h: int, clear: bool = False) -> np.ndarray:
    """A region of an image, or the image with that region white."""
    if not clear:
        return image[y : y + h, x : x + w]
    out = image.copy()
    out[y : y + h, x : x + w] = 255
    return out


def white_gaps(image: np.ndarray, dark: int = 170, least: int = 4) -> list[tuple[int, int]]:
    """(first row, one past the last) of bands with ink, parted by at least
    `least` rows without."""
    ink = np.flatnonzero((image <= dark).any(axis=1))
    if not len(ink):
        return []
    cuts = np.flatnonzero(np.diff(ink) > least)
    return list(zip(ink[np.concatenate([[0], cuts + 1])].tolist(), (ink[np.concatenate([cuts, [len(ink) - 1]])] + 1).tolist(), strict=True))


def timing_marks(image: np.ndarray, width: int = 60, dark: int = 128, least: int = 8) -> list[tuple[int, int, int, int]]:
    """(x, y, w, h) of the dark blocks along the left edge."""
    strip = image[:, :width] <= dark
    rows = np.flatnonzero(strip.sum(axis=1) >= least)
    if not len(rows):
        return []
    out = []
    for part in np.split(rows, np.flatnonzero(np.diff(rows) > 1) + 1):
        if len(part) >= least:
            cols = np.flatnonzero(strip[part].mean(axis=0) > 0.5)
            if len(cols):
                out.append((int(cols[0]), int(part[0]), int(cols[-1] - cols[0] + 1), len(part)))
    return out


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField(c, T.IntegerType()) for c in "xywh"])))
def marks_of(content: pd.Series) -> pd.Series:
    from .mapping import read_image

    return content.map(lambda c: [dict(zip("xywh", m, strict=True)) for m in timing_marks(read_image(c))])


def mean_template(images: DataFrame, key: str = "style_num") -> DataFrame:
    """Mean image per key with values stretched to 0..255, as (key, h, w,
    pixels). images: key, content. Sums are made per batch and added up, so no
    task holds a key's images; a key's images have one size."""
    from .mapping import read_image

    def sums(batches):
        for pdf in batches:
            got: dict = {}
            for k, c in zip(pdf[key], pdf["content"], strict=True):
                p = read_image(c).astype(np.int64)
                n, total = got.get((k, p.shape), (0, 0))
                got[k, p.shape] = n + 1, total + p
            yield pd.DataFrame([(k, *shape, n, total.tobytes()) for (k, shape), (n, total) in got.items()], columns=[key, "h", "w", "n", "total"])

    part = images.select(key, "content").mapInPandas(sums, f"{key} string, h int, w int, n long, total binary")

    def united(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(t, np.int64) for t in pdf["total"]) / pdf["n"].sum()
        span = np.ptp(total) or 1.0
        return pd.DataFrame([(pdf[key].iloc[0], pdf["h"].iloc[0], pdf["w"].iloc[0], ((total - total.min()) / span * 255).round().astype(np.uint8).tobytes())], columns=[key, "h", "w", "pixels"])

    return part.groupBy(key, "h", "w").applyInPandas(united, f"{key} string, h int, w int, pixels binary")


def bands(templates: DataFrame, columns: int = 1) -> DataFrame:
    """style_num, roi_idx, x, y, w, h: bands with ink of a template's columns of
    equal width, column by column from the top. templates: style_num, h, w,
    pixels."""

    def run(batches):
        for pdf in batches:
            out = []
            for t in pdf.itertuples():
                image = np.frombuffer(t.pixels, np.uint8).reshape(t.h, t.w)
                edges = [c * t.w // columns for c in range(columns + 1)]
                found = [(a, y, b - a, y2 - y) for a, b in zip(edges, edges[1:]) for y, y2 in white_gaps(image[:, a:b])]
                out += [(t.style_num, i, *box) for i, box in enumerate(found)]
            yield pd.DataFrame(out, columns=["style_num", "roi_idx", "x", "y", "w", "h"])

    return templates.select("style_num", "h", "w", "pixels").mapInPandas(run, "style_num string, roi_idx int, x int, y int, w int, h int")


def with_words(rois: DataFrame, words: DataFrame) -> DataFrame:
    """rois with ocr_text: the words whose middle lies in them, in order. A
    word looks its region up in its style's list, so no pairs are made."""
    lists = rois.groupBy("style_num").agg(F.collect_list(F.struct("roi_idx", "x", "y", "w", "h")).alias("r"))
    x, y = F.col("x") + F.col("w") / 2, F.col("y") + F.col("h") / 2
    inside = F.filter("r", lambda r: (x >= r["x"]) & (x < r["x"] + r["w"]) & (y >= r["y"]) & (y < r["y"] + r["h"]))
    placed = words.join(lists, "style_num").withColumn("roi_idx", F.get(inside, F.lit(0))["roi_idx"]).where("roi_idx is not null")
    texts = placed.groupBy("style_num", "roi_idx").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("word_ord", "text"))), lambda s: s["text"]), " ").alias("ocr_text"))
    return rois.join(texts, ["style_num", "roi_idx"], "left").withColumn("ocr_text", F.coalesce("ocr_text", F.lit("")))
