"""Mapping regions of a template to contests and options, style by style."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fuzzy import ACCEPT, ratio


def mapped(rois: DataFrame, contests: DataFrame, slip: int = 3) -> DataFrame:
    """style_num, contest, option, roi_idx, ok.

    rois: style_num, roi_idx, ocr_text in reading order; contests: style_num,
    contest_ord, contest, options. For each contest in order the window slides
    at most `slip` regions on until the name and then its options match; the
    regions used are consumed. One style is one small group."""

    def alike(a: str, b: str) -> float:
        return ratio(a.lower(), b.lower()) if a and b else 0.0

    def one(regions: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        regions = regions.sort_values("roi_idx")
        texts, ids, out, at = regions["ocr_text"].tolist(), regions["roi_idx"].tolist(), [], 0
        for c in wanted.sort_values("contest_ord").itertuples():
            n = len(c.options)
            for start in range(at, min(at + slip + 1, len(texts) - n)):
                scores = [alike(o, t) for o, t in zip(c.options, texts[start + 1 : start + 1 + n], strict=False)]
                if alike(c.contest, texts[start]) >= ACCEPT["contest"] and min(scores, default=1) >= ACCEPT["options"]:
                    out += [(c.style_num, c.contest, o, int(ids[start + 1 + i]), True) for i, o in enumerate(c.options)]
                    at = start + 1 + n
                    break
            else:
                out += [(c.style_num, c.contest, o, -1, False) for o in c.options]
        return pd.DataFrame(out, columns=["style_num", "contest", "option", "roi_idx", "ok"])

    return rois.groupBy("style_num").cogroup(contests.groupBy("style_num")).applyInPandas(one, "style_num string, contest string, option string, roi_idx int, ok boolean")


def read_png(data: bytes) -> np.ndarray:
    """A PNG image (not interlaced, 8 bits or fewer, grey, palette or colour)
    as grey values."""
    pos, chunks, head, palette = 8, [], b"", None
    while pos < len(data):
        n, kind = int.from_bytes(data[pos : pos + 4], "big"), data[pos + 4 : pos + 8]
        body = data[pos + 8 : pos + 8 + n]
        pos += 12 + n
        if kind == b"IHDR":
            head = body
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            chunks.append(body)
    w, h = int.from_bytes(head[:4], "big"), int.from_bytes(head[4:8], "big")
    depth, colour = head[8], head[9]
    if depth > 8 or head[12]:
        raise ValueError("PNG of more than 8 bits, or interlaced")
    bands = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    step, size = max(1, bands * depth // 8), -(-w * bands * depth // 8)
    raw = np.frombuffer(zlib.decompress(b"".join(chunks)), np.uint8).reshape(h, size + 1)
    out = np.zeros((h + 1, size), np.uint8)
    for y in range(h):
        row, up, kind = raw[y, 1:].copy(), out[y], raw[y, 0]
        if kind == 2:
            row += up
        elif kind:  # these lean on the pixel to the left, so go pixel by pixel
            for i in range(size):
                a, b, c = int(row[i - step]) if i >= step else 0, int(up[i]), int(up[i - step]) if i >= step else 0
                p = a + b - c
                row[i] = (int(row[i]) + (a, 0, (a + b) // 2, min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2])[kind - 1]) & 255
        out[y + 1] = row
    grid = out[1:]
    if depth < 8:
        grid = np.unpackbits(grid, axis=1).reshape(h, -1, depth)
        grid = (grid << np.arange(depth - 1, -1, -1, dtype=np.uint8)).sum(axis=2).astype(np.uint8)[:, :w]
        grid = grid if colour == 3 else (grid.astype(int) * 255 // (2**depth - 1)).astype(np.uint8)
    grid = palette[grid.reshape(h, w)] if colour == 3 else grid.reshape(h, w, bands)
    if grid.shape[2] in (1, 2):
        return grid[:, :, 0].copy()
    return (grid[:, :, :3].astype(float) @ [0.299, 0.587, 0.114]).round().astype(np.uint8)


def read_image(data: bytes) -> np.ndarray:
    return read_png(data) if data[:8] == b"\x89PNG\r\n\x1a\n" else read_pbm(data)


def printed_pages(pages: list[np.ndarray], margin: int = 200, light: float = 250) -> list[np.ndarray]:
    """Pages of a scan with print at both side margins; of more than two pages
    the last one is a cover and dropped."""
    pages = pages[:-1] if len(pages) > 2 else pages
    return [p for p in pages if p[:, :margin].mean() < light and p[:, -margin:].mean() < light]


def read_pbm(data: bytes) -> np.ndarray:
    """A binary PBM (P4) or PGM (P5) image as grey values."""
    parts, pos = [], 0
    while len(parts) < (3 if data[:2] == b"P4" else 4):
        while data[pos : pos + 1].isspace():
            pos += 1
        if data[pos : pos + 1] == b"#":
            pos = data.index(b"\n", pos)
            continue
        end = pos
        while not data[end : end + 1].isspace():
            end += 1
        parts.append(data[pos:end])
        pos = end
    w, h = int(parts[1]), int(parts[2])
    raw = np.frombuffer(data, np.uint8, offset=pos + 1)
    if parts[0] == b"P4":
        bits = np.unpackbits(raw.reshape(h, -1), axis=1)[:, :w]
        return np.where(bits == 1, 0, 255).astype(np.uint8)
    return raw[: w * h].reshape(h, w)


def pixel_values(images: DataFrame, targets: DataFrame, limit: int = 170, size: tuple[int, int] = (36, 26)) -> DataFrame:
    """ballot_id, contest, option, pmv: dark pixels in each target's box.
    images: ballot_id, style_num, content (PBM, PGM or PNG); targets: style_num,
    contest, option, x, y. Each image is decoded once."""
    return measured(images.join(target_lists(targets), "style_num"), limit, size)


def target_lists(targets: DataFrame) -> DataFrame:
    """style_num, t: a style's targets, a few hundred at most, as one list."""
    return targets.groupBy("style_num").agg(F.collect_list(F.struct("contest", "option", "x", "y")).alias("t"))


def measured(images: DataFrame, limit: int = 170, size: tuple[int, int] = (36, 26)) -> DataFrame:
    """pixel_values() of images that carry their targets t, in the task that
    has the image."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for b, content, ts in zip(pdf["ballot_id"], pdf["content"], pdf["t"], strict=True):
                img = read_image(content)
                yield pd.DataFrame([(b, t["contest"], t["option"], int((img[t["y"] : t["y"] + size[1], t["x"] : t["x"] + size[0]] <= limit).sum())) for t in ts], columns=["ballot_id", "contest", "option", "pmv"])

    return images.select("ballot_id", "content", "t").mapInPandas(run, "ballot_id string, contest string, option string, pmv int")
