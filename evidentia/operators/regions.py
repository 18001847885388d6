"""Image regions of screenshots: grey pictures as arrays of numbers, one picture a row, in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .media import _components, region_type

#: Least squared difference from the blurred picture, side of the blur and of the closing, limits of bars of the user interface.
VARIANCE, BLUR, CLOSE, BAR_DEVIATION, BAR_ROWS, BAR_SHARE = 8.0, 21, 40, 18.0, 4, 0.015
#: Least side of a part of a collage, seams, limits of a region's share, and rows that end the growth of a region.
LEAST_SIDE, SEAM_DEVIATION, SEAM_THICKNESS, LEAST_SHARE, MOST_SHARE, FLAT, DARK, DARK_FLAT, BUCKET, REGIONS_MOST = 80, 8.0, 1, 0.02, 0.95, 4.0, 30.0, 6.0, 30, 10


def difference_map(grey: np.ndarray, size: int = BLUR) -> np.ndarray:
    """Squared difference of each cell from a Gaussian blur, whose deviation follows from its size; edges are mirrored."""
    sigma = 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    kernel = np.exp(-0.5 * (np.arange(size) - size // 2) ** 2 / sigma**2)
    kernel /= kernel.sum()
    out = grey.astype(float)
    for axis in (0, 1):
        pad = [(0, 0), (0, 0)]
        pad[axis] = (size // 2, size // 2)
        wide = np.pad(out, pad, mode="reflect" if out.shape[axis] > size // 2 else "edge")
        out = sum(w * np.take(wide, range(i, i + out.shape[axis]), axis=axis) for i, w in enumerate(kernel))
    return (grey - np.round(out)) ** 2


def _spread(on: np.ndarray, size: int, grow: bool) -> np.ndarray:
    """Dilation (grow) or erosion by a square, by running sums along both axes."""
    out = on if grow else ~on
    for axis in (0, 1):
        n = out.shape[axis]
        s = np.pad(np.moveaxis(out, axis, 0).astype(int).cumsum(0), ((1, 0), (0, 0)))
        at = np.arange(n)
        hit = s[np.minimum(at + size // 2 + 1, n)] - s[np.maximum(at - size // 2, 0)] > 0
        out = np.moveaxis(hit, 0, axis)
    return out if grow else ~out


def low_runs(profile: np.ndarray, below: float, thickness: int) -> list[tuple[int, int]]:
    """[start, end) of runs below the limit, of the thickness at least."""
    edge = np.diff(np.concatenate([[0], (profile < below).astype(int), [0]]))
    return [(s, e) for s, e in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True) if e - s >= thickness]


def _cuts(profile: np.ndarray) -> list[tuple[int, int]]:
    """The parts of the least side or more between the middles of the seams; seams at the edges cut nothing."""
    n = len(profile)
    middles = [(s + e) // 2 for s, e in low_runs(profile, SEAM_DEVIATION, SEAM_THICKNESS) if s > 0 and e < n]
    edges = sorted({0, *middles, n})
    return [(s, e) for s, e in zip(edges[:-1], edges[1:], strict=True) if e - s >= LEAST_SIDE]


def split_collage(grey: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(x, y, width, height) of the pictures of a collage: rows cut at seams, then each row's columns; the whole where nothing is left."""
    parts = [(x0, y0, x1 - x0, y1 - y0) for y0, y1 in _cuts(grey.std(axis=1)) for x0, x1 in _cuts(grey[y0:y1].std(axis=0))]
    return parts or [(0, 0, grey.shape[1], grey.shape[0])]


def interface_rows(grey: np.ndarray) -> np.ndarray:
    """Whether each row lies in a bar of one colour, as headers and tool bars are."""
    out = np.zeros(len(grey), dtype=bool)
    for s, e in low_runs(grey.std(axis=1), BAR_DEVIATION, max(BAR_ROWS, int(len(grey) * BAR_SHARE))):
        out[s:e] = True
    return out


def _grown(grey: np.ndarray, bar: np.ndarray, x: int, y: int, w: int, h: int) -> tuple[int, int]:
    """First row and the row after the last of a box that grows up and down until a bar, a flat row or a dark one."""
    strip = grey[:, x : x + w]
    mean, dev = strip.mean(axis=1), strip.std(axis=1)
    ends = bar | (dev < FLAT) | ((mean < DARK) & (dev < DARK_FLAT))
    up, down = np.flatnonzero(ends[:y]), np.flatnonzero(ends[y + h :])
    return int(up[-1]) + 1 if len(up) else 0, y + h + int(down[0]) if len(down) else len(grey)


def picture_boxes(grey: np.ndarray, text_boxes: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """The boxes of what varies like a picture outside text and bars, grown to the picture's edges, the largest ten.

    What differs from its blur is closed and opened by squares; a component's box counts if it takes 2 %
    to 95 % of the picture, its middle is in no bar, and no other lies in the same bucket of 30 pixels.
    """
    rows, cols = grey.shape
    pad = max(10, min(rows, cols) // 50)
    bar = interface_rows(grey)
    on = difference_map(grey) > VARIANCE
    on[bar] = False
    for x, y, w, h in text_boxes:
        on[max(0, y - pad) : y + h + pad, max(0, x - pad) : x + w + pad] = False
    closed = _spread(_spread(on, CLOSE, True), CLOSE, False)
    opened = _spread(_spread(closed, CLOSE, False), CLOSE, True)
    out, seen = [], set()
    for ys, xs in _components(opened):
        x, y, w, h = int(xs.min()), int(ys.min()), int(np.ptp(xs)) + 1, int(np.ptp(ys)) + 1
        place = (x // BUCKET, y // BUCKET, w // BUCKET, h // BUCKET)
        if not LEAST_SHARE * grey.size <= w * h <= MOST_SHARE * grey.size or bar[y + h // 2] or place in seen:
            continue
        seen.add(place)
        top, bottom = _grown(grey, bar, x, y, w, h)
        out.append((x, top, w, bottom - top))
    return sorted(out, key=lambda b: -b[2] * b[3])[:REGIONS_MOST]


def detect_regions(pictures: DataFrame, *, key: str = "image_id", split: bool = True) -> DataFrame:
    """(key, x, y, width, height, image_area, type) of pictures (key, width, cells row by row, boxes of text as array<struct<x, y, w, h>>)."""
    kind = pictures.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, w, cells, boxes in zip(pdf[key], pdf["width"], pdf["cells"], pdf["boxes"], strict=True):
                grey = np.asarray(cells, dtype=float).reshape(-1, int(w))
                for x, y, bw, bh in picture_boxes(grey, [(b["x"], b["y"], b["w"], b["h"]) for b in boxes]):
                    for px, py, pw, ph in split_collage(grey[y : y + bh, x : x + bw]) if split else [(0, 0, bw, bh)]:
                        rows.append((k, x + px, y + py, pw, ph, grey.size, grey.shape[1]))
            yield pd.DataFrame(rows, columns=[key, "x", "y", "width", "height", "image_area", "image_width"])

    found = pictures.select(key, "width", "cells", "boxes").mapInPandas(run, f"`{key}` {kind}, x int, y int, width int, height int, image_area int, image_width int")
    kinds = region_type(F.col("width"), F.col("height"), F.col("image_width"), F.col("image_area") / F.col("image_width"))
    return found.withColumn("type", kinds).drop("image_width")
