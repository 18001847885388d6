"""Media operators: frames, screen text lines, regions, masks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import has_arabic

#: Extensions of the common image types, by content type.
IMAGE_TYPES = {"image/png": ".png", "image/jpeg": ".jpg", "image/jpg": ".jpg", "image/webp": ".webp", "image/gif": ".gif", "image/bmp": ".bmp", "image/tiff": ".tiff"}


#: The kinds of image regions.
REGION_TYPES = ("photo / main image", "banner / horizontal bar", "vertical image", "image block")


def frame_indexes(total: Column, duration: Column, *, least: int = 8, most: int = 60, per_second: float = 1.0) -> Column:
    """Evenly spread frame numbers: clamp(duration * per_second) of them, never more than there are."""
    n = F.least(F.greatest(F.bround(duration * per_second).cast("int"), F.lit(least)), F.lit(most), total.cast("int"))
    at = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.bround(i * (total - 1) / F.greatest(n - 1, F.lit(1))).cast("int"))
    return F.when(total > 0, at).otherwise(F.array().cast("array<int>"))


def decode_data_url(data: Column) -> Column:
    """struct(content, extension) of a base64 data URL; unknown types are .png."""
    kind = F.lower(F.regexp_extract(data, r"^data:([^;,]*)", 1))
    known = F.create_map(*[F.lit(x) for pair in IMAGE_TYPES.items() for x in pair])
    return F.struct(F.unbase64(F.regexp_replace(data, r"^data:[^,]*,", "")).alias("content"), F.coalesce(F.try_element_at(known, kind), F.lit(".png")).alias("extension"))


def blocks_in_regions(blocks: DataFrame, regions: DataFrame, *, image_col: str = "image_id", inside: bool = True) -> DataFrame:
    """Text blocks (image, x, y, w, h) whose centre lies in a region of their image (bounds included), or in none. Blocks and regions of one image meet by an equi join."""
    mid_x, mid_y = F.col("x") + F.col("w") / 2, F.col("y") + F.col("h") / 2
    r = regions.select(F.col(image_col).alias("__i"), *[F.col(c).alias(f"__{c}") for c in ("x", "y", "width", "height")])
    hit = (F.col(image_col) == F.col("__i")) & mid_x.between(F.col("__x"), F.col("__x") + F.col("__width")) & mid_y.between(F.col("__y"), F.col("__y") + F.col("__height"))
    return blocks.join(r, hit, "left_semi" if inside else "left_anti")


def text_lines(blocks: DataFrame, *, image_col: str = "image_id", gap: float = 15.0) -> DataFrame:
    """(image, line, text, rtl): blocks by their top, a new line where the centre moves by more than ``gap``; words run right to left where most blocks of the line are Arabic."""
    mid = F.col("y") + F.col("h") / 2
    by_top = Window.partitionBy(image_col).orderBy("y", "x", "text")
    moved = blocks.withColumn("__c", mid).withColumn("__b", F.coalesce((F.abs(F.col("__c") - F.lag("__c").over(by_top)) > gap).cast("int"), F.lit(0)))
    lined = moved.withColumn("line", F.sum("__b").over(by_top.rowsBetween(Window.unboundedPreceding, 0)))
    word = F.struct("x", "text")
    lines = lined.groupBy(image_col, "line").agg(F.sort_array(F.collect_list(word)).alias("w"), (F.count_if(has_arabic(F.col("text"))) > F.count(F.lit(1)) / 2).alias("rtl"))
    ordered = F.when(F.col("rtl"), F.reverse("w")).otherwise(F.col("w"))
    return lines.select(image_col, F.col("line").cast("int").alias("line"), F.array_join(F.transform(ordered, lambda x: x["text"]), " ").alias("text"), "rtl")


def low_bands(profile: DataFrame, *, by: str, pos_col: str = "pos", value_col: str = "value", below: float, least: int) -> DataFrame:
    """(by, first, last, size): runs of consecutive positions whose value is below the limit, of at least ``least`` positions."""
    low = profile.where(F.col(value_col) < below).withColumn("__g", F.col(pos_col) - F.row_number().over(Window.partitionBy(by).orderBy(pos_col)))
    runs = low.groupBy(by, "__g").agg(F.min(pos_col).alias("first"), F.max(pos_col).alias("last"), F.count(F.lit(1)).alias("size"))
    return runs.where(F.col("size") >= least).drop("__g")


def deviation_profile(pixels: DataFrame, *, by: str, axis: str) -> DataFrame:
    """(by, pos, value): population standard deviation of the pixels' values along each row (axis y) or column (axis x)."""
    return pixels.groupBy(by, F.col(axis).alias("pos")).agg(F.stddev_pop("value").alias("value"))


def region_type(width: Column, height: Column, image_width: Column, image_height: Column) -> Column:
    """The kind of an image region: a photo takes more than a quarter of both sides; others go by their shape."""
    aspect = F.when(height > 0, width / height).otherwise(F.lit(1.0))
    large = (width > 0.25 * image_width) & (height > 0.25 * image_height)
    return F.when(large, REGION_TYPES[0]).when(aspect > 3, REGION_TYPES[1]).when(aspect < 0.4, REGION_TYPES[2]).otherwise(REGION_TYPES[3])


def extraction_summary(blocks: DataFrame, regions: DataFrame, *, image_col: str = "image_id") -> DataFrame:
    """(image, total_text_blocks, total_outside_text, total_image_regions, total_inside_text) of every image that has either."""
    inside = blocks_in_regions(blocks, regions, image_col=image_col, inside=True).groupBy(image_col).agg(F.count(F.lit(1)).alias("total_inside_text"))
    all_blocks = blocks.groupBy(image_col).agg(F.count(F.lit(1)).alias("total_text_blocks"))
    found = regions.groupBy(image_col).agg(F.count(F.lit(1)).alias("total_image_regions"))
    names = ["total_text_blocks", "total_inside_text", "total_image_regions"]
    out = all_blocks.join(inside, image_col, "full").join(found, image_col, "full").fillna(0, names)
    return out.select(image_col, *names, (F.col("total_text_blocks") - F.col("total_inside_text")).alias("total_outside_text"))


def keep_regions(regions: DataFrame, *, image_col: str = "image_id", bucket: int = 30, most: int = 10) -> DataFrame:
    """Regions of 2 % to 95 % of the image, one in each bucket of 30 pixels (the largest), the ``most`` largest of an image."""
    from .ranking import top_rows

    share = F.col("width") * F.col("height") / F.col("image_area")
    good = regions.where(share.between(0.02, 0.95))
    rest = [c for c in regions.columns if c != image_col]
    place = [F.floor(F.col(c) / bucket).alias(f"__{c}") for c in ("x", "y", "width", "height")]
    once = good.groupBy(image_col, *place).agg(F.max_by(F.struct(*rest), F.struct(F.col("width") * F.col("height"), -F.col("x"), -F.col("y"))).alias("r")).select(image_col, *[F.col("r")[c].alias(c) for c in rest])
    return top_rows(once, most, by=[image_col], order=[F.desc(F.col("width") * F.col("height")), F.asc("x"), F.asc("y")]).drop("rank")


def needs_segmentation(p_real: Column, force: Column | None = None) -> Column:
    return (p_real <= 0.85) | (F.coalesce(force, F.lit(False)) if force is not None else F.lit(False))


def mask_regions(masks: DataFrame, *, key: str = "image_id", threshold: float = 0.5, least: int = 100) -> DataFrame:
    """(key, x, y, width, height, area, avg_confidence): connected regions (with diagonals) of a mask's cells above the threshold, of ``least`` cells or more. masks: key, width, cells (row by row)."""
    kind = masks.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, w, cells in zip(pdf[key], pdf["width"], pdf["cells"], strict=True):
                grid = np.asarray(cells, dtype=float).reshape(-1, int(w))
                for ys, xs in _components(grid > threshold):
                    if len(ys) >= least:
                        rows.append((k, xs.min(), ys.min(), xs.max() - xs.min() + 1, ys.max() - ys.min() + 1, len(ys), grid[ys, xs].mean()))
            yield pd.DataFrame(rows, columns=[key, "x", "y", "width", "height", "area", "avg_confidence"])

    return masks.select(key, "width", "cells").mapInPandas(run, f"`{key}` {kind}, x int, y int, width int, height int, area int, avg_confidence double")


def _components(on: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Cells of each 8-connected component, by flooding one after the other."""
    left = on.copy()
    while left.any():
        ys, xs = [], []
        stack = [tuple(np.argwhere(left)[0])]
        left[stack[0]] = False
        while stack:
            y, x = stack.pop()
            ys.append(y)
            xs.append(x)
            for v in range(max(0, y - 1), min(left.shape[0], y + 2)):
                for u in range(max(0, x - 1), min(left.shape[1], x + 2)):
                    if left[v, u]:
                        left[v, u] = False
                        stack.append((v, u))
        yield np.array(ys), np.array(xs)


def mask_summary(masks: DataFrame, *, key: str = "image_id", threshold: float = 0.5) -> DataFrame:
    """(key, coverage_pct, max_confidence, forged) by expressions over the cells."""
    hot = F.size(F.filter("cells", lambda c: c > threshold))
    return masks.select(key, (100.0 * hot / F.size("cells")).alias("coverage_pct"), F.array_max("cells").alias("max_confidence"), (hot > 0).alias("forged"))


def decode_image(content: Column) -> Column:
    """struct(width, height, grey) of a picture, upright, alpha over white; null where it can't be decoded or no imaging library is there."""

    @F.pandas_udf("width int, height int, grey array<double>")
    def run(s: pd.Series) -> pd.DataFrame:
        try:
            from PIL import Image, ImageOps
        except ImportError:
            return pd.DataFrame([(None, None, None)] * len(s), columns=["width", "height", "grey"])
        import io

        rows = []
        for raw in s:
            try:
                picture = ImageOps.exif_transpose(Image.open(io.BytesIO(raw))).convert("RGBA")
                flat = Image.alpha_composite(Image.new("RGBA", picture.size, "white"), picture).convert("L")
                rows.append((*flat.size, np.asarray(flat, dtype=float).ravel().tolist()))
            except Exception:  # a broken file is a null, not a failed job
                rows.append((None, None, None))
        return pd.DataFrame(rows, columns=["width", "height", "grey"])

    return run(content)
