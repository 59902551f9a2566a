"""Figures, tables and charts of papers from layout blocks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import col, joined_or_null

TYPES = ("image", "chart", "table")


def check_types(types: list[str]) -> list[str]:
    """Sorted figure types; an unknown one is an error."""
    unknown = sorted(set(types) - set(TYPES))
    if unknown:
        raise ValueError(f"unknown figure types: {', '.join(unknown)}")
    return sorted(set(types))


def sha_of(path: Column | str) -> Column:
    """The name of an image file without folders and suffix."""
    return F.regexp_replace(F.substring_index(col(path), "/", -1), r"\.[^.]*$", "")


def resolve_path(path: Column | str, root: Column | str) -> Column:
    path = col(path)
    return F.when(path.startswith("/"), path).otherwise(F.concat(col(root), F.lit("/"), path))


def points(bbox: Column | str, low: int, high: int) -> Column:
    """Extent of a box in points, rounded half to even; 0 if it isn't four numbers."""
    b = col(bbox)
    return F.when(F.size(b) == 4, F.bround(F.get(b, F.lit(high)) - F.get(b, F.lit(low))).cast("int")).otherwise(0)


def extract_figures(blocks: DataFrame, types: list[str] | None = None, images: DataFrame | None = None) -> DataFrame:
    """One row per figure: ``paper_id, id, page, page_idx, type, width_pt, height_pt, caption, footnote, source_sha, img_path``.

    Blocks of the given types with an image path, and, if ``images`` (``sha``) is given, an image. Numbered within the
    page among those that are left, in reading order.
    """
    types = check_types(list(types or TYPES))
    kept = blocks.where(F.col("type").isin(types) & (F.col("img_path") != "")).withColumn("source_sha", sha_of("img_path"))
    if images is not None:
        kept = kept.join(images.select(F.col("sha").alias("source_sha")), "source_sha", "left_semi")
    nth = F.row_number().over(Window.partitionBy("paper_id", "page_idx").orderBy("ord"))
    by_type = lambda suffix: F.coalesce(*(F.when(F.col("type") == t, joined_or_null(f"{t}_{suffix}")) for t in types))
    return kept.select(
        "paper_id", F.format_string("page%03d_img%d", F.col("page_idx") + 1, nth).alias("id"), (F.col("page_idx") + 1).alias("page"), "page_idx", "type", "bbox",
        points("bbox", 0, 2).alias("width_pt"), points("bbox", 1, 3).alias("height_pt"), by_type("caption").alias("caption"), by_type("footnote").alias("footnote"), "source_sha", "img_path",
    )


def manifest(figures: DataFrame) -> DataFrame:
    """``paper_id, manifest``: figures of a paper as one JSON document."""
    entry = F.struct(*(c for c in figures.columns if c != "paper_id"))
    return figures.groupBy("paper_id").agg(F.to_json(F.struct(F.count("*").alias("count"), F.array_sort(F.collect_list(entry)).alias("figures"))).alias("manifest"))


def data_url(content: Column | str) -> Column:
    """An image file as a data URL."""
    return F.concat(F.lit("data:image/jpeg;base64,"), F.base64(col(content)))


@F.pandas_udf(T.StructType([T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType())]))
def jpeg_size(content: pd.Series) -> pd.DataFrame:
    """Pixels of JPEG files from their frame headers, a batch at a time; (0, 0) if one can't be read."""
    return pd.DataFrame([_frame(bytes(x or b"")) for x in content], columns=["width", "height"], dtype="int32")


def _frame(data: bytes) -> tuple[int, int]:
    if data[:2] != b"\xff\xd8":
        return 0, 0
    at = 2
    while at + 9 < len(data):
        if data[at] != 0xFF:
            return 0, 0
        mark = data[at + 1]
        if mark == 0xFF:
            at += 1
        elif 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            return int.from_bytes(data[at + 7 : at + 9], "big"), int.from_bytes(data[at + 5 : at + 7], "big")
        else:
            at += 2 + (int.from_bytes(data[at + 2 : at + 4], "big") if not 0xD0 <= mark <= 0xD9 else 0)
    return 0, 0
