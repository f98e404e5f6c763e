"""From a detector's grids to words: thresholds, boxes, suppression, assignment of characters, text."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..functions.geometry import cell_box, polygon_box, rotated_corners, rounded_into
from ..functions.vectors import argmax
from .glyphs import suppressed, suppressed_with_classes
from .spatial import cells_kept, chars_to_words


@dataclass(frozen=True)
class Detector:
    word_min: float = 0.95
    char_min: float = 0.25
    word_overlap: float = 0.15
    char_overlap: float = 0.3
    stride: float = 4.0


def cell_polygons(cells: DataFrame, stride: float, angle: str | None = None) -> DataFrame:
    """With `polygon`: the box that each cell predicts, turned by its angle about the cell.

    cells: (…, x, y, t, b, l, r, scale_x, scale_y), distances to the sides in cells.
    """
    box = cell_box(*(F.col(c) for c in ("x", "y", "t", "b", "l", "r", "scale_x", "scale_y")), stride)
    turn = F.col(angle) if angle else F.lit(0.0)
    return cells.withColumn("polygon", rotated_corners(*(box[c] for c in ("x1", "y1", "x2", "y2")), turn, box["cx"], box["cy"]))


def detect_words(words: DataFrame, chars: DataFrame, labels: DataFrame, key: list[str] = ["doc", "page"], detector: Detector = Detector()) -> DataFrame:  # noqa: B006
    """(key, word_idx, tblr, polygon, text, text_score, word_bbox_score, chars) for words that have characters.

    words: (key, x, y, score, t, b, l, r, angle, scale_x, scale_y, width, height); chars the same with `classes`
    (array of scores) and without angle; labels: (id, char), one row a class. Words are numbered by falling score.
    """
    size = words.select(*key, "width", "height").distinct()
    numbered = lambda df: df.withColumn("idx", F.col("y").cast("long") * (1 << 20) + F.col("x").cast("long"))
    w = numbered(cell_polygons(words.filter(F.col("score") > detector.word_min), detector.stride, "angle"))
    c = numbered(cell_polygons(cells_kept(words, chars, key, detector.word_min, detector.char_min), detector.stride))
    hold = lambda df: df.join(size, key).withColumn("polygon", rounded_into(F.col("polygon"), F.col("width"), F.col("height"))).drop("width", "height")
    w = hold(suppressed(w, key, detector.word_overlap, least=1)).withColumnRenamed("idx", "word_idx")
    c = hold(suppressed_with_classes(c, key, detector.char_overlap, least=1)).withColumnRenamed("idx", "char_idx")
    placed = chars_to_words(c, w, key).select(*key, "char_idx", "word_idx")
    best = argmax(F.col("classes"))
    named = c.join(placed, [*key, "char_idx"]).withColumn("id", best).withColumn("best", F.array_max("classes")).join(labels.select("id", F.col("char").alias("label")), "id")
    middle = (F.get("polygon", F.lit(0)) + F.get("polygon", F.lit(2)) + F.get("polygon", F.lit(4)) + F.get("polygon", F.lit(6))) / 4
    sides = polygon_box(F.col("polygon"))
    tblr = F.array(sides["t"], sides["b"], sides["l"], sides["r"])
    one = F.struct(middle.alias("cx"), "char_idx", "label", "best", tblr.alias("tblr"), "polygon")
    text = named.groupBy(*key, "word_idx").agg(F.array_sort(F.collect_list(one)).alias("c"))
    text = text.select(*key, "word_idx", F.array_join("c.label", "").alias("text"), F.aggregate("c.best", F.lit(0.0), lambda s, x: s + x, lambda s: s / F.size("c")).alias("text_score"), F.transform("c", lambda x: F.struct(x["label"].alias("label"), x["best"].alias("score"), x["tblr"].alias("tblr"), x["polygon"].alias("polygon"))).alias("chars"))
    return w.join(text, [*key, "word_idx"]).select(*key, "word_idx", tblr.alias("tblr"), "polygon", "text", "text_score", F.col("score").alias("word_bbox_score"), "chars")
