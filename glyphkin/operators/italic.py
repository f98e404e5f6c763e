"""Which words and characters are italic, from the direction of their strokes.

Words: (doc, page, word_idx, t, b, l, r, text, stroke); stroke is null, NaN or -360 where it could not be measured.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.stats import otsu_thresholds

UNDEFINED = -360.0


def measured(stroke: Column) -> Column:
    return F.coalesce((stroke != UNDEFINED) & ~F.isnan(stroke), F.lit(False))


def thresholds(words: DataFrame, least: int = 10) -> DataFrame:
    """(doc, threshold, n_valid_strokes, q85, q90, q95, otsu) for documents with enough measured strokes.

    The histogram threshold, or the 0.9 quantile where it lies outside of [q85, q95).
    """
    good = words.filter(measured(F.col("stroke"))).select("doc", F.col("stroke").cast("double").alias("stroke"))
    at = good.groupBy("doc").agg(F.count("*").alias("n_valid_strokes"), F.percentile("stroke", F.array(F.lit(0.85), F.lit(0.9), F.lit(0.95))).alias("q")).filter(F.col("n_valid_strokes") >= least)
    at = at.select("doc", "n_valid_strokes", *(F.get("q", F.lit(i)).alias(n) for i, n in enumerate(("q85", "q90", "q95"))))
    rows = at.join(otsu_thresholds(good, "doc", "stroke"), "doc")
    inside = (F.col("otsu") >= F.col("q85")) & (F.col("otsu") < F.col("q95"))
    return rows.withColumn("threshold", F.when(inside, F.col("otsu")).otherwise(F.col("q90")))


def complicated(stroke: Column, text: Column, threshold: Column) -> Column:
    """Words to be judged by their neighbours: not measured, or slanted and with letters that slant anyway."""
    return ~measured(stroke) | ((stroke >= threshold) & F.coalesce(F.lower(text).rlike("[zyf]"), F.lit(False)))


def side_neighbours(words: DataFrame, k: int = 2, radius: float = 200, y_tolerance: float = 0.5, side_tolerance: float = 10, of: Column | None = None) -> DataFrame:
    """(doc, page, word_idx, other_idx, gap, rank): the nearest words on the same line, left or right.

    Words of one page in one place, of which there may be any number, have the same neighbours but for themselves: what
    is paired is places, by an equi-join on page and cells of `radius` side, each place looked up in the nine around
    it, and of the words in a place the k + 1 of the lowest numbers can be among the nearest. A page's words have
    different numbers. of: which words to find neighbours for.
    """
    place = ["doc", "page", "t", "b", "l", "r"]
    slim = words.select(*place, "word_idx", (F.lit(True) if of is None else of).alias("asked"))
    places = slim.groupBy(*place).agg(F.bool_or("asked").alias("asked"))
    places = places.withColumn("cx", (F.col("l") + F.col("r")) / 2).withColumn("cy", (F.col("t") + F.col("b")) / 2)
    lowest = Window.partitionBy(*place).orderBy("word_idx")
    members = slim.select(*place, "word_idx", F.row_number().over(lowest).alias("n")).filter(F.col("n") <= k + 1)
    theirs = {"t": "t2", "b": "b2", "l": "l2", "r": "r2"}
    members = members.select("doc", "page", *(F.col(c).alias(n) for c, n in theirs.items()), F.col("word_idx").alias("other_idx"))
    cell = lambda c: F.floor(F.col(c) / radius)
    right = places.select("doc", "page", cell("cx").alias("gx"), cell("cy").alias("gy"), *(F.col(c).alias(n) for c, n in theirs.items()), F.col("cx").alias("cx2"), F.col("cy").alias("cy2"))
    steps = F.array(F.lit(-1), F.lit(0), F.lit(1))
    left = places.filter("asked").withColumn("dx", F.explode(steps)).withColumn("dy", F.explode(steps))
    left = left.withColumn("gx", cell("cx") + F.col("dx")).withColumn("gy", cell("cy") + F.col("dy"))
    gap = F.least(F.abs(F.col("r") - F.col("l2")), F.abs(F.col("l") - F.col("r2")))
    near = (F.col("cx2") - F.col("cx")) ** 2 + (F.col("cy2") - F.col("cy")) ** 2 <= radius**2
    rows = left.join(right, ["doc", "page", "gx", "gy"]).filter(near & (F.abs(F.col("cy2") - F.col("cy")) < y_tolerance * (F.col("b") - F.col("t"))))
    rows = rows.withColumn("gap", gap).filter(F.col("gap") < side_tolerance)
    # one more than asked for: a word that is in reach of its own place is passed over below
    first = Window.partitionBy(*place).orderBy("gap", "other_idx")
    found = rows.join(members, ["doc", "page", *theirs.values()]).select(*place, "other_idx", "gap", F.row_number().over(first).alias("n")).filter(F.col("n") <= k + 1)
    found = found.groupBy(*place).agg(F.array_sort(F.collect_list(F.struct("gap", "other_idx"))).alias("found"))
    rows = slim.filter("asked").join(found, place)
    others = F.slice(F.filter("found", lambda x: x["other_idx"] != F.col("word_idx")), 1, k)
    rows = rows.select("doc", "page", "word_idx", F.posexplode(others).alias("rank", "x"))
    return rows.select("doc", "page", "word_idx", "x.other_idx", F.col("x.gap").cast("double").alias("gap"), (F.col("rank") + 1).alias("rank"))


def effective_strokes(words: DataFrame, doc_thresholds: DataFrame, **neighbour_options) -> DataFrame:
    """(doc, page, word_idx, stroke, threshold, complicated, effective): complicated words take the largest stroke of
    those of their two nearest neighbours that are not complicated; without any they keep their own."""
    key = ["doc", "page", "word_idx"]
    rows = words.join(doc_thresholds.select("doc", "threshold"), "doc").withColumn("complicated", complicated(F.col("stroke"), F.col("text"), F.col("threshold")))
    near = side_neighbours(rows, of=F.col("complicated"), **neighbour_options)
    good = rows.filter(~F.col("complicated")).select("doc", "page", F.col("word_idx").alias("other_idx"), F.col("stroke").alias("other_stroke"))
    best = near.join(good, ["doc", "page", "other_idx"]).groupBy(*key).agg(F.max("other_stroke").alias("lent"))
    return rows.join(best, key, "left").select(*key, "stroke", "threshold", "complicated", F.coalesce("lent", "stroke").alias("effective"))


def italic_words(effective: DataFrame) -> DataFrame:
    slanted = ~F.isnan("effective") & (F.col("effective") >= F.col("threshold"))
    return effective.withColumn("is_italic", F.coalesce(slanted, F.lit(False)))


def italic_chars(chars: DataFrame, words: DataFrame) -> DataFrame:
    """Every character with its word's flag; false for a word that is not there."""
    flags = words.select("doc", "page", "word_idx", "is_italic")
    return chars.join(flags, ["doc", "page", "word_idx"], "left").withColumn("is_italic", F.coalesce("is_italic", F.lit(False)))


def page_counts(chars: DataFrame) -> DataFrame:
    return chars.groupBy("doc", "page").agg(F.count("*").alias("n_chars"), F.count_if("is_italic").alias("n_italic"))
