"""Checks of the stored tables: each returns one row for every broken rule, none for a sound table."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, functions as F

from ..schemas import IMAGE_SIZE


def broken(rows: DataFrame, key: list[str], rules: dict[str, Column]) -> DataFrame:
    """(key, error): a rule is a condition that must hold; null counts as broken."""
    errors = F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items())))
    return rows.select(*key, F.explode(errors).alias("error"))


def check_words(words: DataFrame, key: list[str]) -> DataFrame:
    """Boxes of words and characters have four sides."""
    chars = F.coalesce(F.forall("chars", lambda c: F.coalesce(F.size(c["tblr"]) == 4, F.lit(False))), F.lit(True))
    return broken(words, key, {"word: tblr": F.size("tblr") == 4, "char: tblr": chars})


def check_chars(chars: DataFrame, key: list[str], size: int = IMAGE_SIZE) -> DataFrame:
    return broken(chars, key, {"img: size": F.size("img") == size, "label: missing": F.col("label").isNotNull(), "word_idx: missing": F.col("word_idx") >= 0})


def check_italic(documents: DataFrame, chars: DataFrame, flags: DataFrame) -> DataFrame:
    """Every document has a threshold, and a flag for each character."""
    n = chars.groupBy("doc").agg(F.count("*").alias("chars"))
    m = flags.groupBy("doc").agg(F.count("is_italic").alias("flags"))
    rows = n.join(m, "doc", "left").join(documents.select("doc", "threshold"), "doc", "left")
    return broken(rows, ["doc"], {"threshold: missing": F.col("threshold").isNotNull(), "flags: count": F.col("chars") == F.coalesce("flags", F.lit(0))})


def check_clusters(clusters: DataFrame, size: int = IMAGE_SIZE, least_share: float = 0.6) -> DataFrame:
    rules = {"mean: size": F.size("mean") == size, "italic: range": F.col("italic").between(0, 1), "share: range": F.col("share").between(least_share, 1), "n: positive": F.col("n") > 0}
    return broken(clusters, ["doc", "cluster_id"], rules)


def report(documents: DataFrame, parts: dict[str, DataFrame], errors: dict[str, DataFrame]) -> DataFrame:
    """(doc, part, status, n_errors): ok, errors, or missing for each document and part."""
    out = []
    for name, rows in parts.items():
        there = rows.select("doc").distinct().withColumn("there", F.lit(True))
        bad = errors[name].groupBy("doc").agg(F.count("*").alias("n_errors"))
        one = documents.select("doc").distinct().join(there, "doc", "left").join(bad, "doc", "left")
        status = F.when(F.col("there").isNull(), "missing").when(F.col("n_errors") > 0, "errors").otherwise("ok")
        out.append(one.select("doc", F.lit(name).alias("part"), status.alias("status"), F.coalesce("n_errors", F.lit(0)).alias("n_errors")))
    return functools.reduce(DataFrame.unionByName, out)
