"""Statistics of glyph clusters, and the clusters that stand for a letter of a document."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.vectors import std_of
from .arrays import mean_arrays


def informative(img: Column, least_std: float = 0.01, background: float = 0.05, most_background: float = 0.99) -> Column:
    """Images without NaN that are neither flat nor almost all background."""
    clean = ~F.exists(img, lambda x: F.isnan(x))
    share = F.size(F.filter(img, lambda x: x < background)) / F.size(img)
    return clean & (std_of(img) > least_std) & (share < most_background)


def majority_labels(chars: DataFrame, by: tuple[str, ...] = ("doc", "cluster"), label: str = "label") -> DataFrame:
    """(by, label, share, n): the most frequent label of a cluster, the smallest on ties."""
    counts = chars.groupBy(*by, label).agg(F.count("*").alias("c"))
    first = F.min(F.struct((-F.col("c")).alias("c"), F.col(label).alias("label"))).alias("m")
    return counts.groupBy(*by).agg(first, F.sum("c").alias("n")).select(*by, F.col("m.label").alias("label"), (-F.col("m.c") / F.col("n")).alias("share"), "n")


def mean_images(chars: DataFrame, by: tuple[str, ...] = ("doc", "cluster"), img: str = "img") -> DataFrame:
    """(by, mean): element-wise means, summed a task at a time before they are sent on."""
    return mean_arrays(chars, list(by), img, "mean")


def italic_ratios(chars: DataFrame, by: tuple[str, ...] = ("doc", "cluster"), flag: str = "is_italic") -> DataFrame:
    return chars.groupBy(*by).agg(F.avg(F.col(flag).cast("int")).alias("italic"))


def usable(clusters: DataFrame, least_share: float = 0.6, punctuation: tuple[str, ...] = (".", ",", ";", ":")) -> DataFrame:
    return clusters.filter(~F.col("label").isin(*punctuation) & (F.col("share") >= least_share))


def cluster_table(chars: DataFrame) -> DataFrame:
    """Characters with a cluster to the cluster table."""
    by = ["doc", "cluster"]
    stats = usable(majority_labels(chars.filter(F.col("cluster") >= 0)))
    return stats.join(italic_ratios(chars), by).join(mean_images(chars), by)


def coverage(clusters: DataFrame, by: str = "doc") -> DataFrame:
    """Per document: clusters needed for 90 % of all characters, share of the 10 and 50 largest, median size."""
    order = Window.partitionBy(by).orderBy(F.col("n").desc(), "cluster_id")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = clusters.select(by, "n", F.row_number().over(order).alias("rank"), F.sum("n").over(upto).alias("sum"), F.sum("n").over(Window.partitionBy(by)).alias("all"))
    share = lambda k: F.sum(F.when(F.col("rank") <= k, F.col("n")).otherwise(0)) / F.max("all")
    needed = F.min(F.when(F.col("sum") >= 0.9 * F.col("all"), F.col("rank")))
    return rows.groupBy(by).agg(F.count("*").alias("n_clusters"), needed.alias("for_90"), share(10).alias("top_10"), share(50).alias("top_50"), F.percentile("n", F.lit(0.5)).alias("median_size"))


def letter_frequencies(clusters: DataFrame, top: int = 15) -> DataFrame:
    """The letters with the most clusters; equal counts in alphabetical order."""
    return clusters.groupBy("letter").agg(F.count("*").alias("n_clusters")).orderBy(F.col("n_clusters").desc(), "letter").limit(top)


def italic_candidates(clusters: DataFrame, letters: list[str] | None = None, threshold: float = 0.5) -> DataFrame:
    rows = clusters.filter(F.col("italic") > threshold)
    return rows if letters is None else rows.filter(F.col("letter").isin(*letters))


def representatives(candidates: DataFrame, strategy: str = "median", q: float = 0.25, digits: int | None = None) -> DataFrame:
    """(letter, doc, cluster_id): the cluster that stands for a letter of a document.

    median: least q-quantile of the cosine distances to the letter's candidates in other documents (none: last).
    argmin: most pairs won, where of two candidates the one of the document that comes first wins; on equal
    counts, as on equal quantiles, the smallest cluster_id.
    Distances are matrix products of a strip of a letter's candidates and all of them, a bounded number at a time; no
    pair is a row. The exact quantile looks at every pair of a letter, so this is quadratic in its candidates.
    """
    if strategy == "argmin":
        # all of a document's candidates win against the same ones, those of the documents that come later
        return candidates.groupBy("letter", "doc").agg(F.min("cluster_id").alias("cluster_id"))
    if strategy != "median":
        raise ValueError(f"no strategy {strategy!r}")
    slim = candidates.select("letter", "doc", "cluster_id", F.col("v").cast("array<double>").alias("v"))
    # a strip of the letter's candidates is a task; it meets the letter's vectors, a number of candidates at a time
    strips = slim.withColumn("strip", F.pmod(F.xxhash64("cluster_id"), F.lit(STRIPS)).cast("int"))
    everyone = slim.withColumn("strip", F.explode(F.sequence(F.lit(0), F.lit(STRIPS - 1))))
    out = slim.select("letter", "doc", "cluster_id", F.lit(0.0).alias("worth")).schema
    kinds = to_arrow_schema(out)

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        if not len(a):
            return kinds.empty_table()
        worth = _worths(a, b, q, digits)
        return pa.table([*(a.column(c) for c in ("letter", "doc", "cluster_id")), pa.array(worth)], schema=kinds)

    rows = strips.groupBy("letter", "strip").cogroup(everyone.groupBy("letter", "strip")).applyInArrow(run, out)
    return rows.groupBy("letter", "doc").agg(F.min(F.struct(F.col("worth").alias("w"), "cluster_id")).alias("m")).select("letter", "doc", "m.cluster_id")


#: Strips that a letter's candidates are dealt into, and distances that are held at a time.
STRIPS, HELD = 16, 1 << 22


def _worths(a: pa.Table, b: pa.Table, q: float, digits: int | None) -> np.ndarray:
    """For each row of a the q-quantile of its cosine distances to the rows of b of other documents; inf for none."""
    x, y = (pc.list_flatten(t.column("v")).to_numpy().reshape(len(t), -1) for t in (a, b))
    docs_a, docs_b = (t.column("doc").to_numpy() for t in (a, b))
    size_a, size_b = np.sqrt((x * x).sum(1)), np.sqrt((y * y).sum(1))
    worth = np.full(len(a), np.inf)
    for doc in np.unique(docs_a):
        own, others = np.flatnonzero(docs_a == doc), np.flatnonzero(docs_b != doc)
        if not len(others):
            continue
        far, sizes = y[others].T, size_b[others]
        step = max(1, HELD // len(others))
        for i in range(0, len(own), step):
            rows = own[i : i + step]
            size = size_a[rows, None] * sizes
            d = np.where(size == 0, 1.0, 1 - (x[rows] @ far) / np.where(size == 0, 1, size))
            d = d if digits is None else np.round(d, digits)
            # as Spark's percentile and DuckDB's quantile_cont: between the two nearest ranks
            at = q * (len(others) - 1)
            low, high = int(np.floor(at)), int(np.ceil(at))
            d.partition(sorted({low, high}), axis=1)
            worth[rows] = d[:, low] if low == high else (high - at) * d[:, low] + (at - low) * d[:, high]
    return worth if digits is None else np.round(worth, digits)


def largest_italic(clusters: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(doc, letter, cluster_id): the italic cluster with the most characters."""
    return italic_candidates(clusters, None, threshold).groupBy("doc", "letter").agg(F.min(F.struct((-F.col("n")).alias("n"), "cluster_id")).alias("m")).select("doc", "letter", "m.cluster_id")


def specimen_grid(chosen: DataFrame, documents: list[str]) -> DataFrame:
    """One row a letter, one column a document; a named list of documents bounds the width."""
    return chosen.groupBy("letter").pivot("doc", documents).agg(F.first("cluster_id"))


def histogram(rows: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """(bin, n): equally wide bins from low to high, 0 below, bins + 1 from high on."""
    return rows.filter(F.col(value).isNotNull()).groupBy(F.width_bucket(value, F.lit(low), F.lit(high), F.lit(bins)).alias("bin")).agg(F.count("*").alias("n"))


def diverse_sample(chars: DataFrame, skip: int = 100, most: int = 15) -> DataFrame:
    """The first character of each label that is a letter after the first `skip`, at most `most`, in order."""
    rows = chars.filter((F.col("idx") >= skip) & F.col("label").rlike(r"^\p{L}+$"))
    return rows.groupBy("label").agg(F.min("idx").alias("idx")).orderBy("idx", "label").limit(most)
