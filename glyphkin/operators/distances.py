"""From cluster means to distances between documents, one letter at a time.

Clusters: (doc, cluster_id, letter, share, n, italic, v), v an array of numbers. A distance that does not exist is
an absent row; there is no stand-in value. Pairs are (doc_a < doc_b), so both triangles are one row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..config import Config, Filtering, Styles
from ..functions.vectors import METRICS, cosine_distance, norm
from .arrays import mean_arrays


def style_of(italic: Column, styles: Styles = Styles()) -> Column:
    """roman, italic, or null for clusters between the two."""
    return F.when(italic <= styles.italic_max, F.lit("roman")).when(italic >= styles.italic_min, F.lit("italic"))


def confident(clusters: DataFrame, filtering: Filtering = Filtering()) -> DataFrame:
    """Clusters whose majority label is sure enough and stands for a letter."""
    return clusters.filter((F.col("share") >= filtering.label_confidence_min) & ~F.col("letter").isin(*filtering.excluded_chars))


def top_clusters(clusters: DataFrame, per_letter: int = 5, by: tuple[str, ...] = ("style", "doc", "letter")) -> DataFrame:
    """The largest clusters of each letter of a document; equal sizes: the smallest cluster_id first."""
    order = Window.partitionBy(*by).orderBy(F.col("n").desc(), F.col("cluster_id"))
    return clusters.withColumn("__rank", F.row_number().over(order)).filter(F.col("__rank") <= per_letter).drop("__rank")


def select_clusters(clusters: DataFrame, config: Config = Config()) -> DataFrame:
    """The clusters that take part, with their style."""
    styled = clusters.withColumn("style", style_of(F.col("italic"), config.styles)).filter("style is not null")
    return top_clusters(confident(styled, config.filtering), config.filtering.top_clusters_per_letter)


def covered_letters(selected: DataFrame, documents: DataFrame, minimum: float = 0.33) -> DataFrame:
    """(style, letter, n_docs) for letters that enough of all documents have, empty ones included."""
    total = documents.select(F.countDistinct("doc").alias("total"))
    held = selected.groupBy("style", "letter").agg(F.countDistinct("doc").alias("n_docs"))
    # one row, the count of documents
    return held.join(F.broadcast(total)).filter(F.col("n_docs") >= F.col("total") * minimum).drop("total")


#: Documents in a block of a letter; a pair of blocks is a tile, the unit of pairwise work.
TILE_DOCUMENTS = 1024


def tiled(rows: DataFrame, by: list[str], documents: int = TILE_DOCUMENTS) -> tuple[DataFrame, DataFrame]:
    """The rows twice, with the tiles (row, col) of their key in which their document stands on the left or the right.

    A key's documents are dealt into blocks by hash. Any two documents meet once in each order, in the tile of their
    blocks, and all rows of a document are in the same block.
    """
    count = rows.groupBy(*by).agg(F.ceil(F.countDistinct("doc") / documents).cast("int").alias("blocks"))
    dealt = rows.join(count, by).withColumn("mine", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    names = [c for c in dealt.columns if c not in ("mine", "other")]
    # columns of their own on each side, as both come from one plan
    return tuple(dealt.select(*(F.col(c).alias(c) for c in names), F.col(x).alias("row"), F.col(y).alias("col")) for x, y in (("mine", "other"), ("other", "mine")))


def cluster_pairs(selected: DataFrame, metric: str = "cosine") -> DataFrame:
    """(style, letter, doc_a, doc_b, ca, cb, d) for clusters of the same letter in different documents.

    A join on tiles with only what distances need; norms are computed once a cluster. This gives every pair as a row:
    least_distances gives what the analysis needs without them.
    """
    slim = selected.select("style", "letter", "doc", "cluster_id", "v", norm(F.col("v")).alias("size"))
    a, b = (x.alias(n) for x, n in zip(tiled(slim, ["style", "letter"]), "ab"))
    on = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("style", "letter", "row", "col")] + [F.col("a.doc") < F.col("b.doc")]
    d = cosine_distance(F.col("a.v"), F.col("b.v"), F.col("a.size"), F.col("b.size")) if metric == "cosine" else METRICS[metric](F.col("a.v"), F.col("b.v"))
    names = [F.col("a.style"), F.col("a.letter"), F.col("a.doc").alias("doc_a"), F.col("b.doc").alias("doc_b"), F.col("a.cluster_id").alias("ca"), F.col("b.cluster_id").alias("cb")]
    return a.join(b, on).select(*names, d.alias("d"))


def document_distances(pairs: DataFrame, digits: int | None = None) -> DataFrame:
    """(style, letter, doc_a, doc_b, dist, ca, cb): the least distance of each pair and the clusters that have it.

    digits rounds distances before the least is taken, so that equal results don't depend on the order of sums.
    """
    d = F.col("d") if digits is None else F.round("d", digits)
    return pairs.groupBy("style", "letter", "doc_a", "doc_b").agg(F.min(F.struct(d.alias("d"), "ca", "cb")).alias("m")).select("style", "letter", "doc_a", "doc_b", F.col("m.d").alias("dist"), "m.ca", "m.cb")


#: Clusters of the left side whose distances to all of the right are held at a time.
STRIP = 256


def _all_distances(x: np.ndarray, y: np.ndarray, metric: str) -> np.ndarray:
    """Distances of all rows of x to all of y, as the column functions of the same names define them."""
    if metric == "euclidean":
        out = np.empty((len(x), len(y)))
        for i, row in enumerate(x):
            out[i] = np.sqrt(((y - row) ** 2).sum(1))
        return out
    if metric == "correlation":
        x, y = x - x.mean(1, keepdims=True), y - y.mean(1, keepdims=True)
    size = np.sqrt((x * x).sum(1))[:, None] * np.sqrt((y * y).sum(1))
    return np.where(size == 0, 1.0, 1 - (x @ y.T) / np.where(size == 0, 1, size))


def _least_of_tile(a: pa.Table, b: pa.Table, metric: str, digits: int | None) -> pa.Table:
    """The least distance of each pair of documents of a tile, with its clusters; of equal ones the smallest ids."""
    a, b = (t.sort_by([("doc", "ascending"), ("cluster_id", "ascending")]) for t in (a, b))
    x, y = (t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(t), -1) for t in (a, b))
    docs_a, docs_b = (np.array(t.column("doc").to_pylist(), object) for t in (a, b))
    starts = np.flatnonzero(np.append(True, docs_b[1:] != docs_b[:-1]))
    of_b = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(b))))
    edges = np.append(np.flatnonzero(np.append(True, docs_a[1:] != docs_a[:-1])), len(a))
    found = []
    i = 0
    while i < len(edges) - 1:
        j = max(i + 1, int(np.searchsorted(edges, edges[i] + STRIP, side="right")) - 1)
        low, high = edges[i], edges[j]
        d = _all_distances(x[low:high], y, metric)
        d = d if digits is None else np.round(d, digits)
        first = edges[i:j] - low
        of_a = np.repeat(np.arange(j - i), np.diff(np.append(first, high - low)))
        least = np.minimum.reduceat(np.minimum.reduceat(d, first, axis=0), starts, axis=1)
        p, q = np.nonzero((d == least[of_a][:, of_b]) & (docs_a[low:high, None] < docs_b[None, :]))
        # in order of both ids, so the first of a pair is the one to keep
        _, at = np.unique(of_a[p] * len(starts) + of_b[q], return_index=True)
        found.append((low + p[at], q[at], d[p[at], q[at]]))
        i = j
    p, q, d = (np.concatenate(z) for z in zip(*found))
    side = [a.select(["style", "letter"]).take(p), a.select(["doc", "cluster_id"]).take(p), b.select(["doc", "cluster_id"]).take(q)]
    return pa.table([*side[0].columns, side[1].column(0), side[2].column(0), pa.array(d), side[1].column(1), side[2].column(1)], names=["style", "letter", "doc_a", "doc_b", "dist", "ca", "cb"])


def least_distances(selected: DataFrame, metric: str = "cosine", digits: int | None = None) -> DataFrame:
    """What document_distances(cluster_pairs(selected)) gives, by matrix products a tile: no pair of clusters is a row.

    A tile is a task of at most 1024 documents a side; their number grows with the square of a letter's documents.
    Vectors of one letter are of one length.
    """
    if metric not in METRICS:
        raise ValueError(f"no metric {metric!r}")
    slim = selected.select("style", "letter", "doc", "cluster_id", F.col("v").cast("array<double>").alias("v"))
    sides = tiled(slim, ["style", "letter"])
    left, right = (x.groupBy("style", "letter", "row", "col") for x in sides)
    out = sides[0].select("style", "letter", F.col("doc").alias("doc_a"), F.col("doc").alias("doc_b"), F.lit(0.0).alias("dist"), F.col("cluster_id").alias("ca"), F.col("cluster_id").alias("cb")).schema
    none = to_arrow_schema(out).empty_table()

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        # a block may be empty
        return _least_of_tile(a, b, metric, digits) if len(a) and len(b) else none

    return left.cogroup(right).applyInArrow(run, out)


def without_zero_letters(distances: DataFrame) -> DataFrame:
    """Without letters whose distances are all zero."""
    some = distances.groupBy("style", "letter").agg(F.max("dist").alias("top")).filter("top > 0").select("style", "letter")
    return distances.join(some, ["style", "letter"], "left_semi")


def with_diagonal(distances: DataFrame) -> DataFrame:
    """Both triangles, and a zero for each document that has the letter's distance to any other."""
    both = distances.select("style", "letter", "doc_a", "doc_b", "dist").unionByName(distances.select("style", "letter", F.col("doc_b").alias("doc_a"), F.col("doc_a").alias("doc_b"), "dist"))
    own = both.select("style", "letter", "doc_a").distinct()
    return both.unionByName(own.select("style", "letter", "doc_a", F.col("doc_a").alias("doc_b"), F.lit(0.0).alias("dist")))


def mean_distances(distances: DataFrame) -> DataFrame:
    """(style, doc_a, doc_b, mean): over all letters of the style, a missing pair counts twice the letter's largest.

    Pairs that share no letter are absent rows; they all have the mean of these doubled largest distances.
    """
    tops = distances.groupBy("style", "letter").agg((2 * F.max("dist")).alias("absent"))
    sums = tops.groupBy("style").agg(F.sum("absent").alias("all_absent"), F.count("*").alias("letters"))
    held = distances.join(tops, ["style", "letter"]).groupBy("style", "doc_a", "doc_b").agg(F.sum(F.col("dist") - F.col("absent")).alias("gain"))
    return held.join(sums, "style").select("style", "doc_a", "doc_b", ((F.col("all_absent") + F.col("gain")) / F.col("letters")).alias("mean"))


def coverage_report(selected: DataFrame, documents: DataFrame, minimum: float = 0.33) -> DataFrame:
    """(style, letter, n_docs, needed, kept) for every letter."""
    total = documents.select(F.countDistinct("doc").alias("total"))
    held = selected.groupBy("style", "letter").agg(F.countDistinct("doc").alias("n_docs"))
    needed = F.ceil(F.col("total") * minimum)
    return held.join(F.broadcast(total)).select("style", "letter", "n_docs", needed.alias("needed"), (F.col("n_docs") >= F.col("total") * minimum).alias("kept"))


def compute_distances(clusters: DataFrame, config: Config = Config(), register: Callable[[DataFrame], DataFrame] | None = None, digits: int | None = None) -> DataFrame:
    """Clusters to document distances: selection, coverage, registration if given, pairs, least per pair."""
    chosen = select_clusters(clusters, config)
    letters = covered_letters(chosen, clusters.select("doc").distinct(), config.filtering.min_doc_coverage)
    chosen = chosen.join(letters.select("style", "letter"), ["style", "letter"], "left_semi")
    if register is not None:
        chosen = register(chosen)
    return without_zero_letters(least_distances(chosen, config.distance, digits))


def registered_to_mean(selected: DataFrame, transform: str = "euclidean", shape: tuple[int, int] = (40, 32)) -> DataFrame:
    """Every cluster image registered to the mean image of its style and letter.

    Two passes: the means are summed a task at a time and joined back; each image is then registered alone in Arrow
    batches, so no letter is gathered in one task.
    """
    from ..functions.registration import register_to

    rows = selected.join(mean_arrays(selected, ["style", "letter"], "v", "ref"), ["style", "letter"])

    @F.pandas_udf("array<double>")
    def moved(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for v, ref in batches:
            yield pd.Series([register_to(np.asarray(x, float).reshape(shape), np.asarray(r, float).reshape(shape), transform).ravel().tolist() for x, r in zip(v, ref)])

    return rows.withColumn("v", moved("v", "ref")).drop("ref")
