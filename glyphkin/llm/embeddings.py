"""Operator 2: embedding near-duplicates by int8 tile products with rigorous error bounds.

Vectors are compared only within one label. Equal vectors are one class with a weight. The classes of a label are
dealt into blocks, and each pair of blocks is a tile. In a tile, normalised vectors x are rounded to int8 values q
with a scale s of their own; with e = x - s q the product of two vectors differs from that of their roundings by at
most |s q||e'| + |e||x'|, all of which is known exactly for each vector. Only pairs that may lie above the threshold
within this bound are computed in double precision from the vectors as given. A tile returns, for each vector, the
number of its links and one edge of a spanning forest, never its pairs.

Vectors that are null, zero, or hold null or non-finite components link with nothing, as do those without a label.
Vectors of different lengths don't link. Ids should be unique: rows with one id are one vertex with the links of
both. A null id gets links of its vector but is in no component (null component, not kept).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import table
from .components import components

THRESHOLD = 0.93
BLOCK = 4096
STRIP = 512


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 values, scales, and bounds on the length of what rounding took off each row."""
    scale = np.abs(x).max(1) / 127
    q = np.rint(x / scale[:, None])
    error = np.sqrt(((x - q * scale[:, None]) ** 2).sum(1)) * (1 + 1e-9) + 1e-12
    return q.astype(np.int8), scale, error


class Union:
    """Union-find over 0..n-1 by whole arrays."""

    def __init__(self, n: int) -> None:
        self.parent = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            ra, rb = self.parent[a], self.parent[b]
            differ = ra != rb
            if not differ.any():
                return
            a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
            np.minimum.at(self.parent, np.maximum(ra, rb), np.minimum(ra, rb))
            while True:
                up = self.parent[self.parent]
                if (up == self.parent).all():
                    break
                self.parent = up


def linked_pairs(x: np.ndarray, y: np.ndarray, threshold: float, candidates: list | None = None):
    """Yields (i, j) arrays of the rows of x and y whose cosine is at least the threshold.

    x, y: double precision, finite, not zero. candidates: gets the number of pairs computed in full, if given.
    """
    nx, ny = np.sqrt((x * x).sum(1)), np.sqrt((y * y).sum(1))
    ux, uy = x / nx[:, None], y / ny[:, None]
    (qx, sx, ex), (qy, sy, ey) = quantise(ux), quantise(uy)
    # int8 products are exact in float32 below 2**24
    kind = np.float32 if x.shape[1] * 127 * 127 < 1 << 24 else np.float64
    length = np.sqrt(((qx * sx[:, None]) ** 2).sum(1)) * (1 + 1e-9)
    wide = np.ascontiguousarray(qy.T.astype(kind))
    # threshold - |s q||e'| - |e||x'|, with slack for the rounding of these few operations themselves
    for i in range(0, len(x), STRIP):
        rows = slice(i, i + STRIP)
        near = (qx[rows].astype(kind) @ wide) * sx[rows, None].astype(np.float64) * sy
        near += length[rows, None] * ey + (ex[rows, None] * (1 + 1e-9) + 1e-9)
        a, b = np.nonzero(near >= threshold)
        if candidates is not None:
            candidates.append(len(a))
        if len(a) * 8 > near.size:
            exact = (x[rows] @ y.T) / (nx[rows, None] * ny)
            ok = exact[a, b] >= threshold
            yield a[ok] + i, b[ok]
            continue
        for k in range(0, len(a), 1 << 15):
            p, r = a[k : k + (1 << 15)] + i, b[k : k + (1 << 15)]
            ok = np.einsum("ij,ij->i", x[p], y[r]) / (nx[p] * ny[r]) >= threshold
            yield p[ok], r[ok]


TILE = "vertex long, links long, root long"


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """(id, n_links, component_id, kept) for each row."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.col(label_col).alias("label"))
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(math.inf)))
    usable = F.coalesce(F.col("label").isNotNull() & finite & F.exists("v", lambda c: c != 0), F.lit(False))
    dims = F.size("v")
    key = F.sha2(F.concat_ws(",", F.col("label").cast("string"), F.array_join(F.col("v").cast("array<string>"), ",")).cast("binary"), 256)
    keyed = rows.withColumn("key", F.when(usable, key))
    some = keyed.filter(F.col("key").isNotNull())
    classes = some.groupBy("key").agg(F.min("id").alias("vertex"), F.count("*").alias("weight"), F.first("v").alias("v"), F.first("label").alias("label"))
    classes = classes.withColumn("dims", dims).withColumn("vertex_key", F.xxhash64("key"))
    count = classes.groupBy("label", "dims").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    dealt = classes.join(count, ["label", "dims"]).withColumn("mine", F.pmod("vertex_key", F.col("blocks")).cast("int"))
    tiles = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiles = tiles.select("label", "dims", F.least("mine", "other").alias("row"), F.greatest("mine", "other").alias("col"), "mine", "vertex_key", "weight", "v")

    def run(t: pa.Table) -> pa.Table:
        mine = t.column("mine").to_numpy()
        key, weight = t.column("vertex_key").to_numpy(), t.column("weight").to_numpy()
        x = t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(t), -1)
        order = np.argsort(mine, kind="stable")
        cut = int((mine == t.column("row")[0].as_py()).sum())
        key, weight, x = key[order], weight[order], x[order]
        diagonal = t.column("row")[0].as_py() == t.column("col")[0].as_py()
        start = 0 if diagonal else cut
        links, union = np.zeros(len(t), np.int64), Union(len(t))
        for a, b in linked_pairs(x[:cut], x[start:], threshold) if cut and start < len(t) else ():
            b = b + start
            if diagonal:
                off = a != b
                a, b = a[off], b[off]
            links += np.bincount(a, weight[b], len(t)).astype(np.int64)
            if not diagonal:
                links += np.bincount(b, weight[a], len(t)).astype(np.int64)
            union.add(a, b)
        some = np.flatnonzero(links)
        return pa.table({"vertex": pa.array(key[some], pa.int64()), "links": pa.array(links[some], pa.int64()), "root": pa.array(key[union.parent[some]], pa.int64())})

    found = tiles.groupBy("label", "dims", "row", "col").applyInArrow(run, TILE)
    return _gather(keyed, classes.select("key", "vertex", "vertex_key", "weight"), found, id_col)


def _gather(keyed: DataFrame, classes: DataFrame, found: DataFrame, id_col: str, salts: int = 16) -> DataFrame:
    from .common import ensure_checkpoint_dir

    ensure_checkpoint_dir(keyed.sparkSession)
    found = found.checkpoint()
    classes = classes.checkpoint()
    names = classes.select("vertex_key", F.col("vertex").alias("name"))
    edges = found.filter(F.col("vertex") != F.col("root")).select("vertex", "root").distinct()
    edges = edges.join(names, F.col("vertex") == F.col("vertex_key")).select(F.col("name").alias("a"), "root")
    edges = edges.join(names, F.col("root") == F.col("vertex_key")).select("a", F.col("name").alias("b"))
    parts = components(edges)
    links = found.groupBy(F.col("vertex").alias("vertex_key")).agg(F.sum("links").alias("links"))
    done = classes.join(links, "vertex_key", "left").join(parts, "vertex", "left")
    done = done.select("key", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).cast("long").alias("n_links"), F.coalesce("component", "vertex").alias("component"))
    # one class may hold a third of all rows: salted
    salted = done.withColumn("salt", F.explode(F.array([F.lit(i).cast("long") for i in range(salts)])))
    out = keyed.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts))).join(salted, ["key", "salt"], "left")
    component = F.when(F.col("id").isNull(), F.lit(None)).otherwise(F.coalesce("component", "id"))
    out = out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False)))


def op2_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector with the number of its near-duplicates and its component."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))
