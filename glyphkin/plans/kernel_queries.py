"""Numeric kernels applied to whole tables; those that SQL can't express are held against models in the tests."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F, types as T

from ..functions import images
from ..functions.mixtures import anderson_darling, principal_components
from ..functions.registration import align, register_to
from ..operators import distances as dist, glyphs
from ..sources import sinks
from ..sources.files import read_pages
from .registry import query, table
from .standins import boxes, clusters
from .table_queries import scratch

SIDE = 8


def _square(v) -> np.ndarray:
    """An embedding as a small image in [0, 1]."""
    x = np.asarray(v, float).reshape(SIDE, SIDE)
    return (x - x.min()) / (x.max() - x.min() + 1e-12)


def _pixels(spark, sf_dir):
    """Vectors as bytes; the product is in single precision, as in the SQL."""
    return table(spark, sf_dir, "embeddings").selectExpr("vec_id", "label", "transform(embedding, x -> CAST(pmod(CAST(floor(x * 1000F) AS long), 256) AS int)) AS p")


@query("SELECT 'v' || vec_id::VARCHAR AS page, 8 AS height, 8 AS width, list_sum(list_transform(embedding, lambda x: ((floor(x * 1000)::BIGINT % 256) + 256) % 256))::BIGINT AS total FROM embeddings")
def k1_png_files(spark, sf_dir):
    """Embeddings as PNG files, written by the executors and read by Spark's image source, byte for byte."""

    @F.pandas_udf(T.BinaryType())
    def as_bytes(p: pd.Series) -> pd.Series:
        return p.map(lambda x: np.asarray(x, np.uint8).tobytes())

    path = scratch(spark)
    rows = _pixels(spark, sf_dir).withColumn("pixels", as_bytes("p")).withColumn("height", F.lit(SIDE)).withColumn("width", F.lit(SIDE))
    files = sinks.png_column(rows, 150).withColumn("name", F.concat(F.lit("doc/v"), F.col("vec_id").cast("string"), F.lit(".png")))
    sinks.write_files(files, path).write.parquet(path + "-index")

    @F.pandas_udf(T.LongType())
    def total(p: pd.Series) -> pd.Series:
        return p.map(lambda x: int(np.frombuffer(x, np.uint8).astype(np.int64).sum()))

    return read_pages(spark, path + "/doc").select("page", "height", "width", total("pixels").alias("total"))


@query()
def i21_suppressed_boxes(spark, sf_dir):
    d = boxes(spark, sf_dir).selectExpr("page", "k * 10 + j AS idx", "polygon", "0.5 + score * 4 + k % 97 / 1000 AS score")
    return glyphs.suppressed(d, ["page"], 0.3, 0.2)


@query()
def i22_suppressed_with_classes(spark, sf_dir):
    d = boxes(spark, sf_dir).selectExpr("page", "k * 10 + j AS idx", "polygon", "0.5 + score * 4 AS score", "array(score, tax, 0.1D) AS classes")
    return glyphs.suppressed_with_classes(d, ["page"], 0.3, 0.2)


@query()
def i23_soft_suppression(spark, sf_dir):
    d = boxes(spark, sf_dir).selectExpr("page", "k * 10 + j AS idx", "polygon", "0.85 + score AS score")
    return glyphs.suppressed(d, ["page"], 0.3, soft=0.8)


@query()
def i16_registration(spark, sf_dir):
    """The movement that lays each embedding's image on itself moved by a pixel: about (1, 0)."""
    from ..functions.registration import warp

    def run(batches):
        for pdf in batches:
            out = []
            for i, v in zip(pdf["vec_id"], pdf["embedding"]):
                img = images.resized(_square(v), 24, 24)
                m = np.eye(3)
                m[0, 2] = 1.0
                p = align(img, warp(img, np.linalg.inv(m), fill=None), "translation")
                out.append((i, *np.round(p, 3)))
            yield pd.DataFrame(out, columns=["vec_id", "tx", "ty"])

    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding").mapInPandas(run, "vec_id long, tx double, ty double")


@query()
def i18_registered_distances(spark, sf_dir):
    """Document distances after every cluster image is registered to its letter's mean."""
    return dist.compute_distances(clusters(spark, sf_dir), register=lambda c: dist.registered_to_mean(c, "translation", (SIDE, SIDE)))


@query()
def i17_register_to_reference(spark, sf_dir):
    """Images registered to a fixed reference, the first of the table by id."""
    first = table(spark, sf_dir, "embeddings").orderBy("vec_id").limit(1).first()["embedding"]
    ref = images.resized(_square(first), 16, 16)

    def run(batches):
        for pdf in batches:
            moved = [register_to(images.resized(_square(v), 16, 16), ref, "translation") for v in pdf["embedding"]]
            yield pd.DataFrame({"vec_id": pdf["vec_id"], "mean": [float(m.mean()) for m in moved]})

    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding").mapInPandas(run, "vec_id long, mean double")


def _glyph_chars(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").selectExpr("concat('d', vec_id % 2) AS doc", "vec_id AS char_id", "embedding AS img")


@query()
def x14_initial_clusters(spark, sf_dir):
    return glyphs.initial_clusters(_glyph_chars(spark, sf_dir))


@query()
def x16_refined_clusters(spark, sf_dir):
    """Letters stand for root clusters; leaves of eight images or more."""
    c = table(spark, sf_dir, "embeddings").selectExpr("concat('d', vec_id % 2) AS doc", "vec_id AS char_id", "label AS root", "embedding AS img")
    return glyphs.refined_clusters(c, (SIDE, SIDE), least=8, transform="translation")


@query()
def x17_normality(spark, sf_dir):
    """p-value of the first principal component of each label's vectors."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = principal_components(np.stack(pdf["embedding"].to_numpy()).astype(float), 1)
        return pd.DataFrame({"label": [pdf["label"].iloc[0]], "p": [round(anderson_darling(x[:, 0]), 6)]})

    return table(spark, sf_dir, "embeddings").groupBy("label").applyInPandas(run, "label int, p double")


@query()
def i11_processed_pages(spark, sf_dir):
    """Pages drawn from the boxes of a few lines: windows, word directions and glyphs of every page."""

    def draw(keys: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        page = np.full((160, 400), 230, np.uint8)
        words = []
        for k, (idx, x) in enumerate(zip(pdf["idx"], pdf["x"])):
            t, left = 20 + 60 * (k // 4), 20 + 90 * (k % 4)
            chars = []
            for c in range(3):
                lo = left + 4 + 20 * c
                page[t + 4 : t + 24, lo : lo + 6] = 20
                page[t + 12 + x % 5 : t + 16 + x % 5, lo : lo + 14] = 20
                chars.append({"char_idx": c, "label": "abc"[c], "t": t + 2, "b": t + 26, "l": lo - 2, "r": lo + 16})
            words.append({"word_idx": int(idx), "t": t, "b": t + 28, "l": left, "r": left + 66, "chars": chars})
        return pd.DataFrame({"doc": ["d"], "page": [str(keys[0])], "height": [160], "width": [400], "pixels": [page.tobytes()], "words": [words]})

    char = "array<struct<char_idx: int, label: string, t: int, b: int, l: int, r: int>>"
    schema = f"doc string, page string, height int, width int, pixels binary, words array<struct<word_idx: int, t: int, b: int, l: int, r: int, chars: {char}>>"
    rows = table(spark, sf_dir, "nation").selectExpr("n_regionkey AS page", "n_nationkey AS idx", "n_nationkey * 7 AS x")
    pages = rows.groupBy("page").applyInPandas(draw, schema)
    return glyphs.process_pages(pages, (128, 128), (64, 64)).drop("img")


@query()
def i5_window_angles(spark, sf_dir):
    """Direction of the strongest stripes in each embedding's image, blown up to a page."""

    def run(batches):
        for pdf in batches:
            out = []
            for i, v in zip(pdf["vec_id"], pdf["embedding"]):
                page = (images.resized(_square(v), 64, 64) * 255).astype(np.uint8)
                out += [(i, x, y, a) for x, y, a in images.window_angles(page, 32, 32, (32, 32))]
            yield pd.DataFrame(out, columns=["vec_id", "x", "y", "angle"])

    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding").mapInPandas(run, "vec_id long, x int, y int, angle double")


@query()
def i1_flat_background(spark, sf_dir):
    """Share of ink in each embedding's image after its background is flattened."""

    def run(batches):
        for pdf in batches:
            share = [float((images.flat_background((images.resized(_square(v), 32, 32) * 255).astype(np.uint8), 1) < 0.5).mean()) for v in pdf["embedding"]]
            yield pd.DataFrame({"vec_id": pdf["vec_id"], "ink": share})

    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding").mapInPandas(run, "vec_id long, ink double")


@query()
def i6_structure_tensor(spark, sf_dir):
    def run(batches):
        for pdf in batches:
            t = [images.structure_tensor(_square(v)) for v in pdf["embedding"]]
            yield pd.DataFrame({"vec_id": pdf["vec_id"], "coherence": [float(x["coherence"].mean()) for x in t], "jxx": [float(x["Jxx"].mean()) for x in t]})

    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding").mapInPandas(run, "vec_id long, coherence double, jxx double")


@query()
def i10_centred_glyphs(spark, sf_dir):
    def run(batches):
        for pdf in batches:
            g = [images.centred_glyph(_square(v), 12, 12) for v in pdf["embedding"]]
            yield pd.DataFrame({"vec_id": pdf["vec_id"], "img": [x.ravel().astype(np.float32) for x in g]})

    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding").mapInPandas(run, "vec_id long, img array<float>")


@query()
def i24_detected_words(spark, sf_dir):
    """Grid cells drawn from order lines, three a detection, to words with text."""
    from ..operators.detection import Detector, detect_words

    rows = table(spark, sf_dir, "lineitem").selectExpr("'d' AS doc", "concat('p', l_orderkey % 200) AS page", "l_orderkey AS k", "l_linenumber AS j", "CAST((l_orderkey * l_orderkey * 31) % 400 AS int) AS x0", "CAST((l_orderkey * l_orderkey * 17) % 600 AS int) AS y", "explode(array(0, 1)) AS dx")
    words = rows.filter("j = 1").selectExpr("doc", "page", "x0 + dx AS x", "y", "0.99D - dx / 100 AS score", "2D AS t", "2D AS b", "10D + dx AS l", "10D - dx AS r", "0D AS angle", "1D AS scale_x", "1D AS scale_y", "1700 AS width", "2500 AS height").dropDuplicates(["page", "x", "y"])
    chars = rows.filter("j = 1").selectExpr("doc", "page", "x0 + dx AS x", "y", "0.9D - dx / 10 AS score", "2D AS t", "2D AS b", "2D + dx AS l", "2D - dx AS r", "transform(sequence(0, 2), c -> IF(c = k % 3, 0.8D, 0.1D)) AS classes", "1D AS scale_x", "1D AS scale_y").dropDuplicates(["page", "x", "y"])
    labels = spark.createDataFrame([(0, "A"), (1, "B"), (2, "C")], "id int, char string")
    return detect_words(words, chars, labels, detector=Detector()).select("doc", "page", "word_idx", "tblr", "text", F.round("text_score", 6).alias("text_score"))


#: Images of a stack, and tasks that vectors are dealt to for each core: kernels take long, a file is small.
STACK, DEALT = 512, 4


def _dealt(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding").repartition(DEALT * spark.sparkContext.defaultParallelism)


def _each(spark, sf_dir, kernel, columns: dict[str, str]):
    """A kernel's numbers for each vector, as a small image."""
    return _each_stack(spark, sf_dir, lambda imgs: [kernel(img) for img in imgs], columns)


def _each_stack(spark, sf_dir, kernel, columns: dict[str, str]):
    """A kernel's numbers for each vector of a stack of small images."""

    def run(batches):
        for pdf in batches:
            rows = [r for i in range(0, len(pdf), STACK) for r in kernel([_square(v) for v in pdf["embedding"][i : i + STACK]])]
            yield pd.DataFrame({"vec_id": pdf["vec_id"], **{c: [r[k] for r in rows] for k, c in enumerate(columns)}})

    schema = ", ".join(["vec_id long", *(f"{c} {kind}" for c, kind in columns.items())])
    return _dealt(spark, sf_dir).mapInPandas(run, schema)


def _each_label(spark, sf_dir, kernel, columns: dict[str, str]):
    """A kernel's numbers for the vectors of each label."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf.sort_values("vec_id")["embedding"].to_numpy()).astype(float)
        return pd.DataFrame([(pdf["label"].iloc[0], *kernel(x))], columns=["label", *columns])

    schema = ", ".join(["label int", *(f"{c} {kind}" for c, kind in columns.items())])
    return table(spark, sf_dir, "embeddings").groupBy("label").applyInPandas(run, schema)


@query("SELECT vec_id, round((embedding[12]::DOUBLE - embedding[10]) / 2, 6) AS gx, round((embedding[19]::DOUBLE - embedding[3]) / 2, 6) AS gy, round((embedding[2]::DOUBLE - embedding[1]) / 2, 6) AS gx0 FROM embeddings")
def i12_gradients(spark, sf_dir):
    """Central differences at row 1, column 2, and at the corner, where the edge is repeated."""
    from ..functions.registration import gradient

    def run(batches):
        for pdf in batches:
            g = [gradient(np.asarray(v, float).reshape(SIDE, SIDE)) for v in pdf["embedding"]]
            yield pd.DataFrame({"vec_id": pdf["vec_id"], "gx": [round(float(x[0, 1, 2]), 6) for x in g], "gy": [round(float(x[1, 1, 2]), 6) for x in g], "gx0": [round(float(x[0, 0, 0]), 6) for x in g]})

    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding").mapInPandas(run, "vec_id long, gx double, gy double, gx0 double")


@query("SELECT n_nationkey, round(cos(n_nationkey * 0.01::DOUBLE), 9) AS euclidean, 1 + n_nationkey * 0.01::DOUBLE AS homothety, round(-sin(n_nationkey * 0.01::DOUBLE), 9) AS turned FROM nation")
def i13_transform_matrices(spark, sf_dir):
    """Matrix entries of transforms with growing parameters."""
    from ..functions.registration import matrix_of

    def run(batches):
        for pdf in batches:
            a = [k * 0.01 for k in pdf["n_nationkey"]]
            e, h = [matrix_of(np.array([1, 2, x]), "euclidean") for x in a], [matrix_of(np.array([1, 2, x]), "homothety") for x in a]
            yield pd.DataFrame({"n_nationkey": pdf["n_nationkey"], "euclidean": [round(float(m[0, 0]), 9) for m in e], "homothety": [float(m[1, 1]) for m in h], "turned": [round(float(m[0, 1]), 9) for m in e]})

    return table(spark, sf_dir, "nation").select("n_nationkey").mapInPandas(run, "n_nationkey int, euclidean double, homothety double, turned double")


@query("SELECT n_nationkey, (n_nationkey % 8)::DOUBLE AS dx, (n_nationkey // 8)::DOUBLE AS dy FROM nation")
def i14_generators(spark, sf_dir):
    """How pixels move with the scale of a homothety: by their own coordinates."""
    from ..functions.registration import generators

    j = generators((SIDE, SIDE), "homothety")

    def run(batches):
        for pdf in batches:
            k = pdf["n_nationkey"].to_numpy()
            yield pd.DataFrame({"n_nationkey": k, "dx": j[k // SIDE, k % SIDE, 0, 2], "dy": j[k // SIDE, k % SIDE, 1, 2]})

    return table(spark, sf_dir, "nation").select("n_nationkey").mapInPandas(run, "n_nationkey int, dx double, dy double")


@query("SELECT n_nationkey, (greatest(0, 8 - n_nationkey % 9) * 8)::BIGINT AS n FROM nation")
def i15_pixels_inside(spark, sf_dir):
    """How many pixels of an 8 x 8 image a movement to the right leaves inside."""
    from ..functions.registration import inside

    def run(batches):
        for pdf in batches:
            out = []
            for k in pdf["n_nationkey"]:
                m = np.eye(3)
                m[0, 2] = k % 9
                out.append(int(inside((SIDE, SIDE), (SIDE, SIDE), m).sum()))
            yield pd.DataFrame({"n_nationkey": pdf["n_nationkey"], "n": out})

    return table(spark, sf_dir, "nation").select("n_nationkey").mapInPandas(run, "n_nationkey int, n long")


@query("WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), n AS (SELECT vec_id, list_transform(v, lambda x: (x - list_min(v)) / (list_max(v) - list_min(v) + 1e-12)) AS u FROM e) SELECT vec_id, round(u[2] + u[9] - 2 * u[1], 4) AS corner, round(u[11] + u[9] + u[18] + u[2] - 4 * u[10], 4) AS centre FROM n")
def i2_laplacians(spark, sf_dir):
    def kernel(img):
        d = images.laplacian(img)
        return round(float(d[0, 0]), 4), round(float(d[1, 1]), 4)

    return _each(spark, sf_dir, kernel, {"corner": "double", "centre": "double"})


@query("SELECT vec_id, 0::DOUBLE AS inside, 0::DOUBLE AS outside FROM embeddings")
def i3_poisson_solutions(spark, sf_dir):
    """An image from its own Laplacian inside a mask: nothing changes."""
    mask = np.zeros((SIDE, SIDE), bool)
    mask[2:6, 1:7] = True

    def kernel(img):
        u = images.solve_poisson(images.laplacian(img), img, mask)
        return abs(round(float(np.abs(u - img)[mask].max()), 5)), abs(round(float(np.abs(u - img)[~mask].max()), 5))

    return _each(spark, sf_dir, kernel, {"inside": "double", "outside": "double"})


@query("SELECT vec_id, 0::DOUBLE AS difference FROM embeddings")
def i4_poisson_edits(spark, sf_dir):
    """An image put into itself moved by a constant: inside the mask the constant comes with the rim."""
    mask = np.zeros((SIDE, SIDE), bool)
    mask[2:6, 1:7] = True
    return _each(spark, sf_dir, lambda img: (abs(round(float(np.abs(images.poisson_edit(img, img + 0.5, mask) - img - 0.5).max()), 5)),), {"difference": "double"})


@query()
def i7_line_paths(spark, sf_dir):
    """Lengths of the paths above and below two boxes in each embedding's image."""
    from ..functions.segment import stacked_line_paths

    def kernel(imgs):
        return [(len(a), len(b)) for a, b in stacked_line_paths(_words(imgs), np.array([[4, 12, 2, 9], [5, 11, 13, 20]]))]

    return _each_stack(spark, sf_dir, kernel, {"above": "int", "below": "int"})


@query()
def i8_side_paths(spark, sf_dir):
    from ..functions.segment import stacked_side_paths

    def kernel(imgs):
        found = stacked_side_paths(_words(imgs), np.array([[2, 9], [13, 20]]), [(None, None)] * len(imgs))
        return [tuple(int(p[:, 1].sum()) for pair in pairs for p in pair) for pairs in found]

    return _each_stack(spark, sf_dir, kernel, {"l1": "int", "r1": "int", "l2": "int", "r2": "int"})


@query()
def i9_character_masks(spark, sf_dir):
    from ..functions.segment import stacked_char_masks

    def kernel(imgs):
        found = stacked_char_masks(_words(imgs), np.array([[4, 12, 2, 9], [5, 11, 13, 20]]), 7)
        return [(len(masks), int(sum(m.sum() for _, _, m in masks))) for masks in found]

    return _each_stack(spark, sf_dir, kernel, {"n": "int", "pixels": "int"})


def _words(imgs: list[np.ndarray]) -> np.ndarray:
    return np.stack([images.resized(img, 16, 24) for img in imgs])


@query()
def w9_path_targets(spark, sf_dir):
    """Where the edges of three boxes move towards, boxes drawn from each vector's first numbers."""
    from ..functions.segment import _targets

    def kernel(img):
        left = (np.array([0, 20, 40]) + img[0, :3] * 10).astype(int)
        edges = np.stack([left, left + 8], 1)
        return (*_targets(edges, -1, 0).tolist(), *_targets(edges, 1, 59).tolist())

    return _each(spark, sf_dir, kernel, {f"{s}{k}": "double" for s in "lr" for k in range(3)})


@query()
def a12_angle_profiles(spark, sf_dir):
    """The direction of the largest mean magnitude in each embedding's spectrum."""

    def kernel(img):
        m = np.abs(np.fft.fftshift(np.fft.fft2(images.resized(img, 32, 32))))
        return float(images.radial_profile(m).max()), images.dominant_angle(m)

    return _each(spark, sf_dir, kernel, {"top": "double", "angle": "int"})


@query()
def a13_mean_tensors(spark, sf_dir):
    def kernel(img):
        t = images.structure_tensor(img)
        return tuple(float(t[k][2:6, 2:6].mean()) for k in ("Jxx", "Jxy", "Jyy"))

    return _each(spark, sf_dir, kernel, {"jxx": "double", "jxy": "double", "jyy": "double"})


@query("SELECT vec_id, (CASE WHEN vec_id % 3 = 0 THEN 0 ELSE 4 END)::BIGINT AS n FROM embeddings")
def f14_flat_windows(spark, sf_dir):
    """Windows of pages that are not flat; every third page is."""

    def run(batches):
        for pdf in batches:
            n = [len(images.window_angles(np.full((32, 32), 9, np.uint8) if i % 3 == 0 else (images.resized(_square(v), 32, 32) * 255).astype(np.uint8), 16, 16, (16, 16))) for i, v in zip(pdf["vec_id"], pdf["embedding"])]
            yield pd.DataFrame({"vec_id": pdf["vec_id"], "n": n})

    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding").mapInPandas(run, "vec_id long, n long")


@query()
def x6_principal_components(spark, sf_dir):
    """How many components hold nine tenths of each label's variance."""
    return _each_label(spark, sf_dir, lambda x: (principal_components(x, 0.9).shape[1],), {"components": "int"})


@query()
def x7_spread_seeds(spark, sf_dir):
    from ..functions.mixtures import spread_seeds

    return _each_label(spark, sf_dir, lambda x: (len(np.unique(spread_seeds(x, 5, np.random.default_rng(0)), axis=0)),), {"distinct_seeds": "int"})


@query()
def x8_kmeans(spark, sf_dir):
    from ..functions.mixtures import kmeans

    def kernel(x):
        _, centres, losses = kmeans(x, 5)
        return len(centres), losses[0], losses[-1]

    return _each_label(spark, sf_dir, kernel, {"clusters": "int", "first_loss": "double", "last_loss": "double"})


@query()
def x9_shrunk_covariances(spark, sf_dir):
    from ..functions.mixtures import lower_root, shrunk

    def kernel(x):
        c = shrunk(np.cov(x.T, bias=True), len(x))
        return float(np.trace(c)), float(np.log(np.diag(lower_root(c))).sum())

    return _each_label(spark, sf_dir, kernel, {"trace": "double", "log_root_det": "double"})


@query()
def x13_mixtures(spark, sf_dir):
    """Components, log likelihood at the first and last step, and the weights' sum of each label's mixture."""
    from ..functions.mixtures import Mixture

    def kernel(x):
        m, _ = Mixture.fit(principal_components(x, 3), 3, most=50)
        return len(m.weights), m.history[0], m.history[-1], float(m.weights.sum())

    return _each_label(spark, sf_dir, kernel, {"components": "int", "first": "double", "last": "double", "weights": "double"})


@query()
def x12_shares(spark, sf_dir):
    """Expectation step: every point's shares add up to one."""
    from ..functions.mixtures import Mixture

    def kernel(x):
        y = principal_components(x, 3)
        share, _ = Mixture.of(y, np.random.default_rng(0).dirichlet(np.ones(3), len(y)).T).shares(y)
        return share.shape[0], float(np.abs(share.sum(0) - 1).max())

    return _each_label(spark, sf_dir, kernel, {"components": "int", "error": "double"})


@query()
def x15_leaves(spark, sf_dir):
    """Leaves of each label's tree, and how many of its images they hold."""

    def kernel(x):
        leaves = glyphs.leaves_of(x.reshape(-1, SIDE, SIDE), least=8)
        return len(leaves), int(sum(map(len, leaves)))

    return _each_label(spark, sf_dir, kernel, {"leaves": "int", "held": "int"})


@query()
def x18_normality_tests(spark, sf_dir):
    from ..functions.mixtures import NORMALITY

    def kernel(x):
        y = principal_components(x, 1)[:, 0]
        y = (y - y.mean()) / y.std()
        return tuple(round(float(f(y)), 6) for f in NORMALITY.values())

    return _each_label(spark, sf_dir, kernel, {n: "double" for n in NORMALITY})


@query("SELECT 0.0455::DOUBLE AS p")
def x19_split_threshold(spark, sf_dir):
    from ..functions.mixtures import SPLIT_BELOW

    return spark.range(1).select(F.round(F.lit(SPLIT_BELOW), 4).alias("p"))


@query()
def o1_corpus_steps(spark, sf_dir):
    """The whole analysis below one folder: a page for each region, three words for each of its nations; every
    step a table; the last table's rows. A document has about thirty glyphs, so its mixture has two components
    and its trees one level: deeper ones leave no leaf of eight glyphs, and no clusters at all."""
    from .corpus import Corpus

    def draw(keys: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        page, words = np.full((400, 500), 230, np.uint8), []
        for k, key in enumerate(sorted(pdf["key"])):
            t, left = 20 + 60 * (k // 4), 20 + 110 * (k % 4)
            chars = []
            for i, label in enumerate("xo"):
                lo = left + 4 + 24 * i
                page[t + 4 : t + 24, lo : lo + 5] = 20
                row = t + 4 if label == "o" else t + 18
                page[row : row + 4 + key % 3, lo : lo + 12] = 20
                chars.append({"char_idx": i, "label": label, "t": t + 2, "b": t + 26, "l": lo - 2, "r": lo + 16})
            words.append({"word_idx": k, "t": t, "b": t + 28, "l": left, "r": left + 60, "chars": chars})
        return pd.DataFrame({"doc": [f"d{keys[0]}"], "page": ["p0"], "height": [400], "width": [500], "pixels": [page.tobytes()], "words": [words]})

    inner = "array<struct<char_idx: int, label: string, t: int, b: int, l: int, r: int>>"
    schema = f"doc string, page string, height int, width int, pixels binary, words array<struct<word_idx: int, t: int, b: int, l: int, r: int, chars: {inner}>>"
    root = scratch(spark)
    rows = table(spark, sf_dir, "nation").selectExpr("n_regionkey AS doc", "explode(transform(array(0, 1, 2), i -> i * 100 + n_nationkey)) AS key")
    rows.groupBy("doc").applyInPandas(draw, schema).write.parquet(f"{root}/pages")
    corpus = Corpus(spark, root, pages={"window": (128, 128), "step": (64, 64)}, initial={"components": 2}, refined={"least": 8, "depth": 1})
    corpus.run()
    return corpus.table("scores").select("style", "doc_a", "doc_b", "n", "n1hat")
