"""Scans, array files, CSV tables and results: written below the shared folder and read back, whole tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F, types as T

from ..functions import scans
from ..operators import documents as docs, italic, scoring
from ..sources import files, scans as source, sinks
from .page_queries import THRESHOLDS
from .registry import query, table
from .scoring_queries import COUNTS, QUANTILES, SCORES, _distances, _scores
from .standins import SELECTED, boxes, words
from .table_queries import scratch

PIXELS = "list_transform(embedding, lambda x: ((floor(x * 1000)::BIGINT % 256) + 256) % 256)"


def _pixels(spark, sf_dir):
    """Vectors as bytes; the product is in single precision, as in the SQL: in double precision some fall below a whole number."""
    # dealt out, as a small file is one task and each row of it becomes a file
    rows = table(spark, sf_dir, "embeddings").repartition(sinks.DEALT * spark.sparkContext.defaultParallelism)
    return rows.selectExpr("vec_id", "label", "transform(embedding, x -> CAST(pmod(CAST(floor(x * 1000F) AS long), 256) AS int)) AS p")


def _square(p) -> np.ndarray:
    return np.asarray(p, np.uint8).reshape(8, 8)


def _written(spark, sf_dir, encode, ending: str) -> str:
    """One file a vector below folders by label; the folder's URI."""

    @F.pandas_udf(T.BinaryType())
    def coded(p: pd.Series) -> pd.Series:
        return p.map(lambda x: encode(_square(x)))

    path = scratch(spark)
    rows = _pixels(spark, sf_dir).withColumn("png", coded("p")).withColumn("name", F.concat(F.lit("l"), F.col("label").cast("string"), F.lit("/v"), F.col("vec_id").cast("string"), F.lit(ending)))
    sinks.write_files(rows, path).write.parquet(path + "-index")
    return path


@F.pandas_udf(T.LongType())
def byte_sum(p: pd.Series) -> pd.Series:
    return p.map(lambda x: int(np.frombuffer(x, np.uint8).astype(np.int64).sum()))


@query("SELECT 'l' || label::VARCHAR AS source, 'tiff' AS kind FROM embeddings GROUP BY label")
def s1_discovered_sources(spark, sf_dir):
    found = files.discover(spark, _written(spark, sf_dir, scans.tiff_bytes, ".tif"))
    return found.select(F.regexp_extract("source", "([^/]+)$", 1).alias("source"), "kind")


@query(f"SELECT 'v' || vec_id::VARCHAR AS doc, 0 AS page, 8 AS height, 8 AS width, list_sum({PIXELS})::BIGINT AS total FROM embeddings")
def s2_pdf_pages(spark, sf_dir):
    """A PDF file a vector; the first image of each page."""
    path = _written(spark, sf_dir, lambda i: scans.pdf_bytes([i], 144, 72), ".pdf")
    return source.read_pdf(spark, path).select("doc", "page", "height", "width", byte_sum("pixels").alias("total"))


@query(f"SELECT 'v' || vec_id::VARCHAR AS doc, list_sum(list_transform({PIXELS}, lambda p: CASE WHEN p >= 128 THEN 255 - p ELSE p END))::BIGINT AS total FROM embeddings")
def s3_layered_pages(spark, sf_dir):
    """Pages with a second layer behind a mask, laid over the first."""
    path = _written(spark, sf_dir, lambda i: scans.pdf_bytes([i], 144, 72, [(255 - i, np.where(i >= 128, 255, 0))]), ".pdf")
    pages = source.read_pdf(spark, path, scans.layered)
    return pages.select("doc", byte_sum("pixels").alias("total"))


@query(f"SELECT 'l' || label::VARCHAR AS doc, 'v' || vec_id::VARCHAR AS name, (row_number() OVER (PARTITION BY label ORDER BY 'v' || vec_id::VARCHAR) - 1)::INTEGER AS page, list_sum({PIXELS})::BIGINT AS total FROM embeddings")
def s4_tiff_pages(spark, sf_dir):
    rows = source.read_tiff(spark, _written(spark, sf_dir, scans.tiff_bytes, ".tif"))
    return rows.select("doc", "name", "page", byte_sum("pixels").alias("total"))


@query(f"SELECT 'v' || vec_id::VARCHAR AS page, list_sum({PIXELS})::BIGINT AS total FROM embeddings")
def s5_png_pages(spark, sf_dir):
    from ..functions.images import png_bytes

    path = _written(spark, sf_dir, png_bytes, ".png")
    return files.read_pages(spark, path + "/*").select("page", byte_sum("pixels").alias("total"))


@query("SELECT 'v' || vec_id::VARCHAR AS doc, 4.0::DOUBLE AS dpi_width, 8.0::DOUBLE AS dpi_height FROM embeddings")
def s14_pdf_resolution(spark, sf_dir):
    path = _written(spark, sf_dir, lambda i: scans.pdf_bytes([i], 144, 72), ".pdf")
    return source.read_pdf(spark, path).select("doc", "dpi_width", "dpi_height")


@query("SELECT 'l' || label::VARCHAR AS doc, 200 AS dpi FROM embeddings GROUP BY label")
def s15_tiff_resolution(spark, sf_dir):
    path = _written(spark, sf_dir, lambda i: scans.tiff_bytes(i, 190), ".tif")
    return docs.document_dpi(files.read_tiff_info(spark, path))


@query("SELECT vec_id, 4 AS height, 4 AS width FROM embeddings")
def p12_rescaled_pages(spark, sf_dir):
    """TIFF pages at 300 dpi converted to PNG at 150 and read back."""
    path = _written(spark, sf_dir, lambda i: scans.tiff_bytes(i, 300), ".tif")
    out = scratch(spark)
    pages = source.read_tiff(spark, path)
    names = source.tiff_pages(spark, path)
    source.convert(pages, out, 150).write.parquet(out + "-index")
    got = files.read_pages(spark, out + "/*").withColumn("page", F.regexp_extract("page", r"(\d+)$", 1).cast("int"))
    return got.join(names, ["doc", "page"]).select(F.substring("name", 2, 20).cast("long").alias("vec_id"), "height", "width")


@query("SELECT 'l' || label::VARCHAR AS doc, char_idx::INTEGER AS char_idx, (char_idx % 5)::INTEGER AS word_idx, chr((97 + label)::INTEGER) AS label FROM (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS char_idx FROM embeddings)")
def s8_array_files(spark, sf_dir):
    """Glyphs in compressed array files, one a document, written and read back."""
    numbered = table(spark, sf_dir, "embeddings").selectExpr("concat('l', label) AS doc", "'p' AS page", "CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS int) AS char_idx", "chr(97 + label) AS label", "embedding AS img")
    path = scratch(spark)
    packed = sinks.npz_column(numbered.withColumn("word_idx", (F.col("char_idx") % 5).cast("int")))
    sinks.write_files(packed, path, "name", "npz").write.parquet(path + "-index")
    return files.read_npz(spark, path).select("doc", "char_idx", "word_idx", "label")


@query("SELECT s_name AS FileName, (s_suppkey + 1)::INTEGER AS \"Index\", CASE WHEN s_suppkey % 5 > 0 THEN 'P ' || s_nationkey::VARCHAR END AS Printer FROM supplier")
def s9_metadata_file(spark, sf_dir):
    path = scratch(spark)
    rows = table(spark, sf_dir, "supplier").selectExpr("CAST(s_suppkey + 1 AS int) AS `Index`", "CASE WHEN s_suppkey % 5 > 0 THEN concat('P ', s_nationkey) END AS Printer", "s_name AS FileName")
    rows.coalesce(1).write.option("header", "true").csv(path)
    return files.read_metadata(spark, path).select("FileName", "Index", "Printer")


@query("SELECT p_type AS doc, greatest((round_even(quantile_cont(x, 0.5) / 50, 0) * 50)::INTEGER, 50) AS dpi FROM (SELECT p_type, unnest([p_size * 7::DOUBLE, p_retailprice / 4]) AS x FROM part) GROUP BY p_type")
def s10_dpi_file(spark, sf_dir):
    """Medians of a resolution table that was written as CSV."""
    path = scratch(spark)
    sides = {"DPI (width)": "p_size * 7D", "DPI (height)": "p_retailprice / 4", "width (in)": "1D", "height (in)": "1D", "width (cm)": "2.54D", "height (cm)": "2.54D"}
    rows = table(spark, sf_dir, "part").selectExpr("p_type AS suelta", "CAST(p_partkey AS string) AS page", *(f"{e} AS `{c}`" for c, e in sides.items()), "'x' AS `Source of physical dimension`")
    sinks.write_dpi(rows, path)
    back = files.read_dpi(spark, path)
    return docs.document_dpi(back.select(F.col("suelta").alias("doc"), F.col("`DPI (width)`").alias("dpi_width"), F.col("`DPI (height)`").alias("dpi_height")))


@query(f"WITH {SCORES} SELECT style, doc_a, doc_b, n, n1hat FROM sc")
def k7_stored_scores(spark, sf_dir):
    path = scratch(spark)
    sinks.write_table(_scores(spark, sf_dir).drop("a"), path, ("style",))
    return spark.read.parquet(path).select("style", "doc_a", "doc_b", "n", "n1hat")


@query(f"WITH {SCORES} SELECT style, count(*) AS n FROM sc GROUP BY style")
def s21_cached_scores(spark, sf_dir):
    """Scores computed only where no result is stored; the second call finds all of them."""
    path = scratch(spark)
    key = ["style", "doc_a", "doc_b"]
    for _ in range(2):
        sinks.write_pending(_scores(spark, sf_dir).drop("a"), path, key)
    return spark.read.parquet(path).groupBy("style").agg(F.count("*").alias("n"))


@query(f"WITH {THRESHOLDS} SELECT doc, n_valid_strokes, round(threshold, 6) AS threshold FROM th")
def k4_stored_thresholds(spark, sf_dir):
    path = scratch(spark)
    sinks.write_table(italic.thresholds(words(spark, sf_dir)), path)
    return spark.read.parquet(path).select("doc", "n_valid_strokes", F.round("threshold", 6).alias("threshold"))


@query("SELECT l_partkey % 20 AS cluster, count(*) AS n FROM lineitem GROUP BY ALL")
def k3_stored_glyphs(spark, sf_dir):
    path = scratch(spark)
    rows = table(spark, sf_dir, "lineitem").selectExpr("concat('d', l_suppkey % 10) AS doc", "l_partkey % 20 AS cluster", "array(l_discount, l_tax) AS img")
    sinks.write_table(rows, path)
    return spark.read.parquet(path).groupBy("cluster").agg(F.count("*").alias("n"))


@query("SELECT 'l' || label::VARCHAR AS folder, count(*) AS n FROM embeddings GROUP BY label")
def k10_copied_files(spark, sf_dir):
    """Every file copied into one folder; what was copied, by the folder it came from."""
    path, out = _written(spark, sf_dir, scans.tiff_bytes, ".tif"), scratch(spark)
    index = spark.read.parquet(path + "-index")
    sinks.copy_files(index.select(F.col("path").alias("file")), out).write.parquet(out + "-index")
    copied = spark.read.parquet(out + "-index").select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"))
    by = index.select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), F.regexp_extract("path", "([^/]+)/[^/]+$", 1).alias("folder"))
    return copied.join(by, "name").groupBy("folder").agg(F.count("*").alias("n"))


@query("SELECT 'p' || (l_orderkey % 200)::VARCHAR AS page, l_linenumber::VARCHAR || ',' || l_partkey::VARCHAR || ',' || l_returnflag AS line FROM lineitem")
def k11_word_lines(spark, sf_dir):
    path = scratch(spark)
    rows = table(spark, sf_dir, "lineitem").selectExpr("'d' AS doc", "concat('p', l_orderkey % 200) AS page", "array(CAST(l_linenumber AS long), l_partkey) AS polygon", "l_returnflag AS text")
    sinks.write_word_lines(rows, path)
    return spark.read.text(path).select("page", F.col("value").alias("line"))


@query(f"WITH {QUANTILES} SELECT ds.style, ds.letter, doc_a, doc_b, a, dist < q AS below FROM ds JOIN qs ON ds.style = qs.style AND ds.letter = qs.letter")
def j14_pairs_and_levels(spark, sf_dir):
    ds = _distances(spark, sf_dir)
    levels = scoring.quantiles(ds, digits=9)
    return ds.join(levels, ["style", "letter"]).select("style", "letter", "doc_a", "doc_b", "a", (F.col("dist") < F.col("q")).alias("below"))


@query(f"WITH {COUNTS} SELECT style, a, sum(k)::BIGINT AS k FROM ct GROUP BY ALL")
def a6_totals_by_level(spark, sf_dir):
    ds = _distances(spark, sf_dir)
    return scoring.letters_below(ds, scoring.quantiles(ds, digits=9)).groupBy("style", "a").agg(F.sum("k").alias("k"))


@query(f"WITH {SELECTED} SELECT doc FROM sel WHERE style = 'roman' INTERSECT SELECT doc FROM sel WHERE style = 'italic' AND letter < 'f'")
def se3_intersection(spark, sf_dir):
    from ..operators import distances as dist
    from .standins import clusters

    s = dist.select_clusters(clusters(spark, sf_dir))
    return s.filter("style = 'roman'").select("doc").intersect(s.filter("style = 'italic' AND letter < 'f'").select("doc"))


@query("SELECT l_orderkey AS k, l_linenumber AS j, coalesce(o_orderpriority, '?') AS label FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_orderkey % 3 <> 0) ON o_orderkey = l_orderkey")
def j15_original_labels(spark, sf_dir):
    """Characters back to the labels of what they were cut from; `?` where that is not there."""
    o = table(spark, sf_dir, "orders").filter("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").join(o, "l_orderkey", "left")
    return rows.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("j"), F.coalesce("o_orderpriority", F.lit("?")).alias("label"))


@query("SELECT vec_id, round(quantile_cont(x, 0.1), 6) AS q FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS x FROM embeddings) WHERE x <= 1 - 1 / 255::DOUBLE GROUP BY vec_id")
def a14_ink_quantiles(spark, sf_dir):
    x = table(spark, sf_dir, "embeddings").select("vec_id", F.explode("embedding").alias("x")).withColumn("x", F.col("x").cast("double"))
    return x.filter(F.col("x") <= 1 - 1 / 255).groupBy("vec_id").agg(F.round(F.percentile("x", F.lit(0.1)), 6).alias("q"))


@query(f"SELECT vec_id, list_transform(range(64), lambda i: CASE WHEN i % 3 = 0 THEN 1 ELSE ({PIXELS})[i + 1] / 255 END)[1:4] AS first FROM embeddings".replace("[1:4] AS first", "").replace("SELECT vec_id, list_transform", "SELECT vec_id, round(list_sum(list_transform").replace("END) FROM", "END)), 4) AS total FROM"))
def p10_masked_crops(spark, sf_dir):
    """Images with every third pixel masked out to white."""
    from ..functions.images import masked_crop

    mask = (np.arange(64) % 3 != 0).reshape(8, 8)

    @F.pandas_udf(T.DoubleType())
    def total(p: pd.Series) -> pd.Series:
        return p.map(lambda x: float(masked_crop(_square(x) / 255, (0, 8, 0, 8), mask).sum()))

    return _pixels(spark, sf_dir).select("vec_id", F.round(total("p"), 4).alias("total"))


@query(f"SELECT vec_id, round((p[3] / 255 - 0.5) / 0.25, 6) AS red, round((p[1] / 255 - 0.4) / 0.2, 6) AS blue FROM (SELECT vec_id, {PIXELS} AS p FROM embeddings)")
def p20_normalised_channels(spark, sf_dir):
    """The first three numbers as a pixel in blue, green, red."""
    from ..functions.images import normalised_channels

    def run(batches):
        for pdf in batches:
            rgb = normalised_channels(np.stack([np.asarray(p[:3], np.uint8) for p in pdf["p"]]), (0.5, 0.45, 0.4), (0.25, 0.22, 0.2))
            yield pd.DataFrame({"vec_id": pdf["vec_id"], "red": rgb[:, 0].round(6), "blue": rgb[:, 2].round(6)})

    return _pixels(spark, sf_dir).select("vec_id", "p").mapInPandas(run, "vec_id long, red double, blue double")


@query("WITH b AS (SELECT DISTINCT 'p' || (l_orderkey % 200)::VARCHAR AS page, (l_orderkey * l_orderkey * 31 + l_linenumber * 211) % 1999 // 8 AS x, (l_orderkey * l_orderkey * 17 + l_orderkey * 7 + l_linenumber * 1013) % 2999 // 8 AS y FROM lineitem), px AS (SELECT DISTINCT page, x + dx AS x, y + dy AS y FROM b CROSS JOIN (SELECT unnest(range(-1, 2)) AS dx) CROSS JOIN (SELECT unnest(range(-1, 2)) AS dy)) SELECT page, count(*) AS n FROM px WHERE x >= 0 AND y >= 0 AND x < 260 AND y < 390 GROUP BY page")
def f16_word_regions(spark, sf_dir):
    """Pixels of a page of 260 by 390 that lie in a padded word box, here boxes of one pixel and a padding of one."""
    from ..functions.images import only_words

    def run(keys: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        page = only_words(np.ones((390, 260), np.uint8), [(y, y + 1, x, x + 1) for x, y in zip(pdf["x"], pdf["y"])], 1)
        return pd.DataFrame({"page": [keys[0]], "n": [int(page.sum())]})

    rows = boxes(spark, sf_dir).selectExpr("page", "l div 8 AS x", "t div 8 AS y").distinct()
    return rows.groupBy("page").applyInPandas(run, "page string, n long")
