"""Readers of the corpus: explicit schemas, no inference, Spark's own readers wherever they exist."""

from __future__ import annotations

import fnmatch
import io
import struct
import zipfile
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import schemas
from ..functions.images import tiff_info


def page_of(path: str = "_metadata.file_path") -> tuple:
    """(doc, page) from a file's path: its folder and its name without ending."""
    p = F.col(path)
    return F.regexp_extract(p, r"([^/]+)/[^/]+$", 1).alias("doc"), F.regexp_replace(F.regexp_extract(p, r"([^/]+)$", 1), r"\.[^.]+$", "").alias("page")


def packed(files: DataFrame) -> DataFrame:
    """Rows of files in fewer, larger tasks: Spark deals small files to tasks by 32 or fewer, whose start takes longer than the files.

    Up to 16 of Spark's tasks become one, and at least four a core are left. Arrow batches stay bounded by bytes.
    """
    n = files.rdd.getNumPartitions()
    least = 4 * files.sparkSession.sparkContext.defaultParallelism
    return files.coalesce(max(least, n // 16)) if n > least else files


def discover(spark: SparkSession, root: str) -> DataFrame:
    """(source, kind): PDF files below the root, and folders with TIFF files, in order of name."""
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{pdf,PDF,tif,TIF,tiff,TIFF}").load(root).select("path")
    pdf = F.lower("path").endswith(".pdf")
    source = F.when(pdf, F.col("path")).otherwise(F.regexp_replace("path", "/[^/]+$", ""))
    return listing.select(source.alias("source"), F.when(pdf, "pdf").otherwise("tiff").alias("kind")).distinct().orderBy("source")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(doc, page, height, width, pixels): grey images; unreadable files are left out."""
    rows = packed(spark.read.format("image").option("dropInvalid", "true").load(path))
    return rows.filter("image.nChannels = 1").select(*page_of("image.origin"), F.col("image.height").alias("height"), F.col("image.width").alias("width"), F.col("image.data").alias("pixels"))


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """(doc, page, word_idx, tblr, polygon, text, scores, chars): one JSON array of words a page."""
    text = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
    rows = text.select(*page_of(), F.from_json("value", f"array<struct<{', '.join(_struct_fields(schemas.WORDS_JSON))}>>").alias("words"))
    rows = rows.select("doc", "page", F.posexplode("words").alias("word_idx", "w"))
    return rows.select("doc", "page", "word_idx", "w.*")


def _struct_fields(ddl: str) -> list[str]:
    """Top-level fields of a schema string in the form that struct<> takes."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(ddl + ","):
        depth += {"<": 1, ">": -1}.get(c, 0)
        if c == "," and depth == 0:
            name, kind = ddl[start:i].strip().split(" ", 1)
            out.append(f"{name}: {kind}")
            start = i + 1
    return out


def read_npz(spark: SparkSession, path: str, keys: tuple[str, ...] = ("char_imgs", "char_labels", "char_word_idx")) -> DataFrame:
    """(doc, page, char_idx, word_idx, label, img) of compressed array files; pages without characters give no rows, nor
    do damaged files: validate.page_arrays finds pages that are missing."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*_data.npz").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def run(batches):
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"]):
                try:
                    with np.load(io.BytesIO(content), allow_pickle=False) as z:
                        imgs, labels, words = (z[k] for k in keys)
                except (ValueError, KeyError, EOFError, OSError, zipfile.BadZipFile, zlib.error):
                    continue
                doc, page = name.rsplit("/", 2)[-2], name.rsplit("/", 1)[-1].removesuffix("_data.npz")
                yield pd.DataFrame({"doc": doc, "page": page, "char_idx": np.arange(len(imgs), dtype=np.int32), "word_idx": words.astype(np.int32), "label": labels.astype(str), "img": list(imgs.reshape(len(imgs), -1).astype(np.float32))})

    return files.mapInPandas(run, "doc string, page string, char_idx int, word_idx int, label string, img array<float>")


def _info(content: bytes) -> dict:
    """The size and resolution of a TIFF file, nothing of a damaged one."""
    try:
        return tiff_info(content)
    except (ValueError, IndexError, KeyError, struct.error):
        return {}


def read_tiff_info(spark: SparkSession, path: str) -> DataFrame:
    """(doc, page, width_px, height_px, dpi_width, dpi_height) from the tags of TIFF files; nulls for damaged ones."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{tif,tiff}").option("recursiveFileLookup", "true").load(path).select(*page_of("path"), "content")

    def run(batches):
        for pdf in batches:
            info = pd.DataFrame([_info(c) for c in pdf["content"]], columns=["width_px", "height_px", "dpi_width", "dpi_height"])
            yield pd.concat([pdf[["doc", "page"]].reset_index(drop=True), info], axis=1).astype({c: float for c in info})

    return files.mapInPandas(run, "doc string, page string, width_px double, height_px double, dpi_width double, dpi_height double")


def prefer_metadata(names: list[str]) -> str | None:
    """The metadata file of a corpus: by `table`, `corpus` or `meta` in its name, else the first."""
    for pattern in ("*table*.csv", "*corpus*.csv", "*meta*.csv", "*.csv"):
        if found := sorted(n for n in names if fnmatch.fnmatch(n.rsplit("/", 1)[-1], pattern)):
            return found[0]
    return None


def read_metadata(spark: SparkSession, folder: str) -> DataFrame | None:
    """(row, Index, Printer, FileName, Remarks) of the corpus's metadata file; None without one that has FileName."""
    paths = [r[0] for r in spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(folder).select("path").collect()]
    chosen = prefer_metadata(paths)
    if chosen is None:
        return None
    rows = spark.read.option("header", "true").option("enforceSchema", "false").csv(chosen)
    if "FileName" not in rows.columns:
        return None
    # one small file: ids ascend in the order of its lines
    take = lambda c, kind: (F.col(c) if c in rows.columns else F.lit(None)).cast(kind).alias(c)
    return rows.select(F.monotonically_increasing_id().alias("row"), take("Index", "int"), take("Printer", "string"), take("FileName", "string"), take("Remarks", "string"))


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    from ..operators.documents import clean_catalogue

    return clean_catalogue(spark.read.schema(schemas.CATALOGUE).option("header", "true").csv(path))


def read_dpi(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.DPI).option("header", "true").csv(path)


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    from ..operators.documents import lexicon_entries

    return lexicon_entries(spark.read.text(path))


def read_char_dict(spark: SparkSession, path: str) -> DataFrame:
    """(char, id): characters in upper case; the separator is the unit separator."""
    rows = spark.read.schema(schemas.CHAR_DICT).option("sep", "\u001f").option("quote", "").csv(path)
    return rows.select(F.upper("char").alias("char"), "id")
