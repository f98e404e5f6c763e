"""Scans to pages: PDF and TIFF files as rows, and as PNG files at one resolution."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import scans
from ..functions.images import png_bytes, tiff_info
from ..operators.documents import document_dpi
from .files import packed, page_of
from .sinks import write_files

#: Handlers of documents that need their own way of making a page, by name; the default takes the first image.
SPECIAL: dict[str, Callable[[scans.PdfPage], object]] = {}


def special(name: str):
    """Registers a handler for the PDF files of this name, for instance scans.layered."""

    def add(f):
        SPECIAL[name] = f
        return f

    return add


def _failed(doc: str, page: int | None, name: str | None, error: Exception) -> tuple:
    return (doc, page, name, *[None] * (len(_NAMES) - 4), f"ERROR: {type(error).__name__}")


def _typed(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=_NAMES)
    for c in ("page", "height", "width", "n_images"):
        out[c] = out[c].astype("Int32")
    for c in ("width_px", "height_px", "width_pt", "height_pt", "dpi_width", "dpi_height"):
        out[c] = out[c].astype(float)
    return out


def _first(page: scans.PdfPage):
    return page.images[0].pixels() if page.images else None


SCAN = "doc string, page int, name string, width_px double, height_px double, width_pt double, height_pt double, dpi_width double, dpi_height double, n_images int, height int, width int, pixels binary, jpeg binary, status string"
#: What a damaged file makes the decoders raise; such a file or page is a row with a status, not the end of the job.
_DAMAGED = (ValueError, IndexError, KeyError, TypeError, OverflowError, RecursionError, MemoryError, struct.error, zlib.error)
_NAMES = [x.strip().split(" ")[0] for x in SCAN.split(",")]


def read_pdf(spark: SparkSession, path: str, default: Callable[[scans.PdfPage], object] = _first) -> DataFrame:
    """One row a page that has an image, with the page's size in points and its pixels in grey.

    default makes a page's pixels where no handler is registered for the document. JPEG images are in `jpeg` instead
    of `pixels`; convert has Spark's image source decode them. `status` is OK, SKIP and the coding of an image that
    isn't read here, or ERROR and what went wrong: with a page, or (page null) with the whole file.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{pdf,PDF}").option("recursiveFileLookup", "true").load(path).select("path", "content")
    handlers = dict(SPECIAL)

    def page_row(doc: str, n: int, page: scans.PdfPage) -> tuple:
        first = page.images[0]
        img = handlers.get(doc, default)(page)
        inches = (page.width_pt / 72, page.height_pt / 72)
        dpi = [px / x if x else None for px, x in zip((first.width, first.height), inches)]
        img = None if img is None else scans.grey(img)
        jpeg = first.data if img is None and first.coding == "DCTDecode" else None
        status = "OK" if img is not None or jpeg is not None else f"SKIP: {first.coding or 'depth'}"
        shape = (None, None) if img is None else img.shape
        return (doc, n, f"page_{n}", first.width, first.height, page.width_pt, page.height_pt, *dpi, len(page.images), *shape, None if img is None else img.tobytes(), jpeg, status)

    def run(batches):
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"]):
                doc = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
                try:
                    pages = list(scans.Pdf(content).pages())
                except _DAMAGED as e:
                    rows.append(_failed(doc, None, None, e))
                    continue
                for n, page in enumerate(pages):
                    if page.images:
                        try:
                            rows.append(page_row(doc, n, page))
                        except _DAMAGED as e:
                            rows.append(_failed(doc, n, f"page_{n}", e))
            yield _typed(rows)

    return packed(files).mapInPandas(run, SCAN)


def read_tiff(spark: SparkSession, path: str) -> DataFrame:
    """The same for TIFF files: a folder is a document, its files in order of name are the pages."""
    found = _tiffs(spark, path)
    files = found.select(*page_of("path"), "content")

    def run(batches):
        for pdf in batches:
            rows = []
            for doc, page, content in zip(pdf["doc"], pdf["page"], pdf["content"]):
                try:
                    info, img = tiff_info(content), scans.grey(scans.tiff_pixels(content))
                except _DAMAGED as e:
                    rows.append(_failed(doc, None, page, e))
                    continue
                rows.append((doc, None, page, info["width_px"], info["height_px"], None, None, info["dpi_width"], info["dpi_height"], 1, *img.shape, img.tobytes(), None, "OK"))
            yield _typed(rows)

    rows = packed(files).mapInPandas(run, SCAN).drop("page")
    return rows.join(_numbered(found), ["doc", "name"]).select(*_NAMES)


def tiff_pages(spark: SparkSession, path: str) -> DataFrame:
    """(doc, name, page) of TIFF files by their names alone, numbered as read_tiff does."""
    return _numbered(_tiffs(spark, path))


def _tiffs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.{tif,tiff,TIF,TIFF}").option("recursiveFileLookup", "true").load(path)


def _numbered(found: DataFrame) -> DataFrame:
    """(doc, name, page): a document's names in order; files of one name share the first one's number."""
    doc, name = page_of("path")
    place = F.rank().over(Window.partitionBy("doc").orderBy("name"))
    return packed(found.select(doc, name.alias("name"))).withColumn("page", (place - 1).cast("int")).distinct()


def decoded(pages: DataFrame, folder: str) -> DataFrame:
    """The pages with the pixels of their JPEG images, which Spark's image source reads from files below the folder.

    A JPEG image that it can't read keeps null pixels and gets a status of its own. The files stay until the caller
    removes the folder, as the result reads them.
    """
    spark = pages.sparkSession
    jpegs = pages.filter("jpeg IS NOT NULL AND pixels IS NULL")
    files = write_files(jpegs.withColumn("file", F.concat("doc", F.lit("/"), F.col("page").cast("string"), F.lit(".jpg"))), folder, "file", "jpeg")
    # the files must be there before they are listed
    if not files.count():
        return pages
    image = spark.read.format("image").option("dropInvalid", "true").option("recursiveFileLookup", "true").load(folder).select("image.*")

    @F.pandas_udf("binary")
    def luma(h: pd.Series, w: pd.Series, n: pd.Series, data: pd.Series) -> pd.Series:
        import numpy as np

        # blue, green, red (and alpha)
        return pd.Series([scans.grey(i[..., 0] if c == 1 else i[..., 2::-1]).tobytes() for i, c in ((np.frombuffer(d, np.uint8).reshape(a, b, c), c) for a, b, c, d in zip(h, w, n, data))])

    got = image.select(*page_of("origin"), F.col("height").alias("h"), F.col("width").alias("w"), luma("height", "width", "nChannels", "data").alias("p")).withColumn("page", F.col("page").cast("int"))
    rows = pages.join(got, ["doc", "page"], "left")
    lost = F.col("jpeg").isNotNull() & F.col("pixels").isNull() & F.col("p").isNull()
    new = {"height": F.coalesce("height", "h"), "width": F.coalesce("width", "w"), "pixels": F.coalesce("pixels", "p"), "status": F.when(lost, F.lit("ERROR: JPEG")).otherwise(F.col("status"))}
    return rows.select(*(new.get(c, F.col(c)).alias(c) for c in pages.columns))


def convert(pages: DataFrame, folder: str, target_dpi: int = 150, dpi: DataFrame | None = None) -> DataFrame:
    """Writes each page as grey PNG at the target resolution below the folder; (path, bytes) of the files.

    dpi: (doc, dpi) where it is known from elsewhere; else the rounded median of the document's pages. Pages without
    pixels, be they damaged or of a coding that isn't read, give no file: unread(pages) lists them with their status.
    JPEG images are decoded by way of files below `_jpeg` in the folder, which Spark's readers of the folder pass over.
    """
    # what is asked of all pages before any is written, kept so that files are read for it only once
    slim = pages.select("doc", "dpi_width", "dpi_height", (F.col("jpeg").isNotNull() & F.col("pixels").isNull()).alias("coded")).persist()
    if slim.filter("coded").limit(1).count():
        pages = decoded(pages, f"{folder.rstrip('/')}/_jpeg")
    own = document_dpi(slim).withColumnRenamed("dpi", "own")
    known = (dpi if dpi is not None else own.select("doc", F.lit(None).cast("int").alias("dpi"))).select("doc", "dpi")
    rows = pages.filter("pixels IS NOT NULL").join(own, "doc").join(known, "doc", "left").withColumn("original", F.coalesce("dpi", "own").cast("double"))

    @F.pandas_udf("binary")
    def encode(h: pd.Series, w: pd.Series, pixels: pd.Series, original: pd.Series) -> pd.Series:
        import numpy as np

        images = (np.frombuffer(p, np.uint8).reshape(a, b) for p, a, b in zip(pixels, h, w))
        return pd.Series([png_bytes(scans.rescaled(i, o, target_dpi), target_dpi) for i, o in zip(images, original)])

    named = rows.withColumn("name", F.concat("doc", F.lit("/page_"), F.col("page").cast("string"), F.lit(".png")))
    return write_files(named.withColumn("png", encode("height", "width", "pixels", "original")), folder)


def unread(pages: DataFrame) -> DataFrame:
    """(doc, page, name, status) of the files and pages that give no image."""
    return pages.filter("status <> 'OK'").select("doc", "page", "name", "status")
