"""Documents, pages and their resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.text import printer_or_unknown, rounded_dpi


def page_tasks(pages: DataFrame, words: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """Pages that have words and no result yet."""
    return pages.join(words.select(*key).distinct(), key, "left_semi").join(done.select(*key).distinct(), key, "left_anti")


def clean_catalogue(rows: DataFrame, column: str = "Signature") -> DataFrame:
    return rows.select(F.trim(column).alias(column)).filter(F.col(column) != "")


def lexicon_entries(lines: DataFrame, column: str = "value") -> DataFrame:
    """The entries of a word list: lines that don't begin with #, without white space around."""
    return lines.filter(~F.startswith(F.col(column), F.lit("#"))).select(F.regexp_replace(column, r"^\s+|\s+$", "").alias("entry"))


def index_map(metadata: DataFrame) -> DataFrame:
    """(doc, index, printer): zero-based index and printer, blank printers as unknown."""
    return metadata.select(F.col("FileName").alias("doc"), (F.col("Index") - 1).alias("index"), printer_or_unknown(F.col("Printer")).alias("printer"))


def ordered_documents(documents: DataFrame, index: DataFrame, last: int = 9999) -> DataFrame:
    """(doc, place): by index, those without one last, then by name. One row a document: a small table."""
    rows = documents.select("doc").distinct().join(index.select("doc", "index"), "doc", "left")
    return rows.select("doc", F.row_number().over(Window.orderBy(F.coalesce("index", F.lit(last)), "doc")).alias("place"))


def reordered(pairs: DataFrame, places: DataFrame) -> DataFrame:
    """Pairs by the places of both documents instead of their names."""
    a, b = places.select(F.col("doc").alias("doc_a"), F.col("place").alias("row")), places.select(F.col("doc").alias("doc_b"), F.col("place").alias("col"))
    return pairs.join(a, "doc_a").join(b, "doc_b")


def physical_size(rows: DataFrame) -> DataFrame:
    """Inches, centimetres and resolution from pixels and points (1/72 inch); null where a page has no size."""
    out = rows
    for side in ("width", "height"):
        inches = F.col(f"{side}_pt") / 72
        out = out.withColumn(f"{side}_in", inches).withColumn(f"{side}_cm", inches * 2.54).withColumn(f"dpi_{side}", F.try_divide(F.col(f"{side}_px").cast("double"), inches))
    return out


def size_from_dpi(rows: DataFrame) -> DataFrame:
    """Inches and centimetres from pixels and resolution; null where the resolution is null or zero."""
    out = rows
    for side in ("width", "height"):
        inches = F.try_divide(F.col(f"{side}_px").cast("double"), F.col(f"dpi_{side}"))
        out = out.withColumn(f"{side}_in", inches).withColumn(f"{side}_cm", inches * 2.54)
    return out


def document_dpi(rows: DataFrame, fallback: int = 150) -> DataFrame:
    """(doc, dpi): the median over both axes of all pages, rounded to 50."""
    both = rows.select("doc", F.explode(F.array("dpi_width", "dpi_height")).alias("dpi"))
    return both.groupBy("doc").agg(rounded_dpi(F.percentile("dpi", F.lit(0.5)), fallback=fallback).alias("dpi"))


def status_counts(rows: DataFrame) -> DataFrame:
    """(status, n): the word before the colon of a status line."""
    return rows.groupBy(F.regexp_extract("status", r"^(\w+)", 1).alias("status")).agg(F.count("*").alias("n"))
