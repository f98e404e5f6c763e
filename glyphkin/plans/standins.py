"""The analysis's tables derived from the driver's: there are no page images, so these stand in for them.

Each table is defined twice, as a DataFrame and as a SQL common table expression, by the same arithmetic on keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .registry import table

#: Documents of the stand-in corpus, and digits to which distances are rounded before they are compared.
DOCS, DIGITS = 8, 6


def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster means: one embedding a cluster, its label the letter."""
    return table(spark, sf_dir, "embeddings").selectExpr(
        "vec_id AS cluster_id", f"concat('d', vec_id % {DOCS}) AS doc", "chr(97 + label) AS letter", "1 + (vec_id * 37) % 97 AS n",
        "((vec_id * 53) % 10) / 10D AS italic", "(50 + (vec_id * 29) % 51) / 100D AS share", "CAST(embedding AS array<double>) AS v",
    )


CLUSTERS = f"""cl AS (SELECT vec_id AS cluster_id, 'd' || (vec_id % {DOCS})::VARCHAR AS doc, chr((97 + label)::INTEGER) AS letter,
    1 + (vec_id * 37) % 97 AS n, ((vec_id * 53) % 10) / 10::DOUBLE AS italic, (50 + (vec_id * 29) % 51) / 100::DOUBLE AS share,
    embedding::DOUBLE[] AS v FROM embeddings)"""

SELECTED = f"""{CLUSTERS},
    st AS (SELECT *, CASE WHEN italic <= 0.1 THEN 'roman' WHEN italic >= 0.4 THEN 'italic' END AS style FROM cl WHERE share >= 0.6 AND letter NOT IN (',', '.', ';', ':')),
    sel AS (SELECT * FROM st WHERE style IS NOT NULL QUALIFY row_number() OVER (PARTITION BY style, doc, letter ORDER BY n DESC, cluster_id) <= 5)"""

COVERED = f"""{SELECTED},
    cov AS (SELECT style, letter, count(DISTINCT doc) AS n_docs FROM sel GROUP BY ALL HAVING count(DISTINCT doc) >= (SELECT count(DISTINCT doc) FROM cl) * 0.33::DOUBLE)"""

DISTANCES = f"""{COVERED},
    pr AS (SELECT a.style, a.letter, a.doc AS doc_a, b.doc AS doc_b, a.cluster_id AS ca, b.cluster_id AS cb, round(1 - list_cosine_similarity(a.v, b.v), {DIGITS}) AS d
           FROM sel a JOIN sel b ON a.style = b.style AND a.letter = b.letter AND a.doc < b.doc JOIN cov ON cov.style = a.style AND cov.letter = a.letter),
    dd AS (SELECT style, letter, doc_a, doc_b, min(d) AS dist FROM pr GROUP BY ALL),
    ds AS (SELECT * FROM dd QUALIFY max(dist) OVER (PARTITION BY style, letter) > 0)"""


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words with the direction of their strokes: one event a word."""
    return table(spark, sf_dir, "events").selectExpr(
        f"concat('d', user_id % {DOCS}) AS doc", "concat('p', event_id % 5) AS page", "event_id AS word_idx",
        "CAST(((event_id * 53) % 40) * 25 AS int) AS t", "CAST(((event_id * 53) % 40) * 25 + 20 AS int) AS b",
        "CAST(((event_id * 37) % 41) * 50 AS int) AS l", "CAST(((event_id * 37) % 41) * 50 + 45 AS int) AS r", "event_type AS text",
        "CASE WHEN event_id % 13 = 0 THEN -360D WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 19 = 0 THEN double('NaN') ELSE value END AS stroke",
    )


WORDS = f"""wd AS (SELECT 'd' || (user_id % {DOCS})::VARCHAR AS doc, 'p' || (event_id % 5)::VARCHAR AS page, event_id AS word_idx,
    (((event_id * 53) % 40) * 25)::INTEGER AS t, (((event_id * 53) % 40) * 25 + 20)::INTEGER AS b, (((event_id * 37) % 41) * 50)::INTEGER AS l, (((event_id * 37) % 41) * 50 + 45)::INTEGER AS r, event_type AS text,
    CASE WHEN event_id % 13 = 0 THEN -360::DOUBLE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 19 = 0 THEN 'NaN'::DOUBLE ELSE value END AS stroke FROM events)"""

VALID = "stroke IS NOT NULL AND NOT isnan(stroke) AND stroke <> -360"


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slanted word boxes: one order line a box. `polygon` is flat, in whole numbers."""
    rows = table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey AS k", "l_linenumber AS j", "concat('p', l_orderkey % 200) AS page", "CAST((l_orderkey * l_orderkey * 31 + l_linenumber * 211) % 1999 AS int) AS l",
        "CAST((l_orderkey * l_orderkey * 17 + l_orderkey * 7 + l_linenumber * 1013) % 2999 AS int) AS t", "CAST(20 + l_quantity * 2 AS int) AS w", "CAST(12 + l_linenumber AS int) AS h", "l_discount AS score", "l_tax AS tax",
    )
    return rows.selectExpr("*", "array(l, t, l + w, t + 2, l + w - 3, t + h, l - 3, t + h - 2) AS polygon")


BOXES = """bx AS (SELECT *, [l, t, l + w, t + 2, l + w - 3, t + h, l - 3, t + h - 2] AS polygon FROM (
    SELECT l_orderkey AS k, l_linenumber AS j, 'p' || (l_orderkey % 200)::VARCHAR AS page, ((l_orderkey * l_orderkey * 31 + l_linenumber * 211) % 1999)::INTEGER AS l,
    ((l_orderkey * l_orderkey * 17 + l_orderkey * 7 + l_linenumber * 1013) % 2999)::INTEGER AS t, (20 + l_quantity * 2)::INTEGER AS w, (12 + l_linenumber)::INTEGER AS h, l_discount AS score, l_tax AS tax FROM lineitem))"""


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document metadata: one supplier a document; some printers are blank."""
    return table(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey AS row", "s_name AS FileName", "CASE WHEN s_suppkey % 7 = 0 THEN '  ' WHEN s_suppkey % 11 = 0 THEN NULL ELSE concat('Printer of ', s_nationkey) END AS Printer",
        "CASE WHEN s_suppkey % 5 = 0 THEN 'hidden' WHEN s_suppkey % 3 = 0 THEN 'new' END AS Remarks", "CAST(s_suppkey + 1 AS int) AS `Index`",
    )


METADATA = """md AS (SELECT s_suppkey AS row, s_name AS FileName, CASE WHEN s_suppkey % 7 = 0 THEN '  ' WHEN s_suppkey % 11 = 0 THEN NULL ELSE 'Printer of ' || s_nationkey::VARCHAR END AS Printer,
    CASE WHEN s_suppkey % 5 = 0 THEN 'hidden' WHEN s_suppkey % 3 = 0 THEN 'new' END AS Remarks, (s_suppkey + 1)::INTEGER AS "Index" FROM supplier)"""


def chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters in clusters: one order line a character; images of five pixels."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "concat('d', l_suppkey % 10) AS doc", "l_partkey % 20 AS cluster", "CASE WHEN l_orderkey % 3 < 2 THEN chr(65 + l_partkey % 4) ELSE l_returnflag END AS label", "l_linestatus = 'O' AS is_italic", "l_orderkey AS k", "l_linenumber AS j",
        "array(l_discount, l_tax, l_quantity / 50, CASE WHEN l_orderkey % 101 = 0 THEN double('NaN') ELSE 0D END, 0D) AS img",
    )


CHARS = """ch AS (SELECT 'd' || (l_suppkey % 10)::VARCHAR AS doc, l_partkey % 20 AS cluster, CASE WHEN l_orderkey % 3 < 2 THEN chr((65 + l_partkey % 4)::INTEGER) ELSE l_returnflag END AS label, l_linestatus = 'O' AS is_italic, l_orderkey AS k, l_linenumber AS j,
    [l_discount, l_tax, l_quantity / 50, CASE WHEN l_orderkey % 101 = 0 THEN 'NaN'::DOUBLE ELSE 0::DOUBLE END, 0::DOUBLE] AS img FROM lineitem)"""
