"""Names, files, metadata, resolution, sources, sinks and checks: queries on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import documents as docs, matching, validate
from ..sources import sinks
from ..storage import shared_folder as scratch
from .registry import query, table
from .standins import CLUSTERS, METADATA, WORDS, clusters, metadata, words


def word_list(name: str, source: str) -> str:
    """A common table expression with the distinct words of three letters a-z or more in a table's texts."""
    return f"{name} AS (SELECT DISTINCT w AS word FROM (SELECT unnest(string_split_regex(lower(text), '[^a-z]+')) AS w FROM {source}) WHERE length(w) >= 3)"


def tokens(spark, sf_dir, name):
    rows = table(spark, sf_dir, name).select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("word"))
    return rows.filter(F.length("word") >= 3).distinct()


@query("SELECT d.doc_id FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) AND NOT EXISTS (SELECT 1 FROM benchmark b WHERE b.item_id = d.doc_id)")
def s6_page_tasks(spark, sf_dir):
    """Documents stand for pages, labels for their words, benchmark ids for finished ones."""
    pages = table(spark, sf_dir, "documents").select("doc_id")
    done = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"))
    return docs.page_tasks(pages, table(spark, sf_dir, "labels"), done, ["doc_id"])


@query("SELECT count(*) AS n FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def j13_unfinished(spark, sf_dir):
    left = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti")
    return left.agg(F.count("*").alias("n"))


@query("SELECT d.doc_id FROM documents d SEMI JOIN labels l ON l.doc_id = d.doc_id")
def j12_pages_with_words(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")


@query("SELECT trim(x) AS Signature FROM (SELECT CASE WHEN p_partkey % 9 = 0 THEN '   ' ELSE ' ' || p_brand || '/' || p_partkey::VARCHAR || '  ' END AS x FROM part) WHERE trim(x) <> ''")
def s11_catalogue(spark, sf_dir):
    raw = table(spark, sf_dir, "part").selectExpr("CASE WHEN p_partkey % 9 = 0 THEN '   ' ELSE concat(' ', p_brand, '/', p_partkey, '  ') END AS Signature")
    return docs.clean_catalogue(raw)


@query("SELECT trim(line) AS entry FROM (SELECT CASE WHEN c_custkey % 10 = 0 THEN '# ' ELSE ' ' END || c_mktsegment || ' ' AS line FROM customer) WHERE NOT starts_with(line, '#')")
def s12_lexicon(spark, sf_dir):
    lines = table(spark, sf_dir, "customer").selectExpr("concat(CASE WHEN c_custkey % 10 = 0 THEN '# ' ELSE ' ' END, c_mktsegment, ' ') AS value")
    return docs.lexicon_entries(lines)


@query(f"WITH {METADATA} SELECT FileName AS doc, \"Index\" - 1 AS index, coalesce(nullif(trim(Printer), ''), 'unknown') AS printer FROM md")
def s17_index_map(spark, sf_dir):
    return docs.index_map(metadata(spark, sf_dir))


@query(f"WITH {METADATA}, ix AS (SELECT FileName AS doc, \"Index\" - 1 AS index FROM md WHERE row % 3 <> 0) SELECT doc, (row_number() OVER (ORDER BY coalesce(index, 9999), doc))::INTEGER AS place FROM (SELECT FileName AS doc FROM md) LEFT JOIN ix USING (doc)")
def s16_ordered_documents(spark, sf_dir):
    m = metadata(spark, sf_dir)
    return docs.ordered_documents(m.select(F.col("FileName").alias("doc")), docs.index_map(m.filter("row % 3 <> 0")))


@query("SELECT s_suppkey, (row_number() OVER (ORDER BY (s_suppkey * 37) % 101, s_suppkey))::INTEGER AS place FROM supplier")
def w10_index_order(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").selectExpr("lpad(s_suppkey, 9, '0') AS doc", "(s_suppkey * 37) % 101 AS index")
    return docs.ordered_documents(s, s).select(F.col("doc").cast("long").alias("s_suppkey"), "place")


@query(f"WITH {METADATA}, dc AS (SELECT CASE WHEN c_custkey % 2 = 0 THEN 'Supplier#' || right(c_name, 9) ELSE right(c_name, 4) END AS doc FROM customer), "
       "ex AS (SELECT dc.doc, min({'row': row, 'printer': Printer, 'remark': Remarks, 'index': \"Index\"}) AS m FROM (SELECT DISTINCT doc FROM dc) dc JOIN md ON FileName = doc GROUP BY dc.doc), "
       "pa AS (SELECT dc.doc, min({'row': row, 'printer': Printer, 'remark': Remarks, 'index': \"Index\"}) AS m FROM (SELECT DISTINCT doc FROM dc WHERE doc NOT IN (SELECT doc FROM ex)) dc JOIN md ON contains(FileName, doc) OR contains(doc, FileName) GROUP BY dc.doc), "
       "al AS (SELECT * FROM ex UNION ALL SELECT * FROM pa) SELECT d.doc, coalesce(m.printer, 'unknown') AS printer, coalesce(m.remark, 'nan') AS remark, coalesce(m.index, -1)::INTEGER AS index FROM (SELECT DISTINCT doc FROM dc) d LEFT JOIN al ON al.doc = d.doc")  # fmt: skip
def j6_metadata(spark, sf_dir):
    """Customers named like suppliers, or like the end of their names, stand for documents."""
    c = table(spark, sf_dir, "customer").selectExpr("CASE WHEN c_custkey % 2 = 0 THEN concat('Supplier#', right(c_name, 9)) ELSE right(c_name, 4) END AS doc")
    return matching.with_metadata(c, metadata(spark, sf_dir))


FILES = "fl AS (SELECT DISTINCT 'scan_' || replace(p_brand, '#', '-') || '-' || (p_partkey % 40)::VARCHAR || '.pdf' AS file FROM part)"
CATALOGUE = "sg AS (SELECT DISTINCT CASE WHEN p_partkey % 17 = 0 THEN 'Brand-?/' || (p_partkey % 40)::VARCHAR WHEN p_partkey % 13 = 0 THEN 'none/' || p_partkey::VARCHAR ELSE replace(p_brand, '#', '/') || '/' || (p_partkey % 40)::VARCHAR END AS Signature FROM part WHERE p_size < 5)"


@query(f"WITH {FILES}, {CATALOGUE} SELECT Signature, file FROM sg LEFT JOIN fl ON file LIKE '%' || replace(replace(replace(Signature, '/', '-'), '_', '!_'), '?', '_') || '.pdf' ESCAPE '!'")
def j10_files_of_signatures(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    files = part.selectExpr("concat('scan_', replace(p_brand, '#', '-'), '-', p_partkey % 40, '.pdf') AS file")
    catalogue = part.filter("p_size < 5").selectExpr("CASE WHEN p_partkey % 17 = 0 THEN concat('Brand-?/', p_partkey % 40) WHEN p_partkey % 13 = 0 THEN concat('none/', p_partkey) ELSE concat(replace(p_brand, '#', '/'), '/', p_partkey % 40) END AS Signature")
    return matching.files_of_signatures(catalogue, files)


@query(f"WITH {FILES}, {CATALOGUE.replace(' WHERE p_size < 5', '')} SELECT Signature, file FROM sg LEFT JOIN fl ON file LIKE '%' || replace(replace(replace(Signature, '/', '-'), '_', '!_'), '?', '_') || '.pdf' ESCAPE '!'")
def j10_files_of_all_signatures(spark, sf_dir):
    """The whole catalogue; j10_files_of_signatures takes small parts only."""
    part = table(spark, sf_dir, "part")
    files = part.selectExpr("concat('scan_', replace(p_brand, '#', '-'), '-', p_partkey % 40, '.pdf') AS file")
    catalogue = part.selectExpr("CASE WHEN p_partkey % 17 = 0 THEN concat('Brand-?/', p_partkey % 40) WHEN p_partkey % 13 = 0 THEN concat('none/', p_partkey) ELSE concat(replace(p_brand, '#', '/'), '/', p_partkey % 40) END AS Signature")
    return matching.files_of_signatures(catalogue, files)


@query("SELECT p_partkey, '%' || replace(p_brand || '/' || p_partkey::VARCHAR, '/', '-') || '.pdf' AS pattern FROM part")
def p14_signature_patterns(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", tx.signature_pattern(F.concat("p_brand", F.lit("/"), F.col("p_partkey").cast("string"))).alias("pattern"))


@query("SELECT p_partkey, CASE WHEN p_name = 'red widget' THEN 'RW' ELSE string_split(p_name, ' ')[-1] END AS short FROM part")
def p15_short_names(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", tx.short_name(F.col("p_name"), names={"red widget": "RW"}).alias("short"))


@query("SELECT p_type AS doc, greatest((round_even(quantile_cont(x, 0.5) / 50, 0) * 50)::INTEGER, 50) AS dpi FROM (SELECT p_type, unnest([p_size * 7::DOUBLE, p_retailprice / 4]) AS x FROM part) GROUP BY p_type")
def a9_document_dpi(spark, sf_dir):
    return docs.document_dpi(table(spark, sf_dir, "part").selectExpr("p_type AS doc", "p_size * 7D AS dpi_width", "p_retailprice / 4 AS dpi_height"))


@query("SELECT p_partkey, greatest((round_even(p_size * 12.5::DOUBLE / 50, 0) * 50)::INTEGER, 50) AS dpi FROM part")
def p11_rounded_dpi(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", tx.rounded_dpi(F.col("p_size") * F.lit(12.5)).alias("dpi"))


@query("SELECT p_partkey, CASE WHEN abs(150 / (p_size + 140)::DOUBLE - 1) > 0.01 THEN round(150 / (p_size + 140)::DOUBLE, 6) ELSE 1 END AS scale FROM part")
def p12_resize_scale(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.round(tx.resize_scale(F.lit(150.0), (F.col("p_size") + 140).cast("double")), 6).alias("scale"))


@query("SELECT p_partkey, (round_even(h / (h / 2280) / 128, 0) * 128)::INTEGER AS h, (round_even(w / (h / 2280) / 128, 0) * 128)::INTEGER AS w FROM (SELECT p_partkey, p_retailprice AS h, p_retailprice / 2 + p_size * 9 AS w FROM part)")
def p21_network_size(spark, sf_dir):
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey", "p_retailprice AS h", "p_retailprice / 2 + p_size * 9 AS w")
    return rows.select("p_partkey", tx.network_size(F.col("h"), F.col("w"), 2280).alias("x")).select("p_partkey", "x.*")


@query("SELECT p_partkey, round(p_retailprice / 72, 6) AS width_in, round(p_retailprice / 72 * 2.54, 6) AS width_cm, round(p_size / 72::DOUBLE, 6) AS height_in, round(1754 / nullif(p_size / 72::DOUBLE, 0), 6) AS dpi_height, round(1240 / (p_retailprice / 72), 6) AS dpi_width FROM part")
def p13_physical_size(spark, sf_dir):
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey", "p_retailprice AS width_pt", "CAST(p_size AS double) AS height_pt", "1240 AS width_px", "1754 AS height_px")
    return docs.physical_size(rows).select("p_partkey", *(F.round(c, 6).alias(c) for c in ("width_in", "width_cm", "height_in", "dpi_height", "dpi_width")))


@query("SELECT p_partkey, round(1240 / nullif(p_size - 5, 0)::DOUBLE, 6) AS width_in, round(1240 / nullif(p_size - 5, 0)::DOUBLE * 2.54, 6) AS width_cm FROM part")
def s15_size_from_dpi(spark, sf_dir):
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey", "1240 AS width_px", "1754 AS height_px", "CAST(p_size - 5 AS double) AS dpi_width", "300D AS dpi_height")
    return docs.size_from_dpi(rows).select("p_partkey", F.round("width_in", 6).alias("width_in"), F.round("width_cm", 6).alias("width_cm"))


@query("SELECT CASE o_orderstatus WHEN 'O' THEN 'OK' WHEN 'F' THEN 'FAIL' ELSE 'SKIP' END AS status, count(*) AS n FROM orders GROUP BY ALL")
def a18_status_counts(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").selectExpr("concat(CASE o_orderstatus WHEN 'O' THEN 'OK' WHEN 'F' THEN 'FAIL' ELSE 'SKIP' END, ': page ', o_orderkey) AS status")
    return docs.status_counts(rows)


MATCHED = f"""WITH {word_list('lx', 'benchmark')}, {word_list('tk', 'conversations')},
    pr AS (SELECT tk.word, upper(lx.word) AS entry, levenshtein(upper(tk.word), upper(lx.word)) AS distance FROM tk JOIN lx ON abs(length(tk.word) - length(lx.word)) <= 1 WHERE levenshtein(upper(tk.word), upper(lx.word)) <= 1),
    mt AS (SELECT word, min({{'d': distance, 'e': entry}}) AS m FROM pr GROUP BY word)"""


def _matches(spark, sf_dir):
    lexicon = tokens(spark, sf_dir, "benchmark").withColumnRenamed("word", "entry")
    return matching.lexicon_matches(tokens(spark, sf_dir, "conversations"), lexicon, 1)


@query(f"{MATCHED} SELECT word, m.e AS entry, m.d::INTEGER AS distance FROM mt")
def j5_lexicon_matches(spark, sf_dir):
    return _matches(spark, sf_dir)


@query(f"{MATCHED}, wd AS (SELECT word AS text, (75 + (length(word) * 31 + ascii(word) * 7) % 25) / 100::DOUBLE AS text_score FROM tk) SELECT CASE WHEN text_score < 0.98 THEN m.e ELSE text END AS text, text_score, (CASE WHEN text_score < 0.98 THEN m.d ELSE 0 END)::INTEGER AS edits FROM wd LEFT JOIN mt ON mt.word = wd.text WHERE text_score >= 0.98 OR (text_score >= 0.8 AND m.e IS NOT NULL)")
def f13_filtered_words(spark, sf_dir):
    w = tokens(spark, sf_dir, "conversations").selectExpr("word AS text", "(75 + (length(word) * 31 + ascii(word) * 7) % 25) / 100D AS text_score")
    return matching.filter_words(w, _matches(spark, sf_dir))


@query("SELECT l_orderkey AS k, l_linenumber AS j, round(l_discount + l_tax - l_tax / l_quantity * (l_linenumber % 3), 9) AS score FROM lineitem")
def p23_word_scores(spark, sf_dir):
    c = table(spark, sf_dir, "lineitem")
    s = matching.word_score(F.col("l_discount"), F.col("l_tax"), F.col("l_quantity"), F.col("l_linenumber") % 3)
    return c.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("j"), F.round(s, 9).alias("score"))


@query("SELECT event_id, (props->>'$.k')::INTEGER AS k FROM events")
def s7_nested_json(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("SELECT n_nationkey AS id, upper(n_name) AS char FROM nation")
def s13_char_dict(spark, sf_dir):
    """The character table written with the unit separator and read back."""
    from ..sources.files import read_char_dict

    path = scratch(spark)
    table(spark, sf_dir, "nation").selectExpr("lower(n_name) AS n", "n_nationkey AS k").write.option("sep", "\u001f").csv(path)
    return read_char_dict(spark, path)


@query("SELECT 'd' || (conv_id % 5)::VARCHAR AS doc, 'p' || conv_id::VARCHAR AS page, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INTEGER AS word_idx, text, turn::INTEGER AS score FROM conversations")
def k2_words_json(spark, sf_dir):
    """Turns stand for words: a JSON array a page, written and read back."""
    path = scratch(spark)
    rows = table(spark, sf_dir, "conversations").selectExpr("concat('d', conv_id % 5) AS doc", "concat('p', conv_id) AS page", "turn AS word_idx", "text", "CAST(turn AS int) AS score")
    sinks.write_words_json(rows, path)
    return sinks.read_words_json(spark, path, "text: string, score: int")


@query(f"WITH {CLUSTERS} SELECT doc, cluster_id, letter, n FROM cl")
def k6_partitioned_table(spark, sf_dir):
    path = scratch(spark)
    sinks.write_table(clusters(spark, sf_dir).select("doc", "cluster_id", "letter", "n"), path, ("doc",))
    return spark.read.parquet(path).select("doc", "cluster_id", "letter", "n")


@query(f"WITH {CLUSTERS} SELECT doc, count(*) AS n FROM cl GROUP BY doc")
def k12_idempotent_write(spark, sf_dir):
    """Half of the table, then all of it: every row is there once."""
    path = scratch(spark)
    rows = clusters(spark, sf_dir).select("doc", "cluster_id", "n")
    sinks.write_pending(rows.filter("cluster_id % 2 = 0"), path, ["cluster_id"])
    sinks.write_pending(rows, path, ["cluster_id"])
    return spark.read.parquet(path).groupBy("doc").agg(F.count("*").alias("n"))


@query("SELECT 'p' || (p_partkey % 7)::VARCHAR AS suelta, p_partkey::VARCHAR AS page, p_retailprice AS dpi, round(p_size * 2.54::DOUBLE, 6) AS cm FROM part")
def k8_dpi_csv(spark, sf_dir):
    """The resolution table as CSV in folders by source, read back with its schema."""
    from ..sources.files import read_dpi

    path = scratch(spark)
    p = table(spark, sf_dir, "part")
    sides = {"DPI (width)": "p_retailprice", "DPI (height)": "p_retailprice", "width (in)": "CAST(p_size AS double)", "height (in)": "1D", "width (cm)": "p_size * 2.54D", "height (cm)": "2.54D"}
    rows = p.selectExpr("concat('p', p_partkey % 7) AS suelta", "CAST(p_partkey AS string) AS page", *(f"{e} AS `{c}`" for c, e in sides.items()), "'test' AS `Source of physical dimension`")
    sinks.write_dpi(rows, path, per_source=True)
    return read_dpi(spark, path).select("suelta", "page", F.col("`DPI (width)`").alias("dpi"), F.round("`width (cm)`", 6).alias("cm"))


@query("SELECT DISTINCT n_name FROM nation EXCEPT SELECT n_name FROM nation WHERE n_regionkey = 1")
def se4_difference(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    return n.select("n_name").distinct().join(n.filter("n_regionkey = 1").select("n_name"), "n_name", "left_anti")


@query("SELECT DISTINCT p_brand FROM part")
def se5_distinct(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_brand").distinct()


@query("SELECT k, j, error FROM (SELECT l_orderkey AS k, l_linenumber AS j, unnest([CASE WHEN l_linenumber % 7 = 0 THEN 'word: tblr' END, CASE WHEN l_orderkey % 11 = 0 THEN 'char: tblr' END]) AS error FROM lineitem) WHERE error IS NOT NULL")
def v1_check_words(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS k", "l_linenumber AS j", "CASE WHEN l_linenumber % 7 = 0 THEN array(1, 2, 3) ELSE array(1, 2, 3, 4) END AS tblr", "array(named_struct('tblr', CASE WHEN l_orderkey % 11 = 0 THEN CAST(NULL AS array<int>) ELSE array(1, 2, 3, 4) END)) AS chars")
    return validate.check_words(rows, ["k", "j"])


@query("SELECT vec_id, error FROM (SELECT vec_id, unnest([CASE WHEN vec_id % 5 = 0 THEN 'img: size' END, CASE WHEN label = 3 THEN 'label: missing' END]) AS error FROM embeddings) WHERE error IS NOT NULL")
def v2_check_chars(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").selectExpr("vec_id", "CASE WHEN vec_id % 5 = 0 THEN slice(embedding, 1, 9) ELSE embedding END AS img", "CASE WHEN label <> 3 THEN label END AS label", "0 AS word_idx")
    return validate.check_chars(rows, ["vec_id"], 64)


@query(f"WITH {WORDS}, d AS (SELECT doc, count(*) AS c, count(*) FILTER (word_idx % 100 <> 0 OR doc <> 'd1') AS f FROM wd GROUP BY doc) SELECT doc, error FROM (SELECT doc, unnest([CASE WHEN doc = 'd3' THEN 'threshold: missing' END, CASE WHEN c <> f THEN 'flags: count' END]) AS error FROM d) WHERE error IS NOT NULL")
def v3_check_italic(spark, sf_dir):
    w = words(spark, sf_dir)
    flags = w.filter("word_idx % 100 <> 0 OR doc <> 'd1'").select("doc", F.lit(True).alias("is_italic"))
    thresholds = w.select("doc").distinct().withColumn("threshold", F.when(F.col("doc") != "d3", F.lit(1.0)))
    return validate.check_italic(thresholds, w, flags)


@query(f"WITH {CLUSTERS} SELECT doc, cluster_id, error FROM (SELECT doc, cluster_id, unnest([CASE WHEN share < 0.6 THEN 'share: range' END, CASE WHEN n <= 3 THEN 'n: positive' END]) AS error FROM cl) WHERE error IS NOT NULL")
def v4_check_clusters(spark, sf_dir):
    c = clusters(spark, sf_dir)
    return validate.check_clusters(c.withColumn("mean", F.col("v")).withColumn("n", F.col("n") - 3), 64)


@query(f"WITH {CLUSTERS}, e AS (SELECT doc, count(*) AS n FROM cl WHERE share < 0.52 GROUP BY doc) SELECT d.doc, 'clusters' AS part, CASE WHEN d.doc = 'd9' THEN 'missing' WHEN e.n > 0 THEN 'errors' ELSE 'ok' END AS status, coalesce(e.n, 0) AS n_errors FROM (SELECT DISTINCT doc FROM cl UNION SELECT 'd9') d LEFT JOIN e ON e.doc = d.doc")
def v5_report(spark, sf_dir):
    c = clusters(spark, sf_dir).withColumn("mean", F.col("v"))
    everyone = c.select("doc").distinct().union(spark.range(1).select(F.lit("d9")))
    return validate.report(everyone, {"clusters": c}, {"clusters": validate.check_clusters(c, 64, 0.52)})
