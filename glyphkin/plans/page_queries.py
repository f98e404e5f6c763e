"""Words, strokes, boxes and characters of pages: queries on the stand-in tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions.stats import otsu_thresholds
from ..functions.text import best_label
from ..operators import clusters as stats, italic, spatial
from ..functions.vectors import argmax, stretched
from .registry import query, table
from .standins import BOXES, CHARS, VALID, WORDS, boxes, chars, words

OTSU = f"""{WORDS}, vs AS (SELECT doc, stroke FROM wd WHERE {VALID}),
    sp AS (SELECT doc, min(stroke) AS lo, (max(stroke) - min(stroke)) / 256 AS wi FROM vs GROUP BY doc),
    hb AS (SELECT vs.doc, least(floor((stroke - lo) / wi)::INTEGER, 255) AS bin, lo, wi, count(*) AS n FROM vs JOIN sp ON sp.doc = vs.doc WHERE wi > 0 GROUP BY ALL),
    hc AS (SELECT doc, bin, lo + (bin + 0.5::DOUBLE) * wi AS ce, n FROM hb),
    cu AS (SELECT doc, bin, ce, sum(n) OVER u AS n1, sum(n * ce) OVER u AS s1, sum(n) OVER t AS nt, sum(n * ce) OVER t AS st FROM hc WINDOW u AS (PARTITION BY doc ORDER BY bin ROWS UNBOUNDED PRECEDING), t AS (PARTITION BY doc)),
    bt AS (SELECT doc, bin, ce, n1::DOUBLE * (nt - n1) * pow(s1 / n1 - (st - s1) / (nt - n1), 2) AS v FROM cu WHERE nt > n1),
    ot AS (SELECT doc, ce AS otsu FROM bt QUALIFY row_number() OVER (PARTITION BY doc ORDER BY round(v, 9) DESC, bin) = 1)"""

THRESHOLDS = f"""{OTSU},
    qu AS (SELECT doc, count(*) AS n_valid_strokes, quantile_cont(stroke, 0.85) AS q85, quantile_cont(stroke, 0.9) AS q90, quantile_cont(stroke, 0.95) AS q95 FROM vs GROUP BY doc HAVING count(*) >= 10),
    th AS (SELECT qu.*, otsu, CASE WHEN otsu >= q85 AND otsu < q95 THEN otsu ELSE q90 END AS threshold FROM qu JOIN ot ON ot.doc = qu.doc)"""

COMPLICATED = f"""{THRESHOLDS},
    cp AS (SELECT wd.*, threshold, NOT coalesce({VALID}, false) OR (stroke >= threshold AND regexp_matches(lower(text), '[zyf]')) AS complicated FROM wd JOIN th ON th.doc = wd.doc)"""

NEIGHBOURS = """nb AS (SELECT a.doc, a.page, a.word_idx, b.word_idx AS other_idx, least(abs(a.r - b.l), abs(a.l - b.r))::DOUBLE AS gap
    FROM {t} a JOIN {t} b ON a.doc = b.doc AND a.page = b.page AND a.word_idx <> b.word_idx
    WHERE {asked} pow((a.l + a.r) / 2 - (b.l + b.r) / 2, 2) + pow((a.t + a.b) / 2 - (b.t + b.b) / 2, 2) <= 40000 AND abs((a.t + a.b) / 2 - (b.t + b.b) / 2) < 0.5 * (a.b - a.t) AND least(abs(a.r - b.l), abs(a.l - b.r)) < 10),
    n2 AS (SELECT *, row_number() OVER (PARTITION BY doc, page, word_idx ORDER BY gap, other_idx)::INTEGER AS rank FROM nb QUALIFY rank <= 2)"""

EFFECTIVE = f"""{COMPLICATED}, {NEIGHBOURS.format(t='cp', asked='a.complicated AND')},
    le AS (SELECT n2.doc, n2.page, n2.word_idx, max(cp.stroke) AS lent FROM n2 JOIN cp ON cp.doc = n2.doc AND cp.page = n2.page AND cp.word_idx = n2.other_idx WHERE NOT cp.complicated GROUP BY ALL),
    ef AS (SELECT cp.doc, cp.page, cp.word_idx, cp.stroke, threshold, complicated, coalesce(lent, cp.stroke) AS effective FROM cp LEFT JOIN le ON le.doc = cp.doc AND le.page = cp.page AND le.word_idx = cp.word_idx),
    iw AS (SELECT *, coalesce(NOT isnan(effective) AND effective >= threshold, false) AS is_italic FROM ef)"""


def _effective(spark, sf_dir):
    w = words(spark, sf_dir)
    return italic.effective_strokes(w, italic.thresholds(w))


def _letters(spark, sf_dir):
    """Three characters a word, one of them of a word that does not exist."""
    w = words(spark, sf_dir).select("doc", "page", "word_idx")
    return w.select("doc", "page", F.explode(F.array("word_idx", "word_idx", -F.col("word_idx") - 1)).alias("word_idx"))


@query(f"WITH {WORDS} SELECT doc, word_idx, stroke FROM wd WHERE {VALID}")
def f2_measured_strokes(spark, sf_dir):
    return words(spark, sf_dir).filter(italic.measured(F.col("stroke"))).select("doc", "word_idx", "stroke")


@query(f"WITH {WORDS} SELECT doc, count(*) AS n FROM wd WHERE {VALID} GROUP BY doc HAVING count(*) >= 10")
def f3_enough_strokes(spark, sf_dir):
    return italic.thresholds(words(spark, sf_dir)).select("doc", F.col("n_valid_strokes").alias("n"))


@query(f"WITH {THRESHOLDS} SELECT doc, round(q85, 6) AS q85, round(q90, 6) AS q90, round(q95, 6) AS q95 FROM th")
def a7_stroke_quantiles(spark, sf_dir):
    return italic.thresholds(words(spark, sf_dir)).select("doc", *(F.round(c, 6).alias(c) for c in ("q85", "q90", "q95")))


@query(f"WITH {THRESHOLDS} SELECT doc, n_valid_strokes, round(otsu, 6) AS otsu, round(threshold, 6) AS threshold FROM th")
def a8_thresholds(spark, sf_dir):
    return italic.thresholds(words(spark, sf_dir)).select("doc", "n_valid_strokes", F.round("otsu", 6).alias("otsu"), F.round("threshold", 6).alias("threshold"))


@query(f"WITH {OTSU} SELECT doc, round(otsu, 6) AS otsu FROM ot")
def a8_otsu(spark, sf_dir):
    good = words(spark, sf_dir).filter(italic.measured(F.col("stroke")))
    return otsu_thresholds(good, "doc", "stroke").select("doc", F.round("otsu", 6).alias("otsu"))


@query(f"WITH {COMPLICATED} SELECT doc, page, word_idx, complicated FROM cp")
def f4_complicated_words(spark, sf_dir):
    w = words(spark, sf_dir)
    rows = w.join(italic.thresholds(w).select("doc", "threshold"), "doc")
    return rows.select("doc", "page", "word_idx", italic.complicated(F.col("stroke"), F.col("text"), F.col("threshold")).alias("complicated"))


@query(f"WITH {WORDS}, {NEIGHBOURS.format(t='wd', asked='')} SELECT doc, page, word_idx, other_idx, gap, rank FROM n2")
def j3_side_neighbours(spark, sf_dir):
    return italic.side_neighbours(words(spark, sf_dir))


@query(f"WITH {WORDS}, {NEIGHBOURS.format(t='wd', asked='')} SELECT doc, page, word_idx, count(*) AS n FROM n2 GROUP BY ALL")
def w2_nearest_two(spark, sf_dir):
    return italic.side_neighbours(words(spark, sf_dir)).groupBy("doc", "page", "word_idx").agg(F.count("*").alias("n"))


@query(f"WITH {EFFECTIVE} SELECT doc, page, word_idx, complicated, effective FROM ef WHERE effective IS NOT NULL AND NOT isnan(effective)")
def j4_effective_strokes(spark, sf_dir):
    e = _effective(spark, sf_dir)
    return e.filter("effective IS NOT NULL AND NOT isnan(effective)").select("doc", "page", "word_idx", "complicated", "effective")


@query(f"WITH {EFFECTIVE}, lt AS (SELECT doc, page, unnest([word_idx, word_idx, -word_idx - 1]) AS word_idx FROM wd) SELECT lt.doc, lt.page, lt.word_idx, coalesce(is_italic, false) AS is_italic FROM lt LEFT JOIN iw ON iw.doc = lt.doc AND iw.page = lt.page AND iw.word_idx = lt.word_idx")
def j11_italic_characters(spark, sf_dir):
    flags = italic.italic_words(_effective(spark, sf_dir))
    return italic.italic_chars(_letters(spark, sf_dir), flags).select("doc", "page", "word_idx", "is_italic")


@query(f"WITH {EFFECTIVE}, lt AS (SELECT doc, page, unnest([word_idx, word_idx, -word_idx - 1]) AS word_idx FROM wd) SELECT lt.doc, lt.page, count(*) AS n_chars, count(*) FILTER (is_italic) AS n_italic FROM lt LEFT JOIN iw ON iw.doc = lt.doc AND iw.page = lt.page AND iw.word_idx = lt.word_idx GROUP BY ALL")
def se1_page_counts(spark, sf_dir):
    flags = italic.italic_words(_effective(spark, sf_dir))
    return italic.page_counts(italic.italic_chars(_letters(spark, sf_dir), flags))


@query(f"WITH {BOXES} SELECT k, j, list_min([polygon[2], polygon[4], polygon[6], polygon[8]]) AS t, list_max([polygon[2], polygon[4], polygon[6], polygon[8]]) AS b, list_min([polygon[1], polygon[3], polygon[5], polygon[7]]) AS l, list_max([polygon[1], polygon[3], polygon[5], polygon[7]]) AS r FROM bx")
def p1_polygon_boxes(spark, sf_dir):
    return boxes(spark, sf_dir).select("k", "j", g.polygon_box(F.col("polygon")).alias("x")).select("k", "j", "x.*")


@query(f"WITH {BOXES}, e AS (SELECT k, j, unnest(range(4)) AS i, polygon FROM bx) SELECT k, j, i::INTEGER AS i, polygon[2 * i + 1] AS x, polygon[2 * i + 2] AS y FROM e")
def p24_polygon_points(spark, sf_dir):
    rows = boxes(spark, sf_dir).select("k", "j", F.posexplode(g.polygon_points(F.col("polygon"))).alias("i", "p"))
    return rows.select("k", "j", "i", "p.x", "p.y")


@query(f"WITH {BOXES}, c AS (SELECT k, j, l AS x1, t AS y1, l + w AS x2, t + h AS y2, score * 6 AS a, l + w / 2 AS cx, t + h / 2 AS cy FROM bx) SELECT k, j, round(cx + (x1 - cx) * cos(a) - (y1 - cy) * sin(a), 6) AS ax, round(cy + (x1 - cx) * sin(a) + (y1 - cy) * cos(a), 6) AS ay, round(cx + (x2 - cx) * cos(a) - (y2 - cy) * sin(a), 6) AS bx, round(cy + (x2 - cx) * sin(a) + (y2 - cy) * cos(a), 6) AS by_ FROM c")
def p4_rotated_boxes(spark, sf_dir):
    c = boxes(spark, sf_dir).selectExpr("k", "j", "l AS x1", "t AS y1", "l + w AS x2", "t + h AS y2", "score * 6 AS a", "l + w / 2 AS cx", "t + h / 2 AS cy")
    p = g.rotated_corners(*(F.col(x) for x in ("x1", "y1", "x2", "y2", "a", "cx", "cy")))
    return c.select("k", "j", p.alias("p")).select("k", "j", *(F.round(F.get("p", F.lit(i)), 6).alias(n) for i, n in ((0, "ax"), (1, "ay"), (4, "bx"), (5, "by_"))))


@query(f"WITH {BOXES}, c AS (SELECT k, j, 4 * 0.5::DOUBLE * (l / 8 - w / 16) AS x1, 4 * 0.5::DOUBLE * (t / 8 - h / 16) AS y1, 4 * 0.5::DOUBLE * (l / 8 + w / 8) AS x2, 4 * 0.5::DOUBLE * (t / 8 + h / 8) AS y2 FROM bx) SELECT k, j, greatest(0, least(799, round_even(x1, 0))) AS x1, greatest(0, least(999, round_even(y1, 0))) AS y1, greatest(0, least(799, round_even(x2, 0))) AS x2, greatest(0, least(999, round_even(y2, 0))) AS y2 FROM c")
def p5_cell_boxes(spark, sf_dir):
    """Grid cells at an eighth of the page's coordinates to boxes on a page of 800 by 1000."""
    c = boxes(spark, sf_dir).selectExpr("k", "j", "l / 8 AS x", "t / 8 AS y", "h / 16 AS dt", "h / 8 AS db", "w / 16 AS dl", "w / 8 AS dr")
    box = g.cell_box(*(F.col(n) for n in ("x", "y", "dt", "db", "dl", "dr")), F.lit(0.5), F.lit(0.5), 4.0)
    flat = g.rounded_into(F.array(box["x1"], box["y1"], box["x2"], box["y2"]), F.lit(800), F.lit(1000))
    return c.select("k", "j", flat.alias("p")).select("k", "j", *(F.get("p", F.lit(i)).alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))))


@query("SELECT l_orderkey AS k, l_linenumber AS j, CASE WHEN l_linenumber <= 1 THEN -360::DOUBLE ELSE round(degrees(0.5::DOUBLE * atan2(2 * (l_discount - 0.05::DOUBLE), l_tax - l_quantity / 500)) + l_tax, 6) END AS angle FROM lineitem")
def p6_stroke_angles(spark, sf_dir):
    c = table(spark, sf_dir, "lineitem")
    angle = g.stroke_angle(F.col("l_tax"), F.col("l_discount") - 0.05, F.col("l_quantity") / 500, F.col("l_tax"), F.col("l_linenumber"))
    return c.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("j"), F.round(angle, 6).alias("angle"))


CROP = f"""{BOXES}, pd AS (SELECT *, greatest(1, h // 5) AS pad FROM bx),
    cw AS (SELECT k, j, l, t, w, h, greatest(0, least(t - pad, t - 2, t + 1))::INTEGER AS ct, least(2500, greatest(t + h + pad, t + h - 1, t + h + 6))::INTEGER AS cb, greatest(0, least(l - pad, l - 9, l + w - 9))::INTEGER AS cl, least(1900, greatest(l + w + pad, l + 3, l + w + 2))::INTEGER AS cr FROM pd)"""


def _crops(spark, sf_dir):
    """Two characters a word: one that sticks out on the upper left, one on the lower right."""
    box = lambda t, b, l, r: f"named_struct('t', {t}, 'b', {b}, 'l', {l}, 'r', {r})"  # noqa: E731, E741
    c = boxes(spark, sf_dir).selectExpr("k", "j", f"{box('t', 't + h', 'l', 'l + w')} AS word", f"array({box('t - 2', 't + h - 1', 'l - 9', 'l + 3')}, {box('t + 1', 't + h + 6', 'l + w - 9', 'l + w + 2')}) AS chars")
    # a generator of one row: its columns are computed once, where a projection or a filter on them would write the
    # crop's expressions out at every use
    c = c.select("k", "j", "chars", F.inline(F.array(g.crop_window(F.col("word"), F.col("chars"), F.lit(2500), F.lit(1900)))))
    return c.select("k", "j", "chars", F.struct("t", "b", "l", "r").alias("crop"))


@query(f"WITH {CROP} SELECT k, j, ct AS t, cb AS b, cl AS l, cr AS r FROM cw")
def p7_crop_windows(spark, sf_dir):
    return _crops(spark, sf_dir).select("k", "j", "crop.*")


@query(f"WITH {CROP}, lo AS (SELECT k, j, least(cb - ct - 1, greatest(0, t - 2 - ct)) AS t, least(cb - ct, greatest(1, t + h - 1 - ct)) AS b, least(cr - cl - 1, greatest(0, l - 9 - cl)) AS l, least(cr - cl, greatest(1, l + 3 - cl)) AS r FROM cw) SELECT * FROM lo WHERE b > t AND r > l")
def p8_boxes_in_crops(spark, sf_dir):
    c = _crops(spark, sf_dir).withColumn("x", g.box_in_crop(F.get("chars", F.lit(0)), F.col("crop")))
    return c.filter("x IS NOT NULL").select("k", "j", "x.*")


@query(f"WITH {CHARS} SELECT k, j, doc, cluster, round((l - list_min(v)) / (list_max(v) - list_min(v) + 1e-8), 6) AS first FROM (SELECT *, img[1] AS l, list_filter(img, lambda x: NOT isnan(x)) AS v FROM ch)")
def p9_stretched(spark, sf_dir):
    """Pixels scaled to the range of their image."""
    out = stretched(F.col("img"))
    return chars(spark, sf_dir).select("k", "j", "doc", "cluster", F.round(F.get(out, F.lit(0)), 6).alias("first"))


@query(f"WITH {CHARS} SELECT k, j, doc, cluster FROM ch WHERE k % 101 <> 0")
def f5_images_without_nan(spark, sf_dir):
    return chars(spark, sf_dir).filter(~F.exists("img", lambda x: F.isnan(x))).select("k", "j", "doc", "cluster")


@query(f"WITH {CHARS} SELECT k, j, doc, cluster FROM ch WHERE k % 101 <> 0 AND list_stddev_pop(img) > 0.01 AND len(list_filter(img, lambda x: x < 0.05)) / 5 < 0.7")
def f6_informative_images(spark, sf_dir):
    return chars(spark, sf_dir).filter(stats.informative(F.col("img"), most_background=0.7)).select("k", "j", "doc", "cluster")


MAJORITY = f"""{CHARS}, lc AS (SELECT doc, cluster, label, count(*) AS c FROM ch GROUP BY ALL),
    mj AS (SELECT doc, cluster, min({{'c': -c, 'label': label}}).label AS label, round(max(c) / sum(c)::DOUBLE, 6) AS share, sum(c)::BIGINT AS n FROM lc GROUP BY doc, cluster)"""


@query(f"WITH {MAJORITY} SELECT * FROM mj")
def a1_majority_labels(spark, sf_dir):
    return stats.majority_labels(chars(spark, sf_dir)).withColumn("share", F.round("share", 6))


@query(f"WITH {MAJORITY} SELECT * FROM mj WHERE share >= 0.4 AND label NOT IN ('.', ',', ';', ':')")
def f7_usable_clusters(spark, sf_dir):
    found = stats.majority_labels(chars(spark, sf_dir)).withColumn("share", F.round("share", 6))
    return stats.usable(found, 0.4)


@query(f"WITH {CHARS} SELECT doc, cluster, " + ", ".join(f"round(avg(img[{i + 1}]), 6) AS x{i}" for i in range(3)) + " FROM ch GROUP BY ALL")
def a2_mean_images(spark, sf_dir):
    m = stats.mean_images(chars(spark, sf_dir))
    return m.select("doc", "cluster", *(F.round(F.get("mean", F.lit(i)), 6).alias(f"x{i}") for i in range(3)))


@query(f"WITH {CHARS} SELECT doc, cluster, round(avg(is_italic::INTEGER), 6) AS italic FROM ch GROUP BY ALL")
def a3_italic_ratios(spark, sf_dir):
    return stats.italic_ratios(chars(spark, sf_dir)).withColumn("italic", F.round("italic", 6))


@query(f"WITH {MAJORITY} SELECT mj.doc, mj.cluster, label, share, n, round(italic, 6) AS italic FROM mj JOIN (SELECT doc, cluster, avg(is_italic::INTEGER) AS italic FROM ch GROUP BY ALL) i ON i.doc = mj.doc AND i.cluster = mj.cluster WHERE share >= 0.6 AND label NOT IN ('.', ',', ';', ':')")
def k5_cluster_table(spark, sf_dir):
    t = stats.cluster_table(chars(spark, sf_dir))
    return t.select("doc", "cluster", "label", F.round("share", 6).alias("share"), "n", F.round("italic", 6).alias("italic"))


@query(f"WITH {CHARS}, x AS (SELECT k * 10 + j AS idx, CASE WHEN j % 2 = 0 THEN label ELSE '.' END AS label FROM ch) SELECT label, min(idx) AS idx FROM x WHERE idx >= 100 AND regexp_full_match(label, '\\p{{L}}+') GROUP BY label ORDER BY idx, label LIMIT 15")
def f17_diverse_sample(spark, sf_dir):
    c = chars(spark, sf_dir).selectExpr("k * 10 + j AS idx", "CASE WHEN j % 2 = 0 THEN label ELSE '.' END AS label")
    return stats.diverse_sample(c)




@query(f"WITH {BOXES}, wn AS (SELECT page, x, y, ((x * 7 + y * 3) % 90 - 45)::DOUBLE AS angle FROM (SELECT DISTINCT page FROM bx) CROSS JOIN (SELECT unnest([256, 512, 768, 1024, 1280]) AS x) CROSS JOIN (SELECT unnest([256, 512, 768, 1024]) AS y)), "
       "pt AS (SELECT DISTINCT page, k * 10 + j AS word_idx, (l + (l + w)) / 2 AS cx, (t + (t + h)) / 2 AS cy FROM bx), hd AS (SELECT pt.page, word_idx, angle, greatest(1, sqrt(pow(x - cx, 2) + pow(y - cy, 2))) AS d FROM pt JOIN wn ON wn.page = pt.page AND cx >= x - 256 AND cx < x + 256 AND cy >= y - 256 AND cy < y + 256), "
       "ins AS (SELECT page, word_idx, sum(angle / d) / sum(1 / d) AS a FROM hd GROUP BY ALL), nr AS (SELECT pt.page, pt.word_idx, angle AS a FROM pt JOIN wn ON wn.page = pt.page WHERE NOT EXISTS (SELECT 1 FROM ins WHERE ins.page = pt.page AND ins.word_idx = pt.word_idx) QUALIFY row_number() OVER (PARTITION BY pt.page, pt.word_idx ORDER BY round(sqrt(pow(x - cx, 2) + pow(y - cy, 2)), 9), y, x) = 1) "
       "SELECT page, word_idx, round(a, 4) AS page_angle FROM (SELECT * FROM ins UNION ALL SELECT * FROM nr)")  # fmt: skip
def j2_page_angles(spark, sf_dir):
    b = boxes(spark, sf_dir)
    pages = b.select("page").distinct()
    w = pages.withColumn("x", F.explode(F.array(*map(F.lit, (256, 512, 768, 1024, 1280))))).withColumn("y", F.explode(F.array(*map(F.lit, (256, 512, 768, 1024)))))
    w = w.withColumn("angle", ((F.col("x") * 7 + F.col("y") * 3) % 90 - 45).cast("double"))
    points = b.selectExpr("page", "k * 10 + j AS word_idx", "t", "t + h AS b", "l", "l + w AS r").distinct()
    return spatial.page_angles(points, w, ["page"]).withColumn("page_angle", F.round("page_angle", 4))


@query(f"WITH {BOXES}, a AS (SELECT DISTINCT page, k, j, l, t, w, h FROM bx WHERE j % 2 = 0), b AS (SELECT DISTINCT page, k, j, l, t, w, h FROM bx WHERE j % 2 = 1) SELECT a.page, a.k AS ak, a.j AS aj, b.k AS bk, b.j AS bj FROM a JOIN b ON a.page = b.page AND a.l <= b.l + b.w AND a.l + a.w >= b.l AND a.t <= b.t + b.h AND a.t + a.h >= b.t")
def j1_touching_boxes(spark, sf_dir):
    """The prefilter of the overlap join: axis-aligned boxes with a point in common."""
    d = boxes(spark, sf_dir).selectExpr("page", "k", "j", "named_struct('t', t, 'b', t + h, 'l', l, 'r', l + w) AS box").distinct()
    a, b = d.filter("j % 2 = 0").selectExpr("page", "k AS ak", "j AS aj", "box AS a_box"), d.filter("j % 2 = 1").selectExpr("page", "k AS bk", "j AS bj", "box AS b_box")
    return spatial.touching(a, b, ["page"]).select("page", "ak", "aj", "bk", "bj")


@query()
def j1_chars_to_words(spark, sf_dir):
    """Boxes of odd lines into those of even lines by largest polygon overlap; tested against brute force."""
    d = boxes(spark, sf_dir).selectExpr("page", "k * 10 + j AS idx", "j", "polygon").distinct()
    return spatial.chars_to_words(d.filter("j % 2 = 1").withColumnRenamed("idx", "char_idx"), d.filter("j % 2 = 0").withColumnRenamed("idx", "word_idx"), ["page"])


@query(f"WITH {BOXES}, m AS (SELECT page, j, " + ", ".join(f"sum(polygon[{i + 1}] * (score + 1)) / sum(score + 1) AS c{i}" for i in (0, 1)) + ", max(score + 1) AS score FROM bx GROUP BY ALL) SELECT page, j, round(c0, 4) AS c0, round(c1, 4) AS c1, score FROM m")
def a11_merged_boxes(spark, sf_dir):
    b = boxes(spark, sf_dir).withColumn("score", F.col("score") + 1)
    m = spatial.merged_boxes(b, ["page", "j"])
    return m.select("page", "j", F.round(F.get("polygon", F.lit(0)), 4).alias("c0"), F.round(F.get("polygon", F.lit(1)), 4).alias("c1"), "score")


@query(f"WITH {BOXES}, wc AS (SELECT DISTINCT page, l // 16 AS x, t // 16 AS y FROM bx WHERE j % 2 = 0 AND score > 0.05), cc AS (SELECT DISTINCT page, k, j, l // 16 AS x, t // 16 AS y FROM bx WHERE tax > 0.025) SELECT page, k, j, x, y FROM cc SEMI JOIN wc USING (page, x, y)")
def f1_cells_kept(spark, sf_dir):
    b = boxes(spark, sf_dir).selectExpr("page", "k", "j", "l div 16 AS x", "t div 16 AS y", "score", "tax")
    w = b.filter("j % 2 = 0").select("page", "x", "y", "score")
    c = b.select("page", "k", "j", "x", "y", F.col("tax").alias("score")).distinct()
    return spatial.cells_kept(w, c, ["page"], 0.05, 0.025).select("page", "k", "j", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y")).distinct()


@query(f"WITH {CHARS} SELECT k, string_agg(label, '' ORDER BY cx, label, score) AS text, round(avg(score), 6) AS score FROM (SELECT k, label, img[1] AS score, (j * 37) % 7 AS cx FROM ch) GROUP BY k")
def p3_decoded_words(spark, sf_dir):
    c = chars(spark, sf_dir).selectExpr("k", "label", "img[0] AS score", "(j * 37) % 7 AS cx")
    return spatial.decode_words(c, ["k"]).withColumn("score", F.round("score", 6))


@query(f"WITH {CHARS} SELECT k, list(j ORDER BY (j * 37) % 7, j) AS js FROM ch GROUP BY k")
def w7_left_to_right(spark, sf_dir):
    c = chars(spark, sf_dir).selectExpr("k", "struct((j * 37) % 7 AS cx, j) AS x")
    return c.groupBy("k").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["j"]).alias("js"))


@query("SELECT l_orderkey AS k, l_linenumber AS j, CASE WHEN d >= greatest(n, t) THEN 'd' WHEN n >= t THEN 'n' ELSE 't' END AS label FROM (SELECT *, l_tax * 100 AS t, l_discount * 60 AS d, l_linenumber::DOUBLE AS n FROM lineitem)")
def p2_best_labels(spark, sf_dir):
    """The label of the largest of three scores; ties in alphabetical order."""
    c = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS k", "l_linenumber AS j", "map('t', l_tax * 100, 'd', l_discount * 60, 'n', CAST(l_linenumber AS double)) AS m")
    return c.select("k", "j", best_label(F.col("m")).alias("label"))


@query("SELECT vec_id, (list_position(embedding, list_max(embedding)) - 1)::INTEGER AS i FROM embeddings")
def p2_argmax(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", argmax(F.col("embedding")).alias("i"))


@query(f"WITH {WORDS}, m AS (SELECT doc, page, max(word_idx) + 1 AS n FROM wd GROUP BY ALL) SELECT doc, page, coalesce(sum(n) OVER (PARTITION BY doc ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS \"offset\" FROM m")
def p22_global_word_index(spark, sf_dir):
    return spatial.global_word_index(words(spark, sf_dir))
