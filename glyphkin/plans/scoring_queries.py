"""Distances, a-contrario scores, representatives: queries on the stand-in clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..config import Alphas
from ..functions.stats import alpha_table, alpha_values, binomial_tail
from ..functions.text import normal_remark
from ..functions.vectors import correlation_distance, euclidean_distance
from ..operators import clusters as stats, distances as dist, scoring
from ..operators.documents import ordered_documents, reordered
from ..operators.matching import common_documents
from ..operators.ordering import hierarchical_order
from .registry import query, table
from .standins import CLUSTERS, COVERED, DIGITS, DISTANCES, DOCS, SELECTED, clusters

#: With few stand-in documents an epsilon under which some pairs fire.
EPSILON = 1.0
TESTS = DOCS * (DOCS - 1) // 2
LEVELS = alpha_values()


def _distances(spark, sf_dir) -> DataFrame:
    return dist.compute_distances(clusters(spark, sf_dir), digits=DIGITS)


def _documents(spark, sf_dir) -> DataFrame:
    return clusters(spark, sf_dir).select("doc").distinct()


QUANTILES = f"""{DISTANCES},
    qs AS (SELECT style, letter, unnest(range({len(LEVELS)}))::INTEGER AS a, unnest({LEVELS}::DOUBLE[]) AS alpha, round(unnest(quantile_cont(dist, {LEVELS})), 9) AS q FROM ds GROUP BY style, letter)"""

COUNTS = f"""{QUANTILES},
    ct AS (SELECT ds.style, doc_a, doc_b, a, alpha, count(*)::INTEGER AS n, (count(*) FILTER (dist < q))::INTEGER AS k FROM ds JOIN qs ON ds.style = qs.style AND ds.letter = qs.letter GROUP BY ALL)"""

TAIL = """CASE WHEN {k} <= 0 THEN 1::DOUBLE WHEN {k} > {n} THEN 0::DOUBLE ELSE list_sum(list_transform(range(({k})::BIGINT, ({n} + 1)::BIGINT),
    lambda i: exp(lgamma({n} + 1) - lgamma(i + 1) - lgamma({n} - i + 1) + i * ln(alpha) + ({n} - i) * ln(1 - alpha)))) END"""

SCORES = f"""{COUNTS},
    ex AS (SELECT *, unnest(range((n + 1)::BIGINT)) AS n1 FROM ct),
    tl AS (SELECT style, doc_a, doc_b, n, a, n1, {TAIL.format(k='(k - n1)', n='(n - n1)')} AS p FROM ex),
    pm AS (SELECT style, doc_a, doc_b, n, n1, min(p) AS p FROM tl GROUP BY ALL),
    sc AS (SELECT style, doc_a, doc_b, n, min(n1)::INTEGER AS n1hat FROM pm WHERE p >= {EPSILON} / {TESTS} GROUP BY ALL),
    wt AS (SELECT *, CASE WHEN n1hat > 0 THEN n1hat / n::DOUBLE ELSE 0 END AS weight FROM sc)"""


def _counts(spark, sf_dir):
    ds = _distances(spark, sf_dir)
    return scoring.letters_below(ds, scoring.quantiles(ds, digits=9))


def _scores(spark, sf_dir):
    return scoring.weighted(scoring.scores(_counts(spark, sf_dir), TESTS, EPSILON))


def _styles(spark, sf_dir):
    """The documents each style is available for: those with a cluster of the style."""
    return dist.select_clusters(clusters(spark, sf_dir)).select("style", "doc").distinct()


def _combined(spark, sf_dir, metric="average"):
    return scoring.combined(_scores(spark, sf_dir), _styles(spark, sf_dir), metric)


PAIRS = f"""{SCORES},
    ok AS (SELECT doc FROM sel GROUP BY doc HAVING count(DISTINCT style) = (SELECT count(DISTINCT style) FROM sel)),
    hv AS (SELECT max((style = 'roman')::INTEGER) AS r, max((style = 'italic')::INTEGER) AS i FROM sel),
    w2 AS (SELECT doc_a, doc_b, max(weight) FILTER (style = 'roman') AS r, max(weight) FILTER (style = 'italic') AS i FROM wt GROUP BY ALL),
    pp AS (SELECT a.doc AS doc_a, b.doc AS doc_b, CASE WHEN hv.r = 1 THEN coalesce(w2.r, 0) END AS r, CASE WHEN hv.i = 1 THEN coalesce(w2.i, 0) END AS i
           FROM w2 JOIN ok a ON w2.doc_a = a.doc JOIN ok b ON w2.doc_b = b.doc CROSS JOIN hv),
    cb AS (SELECT doc_a, doc_b, r, i, coalesce((r + i) / 2, r, i) AS weight, coalesce(r, 0) + coalesce(i, 0) AS total FROM pp)"""


@query(f"WITH {SCORES} SELECT style, doc_a, doc_b, n, n1hat, round(weight, 6) AS weight FROM wt")
def x4_acontrario(spark, sf_dir):
    """Flagship: clusters to scores, every step of the analysis."""
    return _scores(spark, sf_dir).select("style", "doc_a", "doc_b", "n", "n1hat", F.round("weight", 6).alias("weight"))


@query(f"WITH {DISTANCES} SELECT style, letter, doc_a, doc_b, dist FROM ds")
def x2_document_distances(spark, sf_dir):
    return _distances(spark, sf_dir).select("style", "letter", "doc_a", "doc_b", "dist")


@query(f"WITH {DISTANCES}, m AS (SELECT style, letter, doc_a, doc_b, min((d, ca, cb)) AS x FROM pr GROUP BY ALL) SELECT style, letter, doc_a, doc_b, x[1] AS dist, x[2] AS ca, x[3] AS cb FROM m".replace("min((d, ca, cb)) AS x", "min({'d': d, 'ca': ca, 'cb': cb}) AS x").replace("x[1]", "x.d").replace("x[2]", "x.ca").replace("x[3]", "x.cb"))
def a4_least_pairs(spark, sf_dir):
    """The pair of clusters that is closest, for each letter and pair of documents."""
    chosen = dist.select_clusters(clusters(spark, sf_dir))
    letters = dist.covered_letters(chosen, _documents(spark, sf_dir))
    return dist.document_distances(dist.cluster_pairs(chosen.join(letters, ["style", "letter"], "left_semi")), DIGITS)


@query(f"WITH {CLUSTERS} SELECT cluster_id, CASE WHEN italic <= 0.1 THEN 'roman' WHEN italic >= 0.4 THEN 'italic' ELSE 'neither' END AS style FROM cl")
def f8_style(spark, sf_dir):
    return clusters(spark, sf_dir).select("cluster_id", F.coalesce(dist.style_of(F.col("italic")), F.lit("neither")).alias("style"))


@query(f"WITH {CLUSTERS} SELECT cluster_id, letter, share FROM cl WHERE share >= 0.6 AND letter NOT IN (',', '.', ';', ':')")
def f9_confident(spark, sf_dir):
    return dist.confident(clusters(spark, sf_dir)).select("cluster_id", "letter", "share")


@query(f"WITH {SELECTED} SELECT style, doc, letter, cluster_id, n FROM sel")
def w1_top_clusters(spark, sf_dir):
    return dist.select_clusters(clusters(spark, sf_dir)).select("style", "doc", "letter", "cluster_id", "n")


@query(f"WITH {COVERED} SELECT style, letter, n_docs FROM cov")
def f10_covered_letters(spark, sf_dir):
    return dist.covered_letters(dist.select_clusters(clusters(spark, sf_dir)), _documents(spark, sf_dir))


@query(f"WITH {SELECTED}, t AS (SELECT count(DISTINCT doc) AS total FROM cl) SELECT style, letter, count(DISTINCT doc) AS n_docs, ceil(any_value(total) * 0.33)::BIGINT AS needed, count(DISTINCT doc) >= any_value(total) * 0.33 AS kept FROM sel CROSS JOIN t GROUP BY style, letter")
def a19_coverage_report(spark, sf_dir):
    return dist.coverage_report(dist.select_clusters(clusters(spark, sf_dir)), _documents(spark, sf_dir))


@query(f"WITH {SELECTED} SELECT a.style, a.letter, a.doc AS doc_a, b.doc AS doc_b, a.cluster_id AS ca, b.cluster_id AS cb, round(1 - list_cosine_similarity(a.v, b.v), 6) AS d FROM sel a JOIN sel b ON a.style = b.style AND a.letter = b.letter AND a.doc < b.doc")
def j9_cluster_pairs(spark, sf_dir):
    pairs = dist.cluster_pairs(dist.select_clusters(clusters(spark, sf_dir)))
    return pairs.withColumn("d", F.round("d", 6))


@query(f"WITH {SELECTED} SELECT a.cluster_id AS ca, b.cluster_id AS cb, round(list_distance(a.v, b.v), 6) AS euclidean, round(1 - list_cosine_similarity(list_transform(a.v, lambda x: x - list_avg(a.v)), list_transform(b.v, lambda x: x - list_avg(b.v))), 6) AS correlation FROM sel a JOIN sel b ON a.style = b.style AND a.letter = b.letter AND a.doc < b.doc")
def x1_metrics(spark, sf_dir):
    """The other two metrics of the pairwise distance."""
    slim = dist.select_clusters(clusters(spark, sf_dir)).select("style", "letter", "doc", "cluster_id", "v")
    a, b = slim.alias("a"), slim.alias("b")
    pairs = a.join(b, (F.col("a.style") == F.col("b.style")) & (F.col("a.letter") == F.col("b.letter")) & (F.col("a.doc") < F.col("b.doc")))
    x, y = F.col("a.v"), F.col("b.v")
    return pairs.select(F.col("a.cluster_id").alias("ca"), F.col("b.cluster_id").alias("cb"), F.round(euclidean_distance(x, y), 6).alias("euclidean"), F.round(correlation_distance(x, y), 6).alias("correlation"))


@query(f"WITH {DISTANCES} SELECT DISTINCT style, letter FROM ds")
def f11_letters_with_distances(spark, sf_dir):
    return _distances(spark, sf_dir).select("style", "letter").distinct()


@query(f"WITH {DISTANCES}, both_ AS (SELECT style, letter, doc_a, doc_b, dist FROM ds UNION ALL SELECT style, letter, doc_b, doc_a, dist FROM ds) SELECT * FROM both_ UNION ALL SELECT DISTINCT style, letter, doc_a, doc_a AS doc_b, 0::DOUBLE AS dist FROM both_")
def s20_with_diagonal(spark, sf_dir):
    return dist.with_diagonal(_distances(spark, sf_dir))


@query(f"WITH {DISTANCES}, tp AS (SELECT style, letter, 2 * max(dist) AS ab FROM ds GROUP BY ALL), su AS (SELECT style, sum(ab) AS ab, count(*) AS l FROM tp GROUP BY style), gn AS (SELECT ds.style, doc_a, doc_b, sum(dist - ab) AS g FROM ds JOIN tp ON ds.style = tp.style AND ds.letter = tp.letter GROUP BY ALL) SELECT su.style, doc_a, doc_b, round((ab + g) / l, 4) AS mean FROM gn JOIN su ON gn.style = su.style")
def a17_mean_distances(spark, sf_dir):
    out = dist.mean_distances(_distances(spark, sf_dir))
    return out.withColumn("mean", F.round("mean", 4))


@query(f"SELECT (row_number() OVER (ORDER BY alpha) - 1)::INTEGER AS a, alpha FROM (SELECT unnest([0.1::DOUBLE, 0.15::DOUBLE]) AS base) CROSS JOIN (SELECT unnest(range(-5, 4)) AS e) CROSS JOIN LATERAL (SELECT base * pow(2::DOUBLE, e) AS alpha) WHERE alpha > 0 AND alpha < 1")
def p19_alpha_grid(spark, sf_dir):
    return alpha_table(spark, Alphas())


@query(f"WITH {QUANTILES} SELECT style, letter, a, q FROM qs")
def a5_quantiles(spark, sf_dir):
    return scoring.quantiles(_distances(spark, sf_dir), digits=9).select("style", "letter", "a", "q")


@query(f"WITH {COUNTS} SELECT style, doc_a, doc_b, a, n, k FROM ct")
def a6_letters_below(spark, sf_dir):
    return _counts(spark, sf_dir).select("style", "doc_a", "doc_b", "a", "n", "k")


@query("WITH g AS (SELECT n_nationkey + 1 AS n, k, alpha FROM nation CROSS JOIN (SELECT unnest(range(-1, 28)) AS k) CROSS JOIN (SELECT unnest([0.003125::DOUBLE, 0.1::DOUBLE, 0.8::DOUBLE]) AS alpha)) " f"SELECT n::BIGINT AS n, k::BIGINT AS k, alpha, round({TAIL.format(k='k', n='n')}, 9) AS p FROM g")
def x3_binomial_tail(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 1).cast("long").alias("n"))
    rows = n.withColumn("k", F.explode(F.sequence(F.lit(-1).cast("long"), F.lit(27).cast("long")))).withColumn("alpha", F.explode(F.array(*map(F.lit, (0.003125, 0.1, 0.8)))))
    return rows.withColumn("p", F.round(binomial_tail(F.col("k"), F.col("n"), F.col("alpha")), 9))


@query("WITH g AS (SELECT 400 + 40 * n_nationkey AS n, k, alpha FROM nation CROSS JOIN (SELECT unnest([1, 5, 60, 300, 500, 900, 1400]) AS k) CROSS JOIN (SELECT unnest([0.003125::DOUBLE, 0.1::DOUBLE, 0.5::DOUBLE, 0.8::DOUBLE]) AS alpha)) " f"SELECT n::BIGINT AS n, k::BIGINT AS k, alpha, round({TAIL.format(k='k', n='n')}, 7) AS p FROM g")
def x3_binomial_tail_many(spark, sf_dir):
    """The same for many trials: 400 to 1360."""
    n = table(spark, sf_dir, "nation").select((400 + 40 * F.col("n_nationkey")).cast("long").alias("n"))
    rows = n.withColumn("k", F.explode(F.array(*(F.lit(k).cast("long") for k in (1, 5, 60, 300, 500, 900, 1400))))).withColumn("alpha", F.explode(F.array(*map(F.lit, (0.003125, 0.1, 0.5, 0.8)))))
    return rows.withColumn("p", F.round(binomial_tail(F.col("k"), F.col("n"), F.col("alpha")), 7))


@query(f"WITH {COUNTS}, ex AS (SELECT *, unnest(range((n + 1)::BIGINT)) AS n1 FROM ct), tl AS (SELECT style, doc_a, doc_b, n, a, n1, round({TAIL.format(k='(k - n1)', n='(n - n1)')}, 9) AS p FROM ex) SELECT style, doc_a, doc_b, n, n1::INTEGER AS n1, min(p) AS p FROM tl GROUP BY ALL")
def w4_least_tail(spark, sf_dir):
    return scoring.tails(_counts(spark, sf_dir)).select("style", "doc_a", "doc_b", "n", F.col("n1").cast("int").alias("n1"), F.round("p", 9).alias("p"))


@query(f"WITH {SCORES} SELECT style, doc_a, doc_b, n1hat FROM sc")
def w3_first_n1(spark, sf_dir):
    return _scores(spark, sf_dir).select("style", "doc_a", "doc_b", "n1hat")


@query(f"WITH {SCORES}, ba AS (SELECT tl.style, tl.doc_a, tl.doc_b, min({{'p': round(p, 12), 'a': a}}).a AS a FROM tl JOIN sc ON tl.style = sc.style AND tl.doc_a = sc.doc_a AND tl.doc_b = sc.doc_b AND tl.n1 = sc.n1hat GROUP BY ALL) SELECT ba.style, ba.doc_a, ba.doc_b, list_sort(coalesce(list(DISTINCT ds.letter) FILTER (dist < q), [])) AS letters FROM ba JOIN ds ON ds.style = ba.style AND ds.doc_a = ba.doc_a AND ds.doc_b = ba.doc_b JOIN qs ON qs.style = ba.style AND qs.letter = ds.letter AND qs.a = ba.a GROUP BY ALL")
def x5_candidates(spark, sf_dir):
    ds = _distances(spark, sf_dir)
    levels = scoring.quantiles(ds, digits=9)
    counts = scoring.letters_below(ds, levels)
    best = scoring.scores(counts, TESTS, EPSILON).select("style", "doc_a", "doc_b", "n1hat")
    # the level of least tail at n1hat, on rounded tails so that both engines agree on ties
    full = counts.withColumn("n1", F.explode(F.sequence(F.lit(0), F.col("n")))).withColumn("p", F.round(binomial_tail(F.col("k") - F.col("n1"), F.col("n") - F.col("n1"), F.col("alpha")), 12))
    level = full.join(best, ["style", "doc_a", "doc_b"]).filter("n1 = n1hat").groupBy("style", "doc_a", "doc_b").agg(F.min(F.struct("p", "a")).alias("m")).select("style", "doc_a", "doc_b", "m.a")
    return scoring.candidates(level, ds, levels)


@query(f"WITH {PAIRS} SELECT doc_a, doc_b, round(weight, 6) AS weight, round(least(1, greatest(0, 1 - weight)), 6) AS distance, round(total, 6) AS total FROM cb")
def p18_combined(spark, sf_dir):
    r = lambda c: F.round(c, 6).alias(c)
    return _combined(spark, sf_dir).select("doc_a", "doc_b", r("weight"), r("distance"), r("total"))


@query(f"WITH {PAIRS} SELECT doc_a, doc_b, round(coalesce(i, r), 6) AS weight FROM cb")
def p18_italic_first(spark, sf_dir):
    return _combined(spark, sf_dir, "italic").select("doc_a", "doc_b", F.round("weight", 6).alias("weight"))


@query(f"WITH {PAIRS} SELECT doc_a, doc_b, round(coalesce(r, i), 6) AS weight FROM cb")
def p18_roman_first(spark, sf_dir):
    return _combined(spark, sf_dir, "roman").select("doc_a", "doc_b", F.round("weight", 6).alias("weight"))


@query(f"WITH {SCORES} SELECT style, doc_a, doc_b, round(weight, 6) AS weight FROM wt")
def p17_weight(spark, sf_dir):
    return _scores(spark, sf_dir).select("style", "doc_a", "doc_b", F.round("weight", 6).alias("weight"))


@query(f"WITH {PAIRS} SELECT doc_a, doc_b, round(weight, 6) AS weight, round(weight / max(weight) OVER (), 6) AS alpha FROM cb WHERE weight > 0")
def x23_edges(spark, sf_dir):
    return scoring.edges(_combined(spark, sf_dir)).select("doc_a", "doc_b", F.round("weight", 6).alias("weight"), F.round("alpha", 6).alias("alpha"))


@query(f"WITH {PAIRS}, en AS (SELECT doc_a AS doc FROM cb WHERE total > 0 UNION ALL SELECT doc_b FROM cb WHERE total > 0) SELECT d.doc, count(en.doc) AS partners, count(en.doc) = 0 AS isolated FROM (SELECT DISTINCT doc FROM cl) d LEFT JOIN en ON en.doc = d.doc GROUP BY d.doc")
def f12_isolated(spark, sf_dir):
    return scoring.connected(_combined(spark, sf_dir), _documents(spark, sf_dir))


@query(f"WITH {DISTANCES}, tg AS (SELECT * FROM ds WHERE doc_a < 'd4' AND doc_b < 'd4'), rf AS (SELECT * FROM ds WHERE doc_a >= 'd4' AND letter < 'f'), own AS (SELECT style, letter, unnest(range({len(LEVELS)}))::INTEGER AS a, round(unnest(quantile_cont(dist, {LEVELS})), 9) AS q FROM tg GROUP BY style, letter), ref AS (SELECT style, letter, unnest(range({len(LEVELS)}))::INTEGER AS a, round(unnest(quantile_cont(dist, {LEVELS})), 9) AS q FROM rf GROUP BY style, letter) SELECT own.style, own.letter, own.a, coalesce(ref.q, own.q) AS q, ref.q IS NOT NULL AS from_reference FROM own LEFT JOIN ref ON own.style = ref.style AND own.letter = ref.letter AND own.a = ref.a")
def j8_cross_quantiles(spark, sf_dir):
    """Target corpus: the first four documents; reference: the others, letters a to e."""
    ds = _distances(spark, sf_dir)
    target = ds.filter("doc_a < 'd4' AND doc_b < 'd4'")
    reference = ds.filter("doc_a >= 'd4' AND letter < 'f'")
    return scoring.cross_quantiles(target, reference, digits=9).select("style", "letter", "a", "q", "from_reference")


@query(f"WITH {SELECTED} SELECT DISTINCT doc FROM sel WHERE style = 'roman' INTERSECT SELECT DISTINCT doc FROM sel WHERE style = 'italic'")
def j7_common_documents(spark, sf_dir):
    s = dist.select_clusters(clusters(spark, sf_dir))
    return common_documents(s.filter("style = 'roman'"), s.filter("style = 'italic'"))


@query(f"WITH {SCORES} SELECT style, doc_a, doc_b FROM sc WHERE style = 'roman' UNION ALL SELECT style, doc_a, doc_b FROM sc WHERE style = 'italic'")
def se2_union_of_styles(spark, sf_dir):
    s = _scores(spark, sf_dir).select("style", "doc_a", "doc_b")
    return s.filter("style = 'roman'").unionByName(s.filter("style = 'italic'"))


@query(f"WITH {PAIRS}, od AS (SELECT doc, (row_number() OVER (ORDER BY doc DESC))::INTEGER AS place FROM (SELECT DISTINCT doc FROM cl)) SELECT a.place AS row, b.place AS col, round(weight, 6) AS weight FROM cb JOIN od a ON a.doc = doc_a JOIN od b ON b.doc = doc_b")
def x26_reordered(spark, sf_dir):
    """Pairs at the places of the documents in a given order, here names from last to first."""
    docs = _documents(spark, sf_dir)
    index = docs.select("doc", (-F.substring("doc", 2, 9).cast("int")).alias("index"))
    return reordered(_combined(spark, sf_dir), ordered_documents(docs, index)).select("row", "col", F.round("weight", 6).alias("weight"))


@query()
def w11_hierarchical_order(spark, sf_dir):
    """Documents in the order of their tree; small driver matrix, tested against brute force."""
    return hierarchical_order(_combined(spark, sf_dir), _documents(spark, sf_dir))


REPRESENT = f"""WITH {CLUSTERS}, ca AS (SELECT * FROM cl WHERE italic > 0.5)"""


@query(f"{REPRESENT}, w AS (SELECT a.letter, a.doc, a.cluster_id, round(quantile_cont(round(1 - list_cosine_similarity(a.v, b.v), 6), 0.25), 6) AS worth FROM ca a JOIN ca b ON a.letter = b.letter AND a.doc <> b.doc GROUP BY ALL) SELECT letter, doc, arg_min(cluster_id, (coalesce(worth, 'inf'::DOUBLE), cluster_id)) AS cluster_id FROM (SELECT ca.letter, ca.doc, ca.cluster_id, worth FROM ca LEFT JOIN w ON w.letter = ca.letter AND w.cluster_id = ca.cluster_id) GROUP BY letter, doc".replace("arg_min(cluster_id, (coalesce(worth, 'inf'::DOUBLE), cluster_id))", "min({'w': coalesce(worth, 'inf'::DOUBLE), 'c': cluster_id}).c"))
def x21_representatives(spark, sf_dir):
    return stats.representatives(stats.italic_candidates(clusters(spark, sf_dir)), "median", digits=6)


@query(f"{REPRESENT}, w AS (SELECT a.letter, a.doc, a.cluster_id, count(*) FILTER (a.doc < b.doc) AS won FROM ca a JOIN ca b ON a.letter = b.letter AND a.doc <> b.doc GROUP BY ALL) SELECT ca.letter, ca.doc, min({{'w': -coalesce(won, 0), 'c': ca.cluster_id}}).c AS cluster_id FROM ca LEFT JOIN w ON w.letter = ca.letter AND w.cluster_id = ca.cluster_id GROUP BY ca.letter, ca.doc")
def x20_representatives_by_wins(spark, sf_dir):
    return stats.representatives(stats.italic_candidates(clusters(spark, sf_dir)), "argmin")


@query(f"{REPRESENT} SELECT cluster_id, doc, letter FROM ca WHERE letter IN ('a', 'd', 'e')")
def f15_italic_candidates(spark, sf_dir):
    return stats.italic_candidates(clusters(spark, sf_dir), ["a", "d", "e"]).select("cluster_id", "doc", "letter")


@query(f"{REPRESENT}, p AS (SELECT letter, doc, min({{'n': -n, 'c': cluster_id}}).c AS c FROM ca GROUP BY ALL) SELECT letter, " + ", ".join(f"max(c) FILTER (doc = 'd{i}') AS d{i}" for i in range(DOCS)) + " FROM p GROUP BY letter")
def x22_specimen_grid(spark, sf_dir):
    return stats.specimen_grid(stats.largest_italic(clusters(spark, sf_dir)), [f"d{i}" for i in range(DOCS)])


@query(f"{REPRESENT} SELECT doc, letter, min({{'n': -n, 'c': cluster_id}}).c AS cluster_id FROM ca GROUP BY ALL")
def w6_largest_italic(spark, sf_dir):
    return stats.largest_italic(clusters(spark, sf_dir))


@query(f"WITH {CLUSTERS}, r AS (SELECT doc, n, row_number() OVER w AS rk, sum(n) OVER (PARTITION BY doc ORDER BY n DESC, cluster_id ROWS UNBOUNDED PRECEDING) AS s, sum(n) OVER (PARTITION BY doc) AS al FROM cl WINDOW w AS (PARTITION BY doc ORDER BY n DESC, cluster_id)) SELECT doc, count(*) AS n_clusters, min(rk) FILTER (s >= 0.9::DOUBLE * al)::INTEGER AS for_90, round(sum(n) FILTER (rk <= 10) / max(al)::DOUBLE, 6) AS top_10, round(sum(n) FILTER (rk <= 50) / max(al)::DOUBLE, 6) AS top_50, quantile_cont(n, 0.5)::DOUBLE AS median_size FROM r GROUP BY doc".replace("min(rk) FILTER (s >= 0.9::DOUBLE * al)::INTEGER", "(min(rk) FILTER (s >= 0.9::DOUBLE * al))::INTEGER"))
def a15_coverage(spark, sf_dir):
    out = stats.coverage(clusters(spark, sf_dir))
    return out.withColumn("top_10", F.round("top_10", 6)).withColumn("top_50", F.round("top_50", 6))


@query(f"WITH {CLUSTERS} SELECT letter, count(*) AS n_clusters FROM cl GROUP BY letter ORDER BY n_clusters DESC, letter LIMIT 15")
def a16_letter_frequencies(spark, sf_dir):
    return stats.letter_frequencies(clusters(spark, sf_dir))


@query(f"WITH {CLUSTERS} SELECT least(greatest(floor(italic * 20)::BIGINT + 1, 0), 21) AS bin, count(*) AS n FROM cl GROUP BY ALL")
def a21_histogram(spark, sf_dir):
    return stats.histogram(clusters(spark, sf_dir), "italic", 0.0, 1.0, 20)


@query(f"WITH {DISTANCES} SELECT style, round(quantile_cont(dist, 0.95), 6) AS p95 FROM ds WHERE dist > 0 GROUP BY style")
def a20_display_range(spark, sf_dir):
    return _distances(spark, sf_dir).filter("dist > 0").groupBy("style").agg(F.round(F.percentile("dist", F.lit(0.95)), 6).alias("p95"))


@query(f"WITH {CLUSTERS} SELECT doc, count(DISTINCT letter) AS n_letters, count(*) AS n_clusters FROM cl GROUP BY doc")
def a10_distinct_counts(spark, sf_dir):
    return clusters(spark, sf_dir).groupBy("doc").agg(F.countDistinct("letter").alias("n_letters"), F.count("*").alias("n_clusters"))


@query(f"WITH {CLUSTERS} SELECT cluster_id, italic, n FROM cl ORDER BY italic DESC, n DESC, cluster_id LIMIT 100")
def w8_most_italic(spark, sf_dir):
    return clusters(spark, sf_dir).select("cluster_id", "italic", "n").orderBy(F.col("italic").desc(), F.col("n").desc(), "cluster_id").limit(100)


@query("SELECT c_custkey, CASE WHEN r = 'hidden' THEN 'known' WHEN p <> 'unknown' AND r = 'nan' THEN 'known' ELSE r END AS remark FROM (SELECT c_custkey, CASE WHEN c_nationkey % 3 = 0 THEN 'unknown' ELSE 'P' END AS p, CASE WHEN c_custkey % 4 = 0 THEN 'hidden' WHEN c_custkey % 4 = 1 THEN 'new' ELSE 'nan' END AS r FROM customer)")
def p16_remarks(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").selectExpr("c_custkey", "CASE WHEN c_nationkey % 3 = 0 THEN 'unknown' ELSE 'P' END AS p", "CASE WHEN c_custkey % 4 = 0 THEN 'hidden' WHEN c_custkey % 4 = 1 THEN 'new' END AS r")
    return rows.select("c_custkey", normal_remark(F.col("p"), F.col("r")).alias("remark"))


