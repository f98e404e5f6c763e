"""Hand-computed cases, models and invariants of the operators."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphkin import config
from glyphkin.functions import text as tx
from glyphkin.functions.geometry import polygon_iou
from glyphkin.functions.stats import alpha_values, binomial_tail
from glyphkin.functions.vectors import cosine_distance
from glyphkin.operators import clusters as stats, distances as dist, documents, italic, matching, scoring, spatial
from glyphkin.sources import files, sinks
from glyphkin.streaming.incremental import process_new


def test_alpha_grid():
    a = alpha_values()
    assert len(a) == 17 and a[0] == 0.003125 and a[-1] == 0.8 and a == sorted(a)


def test_settings():
    c = config.load(filtering={"label_confidence_min": 0.7}, epsilon=0.1)
    assert c.filtering.label_confidence_min == 0.7 and c.filtering.top_clusters_per_letter == 5 and c.epsilon == 0.1
    with pytest.raises(ValueError):
        config.load(metric="best")
    with pytest.raises(ValueError):
        config.load(filtering={"nothing": 1})


def test_settings_file(tmp_path):
    p = tmp_path / "c.yaml"
    p.write_text("styles: {italic_max: 0.2}\nalphas: {exponent_range: [-2, 1]}\n")
    c = config.load(p)
    assert c.styles.italic_max == 0.2 and c.styles.italic_min == 0.4 and c.alphas.exponent_range == (-2, 1)


def test_binomial_tail(spark):
    rows = [(k, n, a) for n in (0, 1, 5, 25) for k in range(-1, n + 2) for a in (0.003125, 0.1, 0.8)]
    got = spark.createDataFrame(rows, "k int, n int, a double").withColumn("p", binomial_tail(F.col("k"), F.col("n"), F.col("a"))).collect()
    for k, n, a, p in got:
        want = sum(math.comb(n, i) * a**i * (1 - a) ** (n - i) for i in range(max(k, 0), n + 1))
        assert p == pytest.approx(want, abs=1e-12)


def test_binomial_tail_of_many_trials(spark):
    """Against whole numbers, and a pair of 600 letters that chance explains."""
    from fractions import Fraction

    rows = [(k, n, a) for n in (600, 1000) for k in (1, 60, n // 2, n - 1, n) for a in (0.003125, 0.5, 0.8)] + [(2500, 5000, 0.5)]
    got = spark.createDataFrame(rows, "k int, n int, a double").withColumn("p", binomial_tail(F.col("k"), F.col("n"), F.col("a"))).collect()
    for k, n, a, p in got:
        if n == 5000:
            want = float(Fraction(sum(math.comb(n, i) for i in range(k, n + 1)), 2**n))
        else:
            x = Fraction(a)
            want = float(sum(math.comb(n, i) * x**i * (1 - x) ** (n - i) for i in range(k, n + 1)))
        assert p == pytest.approx(want, abs=1e-9)
    counts = spark.createDataFrame([("r", "a", "b", 0, 0.1, 600, 60), ("r", "a", "b", 1, 0.2, 600, 120)], "style string, doc_a string, doc_b string, a int, alpha double, n int, k int")
    assert [r.n1hat for r in scoring.scores(counts, 100, 0.01).collect()] == [0]


def test_quantiles_by_rank(spark):
    """Selected by rank they are those of all values in order: ties, one value, narrow and wide ranges."""
    rng = np.random.default_rng(0)
    values = {"a": rng.random(2000), "b": [0.5] * 300, "c": [0.3], "d": np.round(rng.random(500), 1), "e": [1.0, 2.0], "f": [*(rng.random(500) * 1e-9), 5.0]}
    ds = spark.createDataFrame([("r", k, "x", "y", float(v)) for k, vs in values.items() for v in vs], "style string, letter string, doc_a string, doc_b string, dist double")
    got = {(r.letter, r.a): r.q for r in scoring.quantiles(ds, largest=10).collect()}
    for k, vs in values.items():
        want = np.quantile(np.asarray(vs), alpha_values())
        assert [got[k, a] for a in range(len(want))] == pytest.approx(want.tolist(), rel=1e-12)
    assert scoring.ranked_quantiles(ds.limit(0), ["style", "letter"], "dist", [0.5]).count() == 0


@pytest.mark.parametrize("metric", ["cosine", "euclidean", "correlation"])
def test_tiles_give_the_least_of_all_pairs(spark, metric, monkeypatch):
    """Every pair of documents meets in one tile, whatever the blocks; equal distances go to the smallest ids."""
    rng = np.random.default_rng(3)
    rows = [("roman", "ab"[i % 2], f"d{i % 9}", i, rng.integers(0, 3, 4).astype(float).tolist()) for i in range(80)]
    c = spark.createDataFrame(rows, "style string, letter string, doc string, cluster_id int, v array<double>")
    want = {}
    for i, (_, la, da, ca, va) in enumerate(rows):
        for _, lb, db, cb, vb in rows:
            if la == lb and da < db:
                x, y = np.array(va), np.array(vb)
                if metric == "correlation":
                    x, y = x - x.mean(), y - y.mean()
                size = np.linalg.norm(x) * np.linalg.norm(y)
                d = np.linalg.norm(x - y) if metric == "euclidean" else 1.0 if size == 0 else 1 - x @ y / size
                new = (round(float(d), 6) + 0.0, ca, cb)
                want[la, da, db] = min(want.get((la, da, db), new), new)
    monkeypatch.setattr(dist, "STRIP", 7)
    monkeypatch.setattr(dist.tiled, "__defaults__", (2,))
    got = {(r.letter, r.doc_a, r.doc_b): (r.dist + 0.0, r.ca, r.cb) for r in dist.least_distances(c, metric, 6).collect()}
    assert got == want
    pairs = dist.document_distances(dist.cluster_pairs(c, metric), 6)
    assert {(r.letter, r.doc_a, r.doc_b): (r.dist + 0.0, r.ca, r.cb) for r in pairs.collect()} == want


def test_mean_arrays(spark, monkeypatch):
    """Arrays of several lengths, null entries and null arrays; keys in pieces of two a task."""
    from glyphkin.operators import arrays

    monkeypatch.setattr(arrays, "HELD_KEYS", 2)
    rows = [("a", 1, [1.0, 2.0]), ("a", 1, [3.0]), ("a", 1, [None, 6.0, 9.0]), (None, 1, [5.0]), ("b", None, [1.0]), ("b", None, [2.0]), ("c", 2, None), ("d", 1, [float("nan"), 1.0])]
    got = {(r.k, r.j): r.m for r in arrays.mean_arrays(spark.createDataFrame(rows, "k string, j int, v array<double>"), ["k", "j"], "v", "m").collect()}
    assert math.isnan(got.pop(("d", 1))[0])
    assert got == {("a", 1): [2.0, 4.0, 9.0], (None, 1): [5.0], ("b", None): [1.5]}


def test_names_that_hold_each_other(spark):
    """Joined on rare pieces, as every name against every other."""
    names = ["", "a", "Supplier#1", "Supplier#12", "plier#1", "x", "abcabc", "abcabcabc", "lier", "nothing at all"]
    docs = ["Supplier#1", "Supplier#123", "r#12", "", "abcabcab", "zzz", "lier"]
    m = spark.createDataFrame([(i, n, f"P{i}", None, i) for i, n in enumerate(names)], "row int, FileName string, Printer string, Remarks string, Index int")
    got = {r.doc: r["index"] for r in matching.with_metadata(spark.createDataFrame([(d,) for d in docs], "doc string"), m).collect()}
    want = {}
    for d in docs:
        exact = [i for i, n in enumerate(names) if n == d]
        want[d] = min(exact or [i for i, n in enumerate(names) if n in d or d in n] or [-1])
    assert got == want
    files = spark.createDataFrame([("x-a-1.pdf",), ("x-b-12.pdf",), ("a-1.pdf",), ("q%_.pdf",)], "file string")
    wanted = spark.createDataFrame([("a/1",), ("1",), ("*",), ("?-1*",), ("b/?2",), ("[",), ("%_",)], "Signature string")
    found = sorted((r.Signature, r.file) for r in matching.files_of_signatures(wanted, files).fillna("").collect())
    assert found == sorted([("a/1", "x-a-1.pdf"), ("a/1", "a-1.pdf"), ("1", "x-a-1.pdf"), ("1", "a-1.pdf"), ("*", "x-a-1.pdf"), ("*", "x-b-12.pdf"), ("*", "a-1.pdf"), ("*", "q%_.pdf"), ("?-1*", "x-a-1.pdf"), ("?-1*", "x-b-12.pdf"), ("?-1*", "a-1.pdf"), ("b/?2", "x-b-12.pdf"), ("[", ""), ("%_", "q%_.pdf")])


def test_first_n1(spark):
    """Three documents, epsilon 0.01, one level 0.1, five letters: k of 3, 4, 5 give 0, 1, 3."""
    counts = spark.createDataFrame([("r", "a", str(k), 0, 0.1, 5, k) for k in (3, 4, 5)], "style string, doc_a string, doc_b string, a int, alpha double, n int, k int")
    got = {r.doc_b: r.n1hat for r in scoring.scores(counts, 3, 0.01).collect()}
    assert got == {"3": 0, "4": 1, "5": 3}


def model_scores(ds, letters, docs, alphas, epsilon):
    """n and n1hat of all pairs from a table of distances, by the definition."""
    q = {s: np.quantile(sorted(d for (t, _, _), d in ds.items() if t == s), alphas) for s in letters}
    tests = len(docs) * (len(docs) - 1) // 2
    tail = lambda k, n, a: sum(math.comb(n, i) * a**i * (1 - a) ** (n - i) for i in range(max(k, 0), n + 1))
    out = {}
    for a, b in itertools.combinations(docs, 2):
        own = {s: ds[s, a, b] for s in letters if (s, a, b) in ds}
        if own:
            k = [sum(d < q[s][i] for s, d in own.items()) for i in range(len(alphas))]
            n = len(own)
            n1 = next(m for m in range(n + 1) if min(tail(x - m, n - m, al) for x, al in zip(k, alphas)) >= epsilon / tests)
            out[a, b] = (n, n1)
    return out


def planted(seed):
    """Six documents, twelve letters; the first two are alike in eight of them."""
    rng = random.Random(seed)
    docs, letters = "abcdef", "abcdefghijkl"
    ds = {}
    for i, s in enumerate(letters):
        for a, b in itertools.combinations(docs, 2):
            if rng.random() < 0.95:
                ds[s, a, b] = round(0.001 * rng.random() if (a, b) == ("a", "b") and i < 8 else 0.3 + 0.5 * rng.random(), 6)
    return ds, letters, docs


@pytest.mark.parametrize("seed", range(3))
def test_scores_against_the_definition(spark, seed):
    ds, letters, docs = planted(seed)
    df = spark.createDataFrame([("roman", s, a, b, d) for (s, a, b), d in ds.items()], "style string, letter string, doc_a string, doc_b string, dist double")
    got = {(r.doc_a, r.doc_b): (r.n, r.n1hat) for r in scoring.score_documents(df, len(docs)).collect()}
    assert got == model_scores(ds, letters, docs, alpha_values(), 0.01)
    assert got["a", "b"][1] >= 1 and got["a", "b"][1] == max(v[1] for v in got.values())
    loose = {(r.doc_a, r.doc_b): r.n1hat for r in scoring.score_documents(df, len(docs), epsilon=1.0).collect()}
    assert all(loose[p] >= got[p][1] for p in got)


def test_candidates_and_weights(spark):
    ds, letters, docs = planted(0)
    df = spark.createDataFrame([("roman", s, a, b, d) for (s, a, b), d in ds.items()], "style string, letter string, doc_a string, doc_b string, dist double")
    levels = scoring.quantiles(df)
    scored = scoring.scores(scoring.letters_below(df, levels), 15)
    c = {(r.doc_a, r.doc_b): r.letters for r in scoring.candidates(scored, df, levels).collect()}
    assert set("abcdefgh") - {s for s in letters if (s, "a", "b") not in ds} <= set(c["a", "b"])
    w = {(r.doc_a, r.doc_b): r for r in scoring.weighted(scored).collect()}
    assert all(x.weight == (x.n1hat / x.n if x.n1hat else 0) for x in w.values())


def test_weights_of_two_styles(spark):
    scored = spark.createDataFrame([("roman", "a", "b", 12, 3, 0), ("italic", "a", "b", 4, 4, 0), ("roman", "a", "c", 5, 0, 0)], "style string, doc_a string, doc_b string, n int, n1hat int, a int")
    docs = spark.createDataFrame([(s, d) for s in ("roman", "italic") for d in "abc"] + [("roman", "z")], "style string, doc string")
    got = {(r.doc_a, r.doc_b): (r.weight, r.distance, r.total) for r in scoring.combined(scored, docs).collect()}
    assert got == {("a", "b"): (0.625, 0.375, 1.25), ("a", "c"): (0, 1, 0)}
    only = scoring.combined(scored.filter("style = 'roman'"), docs.filter("style = 'roman'"), "italic")
    assert {(r.doc_a, r.doc_b): r.weight for r in only.collect()}["a", "b"] == 0.25
    lone = {r.doc: r.isolated for r in scoring.connected(scoring.combined(scored, docs), docs.filter("doc < 'd'")).collect()}
    assert lone == {"a": False, "b": False, "c": True}


def test_cluster_selection(spark):
    rows = [("d", i, "x", 0.9, n, it, [1.0, float(i)]) for i, (n, it) in enumerate([(9, 0.1), (8, 0.0), (7, 0.0), (6, 0.0), (5, 0.0), (4, 0.0), (50, 0.25), (50, 0.4)])] + [("d", 90, ",", 0.9, 99, 0.0, [1.0, 1.0]), ("d", 91, "x", 0.5, 99, 0.0, [1.0, 1.0])]
    c = spark.createDataFrame(rows, "doc string, cluster_id int, letter string, share double, n int, italic double, v array<double>")
    got = {(r.style, r.cluster_id) for r in dist.select_clusters(c).collect()}
    assert got == {("roman", i) for i in range(5)} | {("italic", 7)}


def test_coverage(spark):
    docs = spark.createDataFrame([(str(i),) for i in range(9)], "doc string")
    s = spark.createDataFrame([("r", "a", d) for d in "01"] + [("r", "b", d) for d in "012"], "style string, letter string, doc string")
    assert [r.letter for r in dist.covered_letters(s, docs).collect()] == ["b"]
    assert {r.letter: (r.needed, r.kept) for r in dist.coverage_report(s, docs).collect()} == {"a": (3, False), "b": (3, True)}


def test_zero_vectors(spark):
    r = spark.createDataFrame([([0.0, 0.0], [1.0, 2.0]), ([2.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>").select(cosine_distance(F.col("a"), F.col("b"))).collect()
    assert [x[0] for x in r] == [1.0, 0.0]


def test_registered_to_mean(spark):
    y, x = np.mgrid[:12, :12]
    img = lambda c: np.exp(-((x - c) ** 2 + (y - 6) ** 2) / 6).ravel().tolist()
    c = spark.createDataFrame([("roman", "a", str(i), i, img(5 + i)) for i in range(3)], "style string, letter string, doc string, cluster_id int, v array<double>")
    out = np.array([r.v for r in dist.registered_to_mean(c, "translation", (12, 12)).collect()])
    assert out.std(0).mean() < 0.3 * np.array([img(5 + i) for i in range(3)]).std(0).mean()


def test_complicated_words(spark):
    rows = [(7.0, "faz"), (7.0, "mar"), (3.0, "faz"), (-360.0, "x"), (None, "x"), (float("nan"), "x"), (7.0, None)]
    got = spark.createDataFrame(rows, "stroke double, text string").select(italic.complicated(F.col("stroke"), F.col("text"), F.lit(5.0))).collect()
    assert [r[0] for r in got] == [True, False, False, True, True, True, False]


def test_effective_stroke_of_neighbours(spark):
    """The complicated word takes the stroke of the good one of its two neighbours."""
    w = [("d", "p", 0, 0, 20, 100, 140, "faz", 7.0), ("d", "p", 1, 0, 20, 50, 95, "mar", 2.0), ("d", "p", 2, 0, 20, 145, 190, "zoo", 9.0), ("d", "p", 3, 300, 320, 100, 140, "faz", 8.0)]
    words = spark.createDataFrame(w, "doc string, page string, word_idx int, t int, b int, l int, r int, text string, stroke double")
    th = spark.createDataFrame([("d", 5.0)], "doc string, threshold double")
    got = {r.word_idx: (r.effective, r.is_italic) for r in italic.italic_words(italic.effective_strokes(words, th)).collect()}
    assert got == {0: (2.0, False), 1: (2.0, False), 2: (9.0, True), 3: (8.0, True)}


def test_thresholds_need_ten_strokes(spark):
    w = spark.createDataFrame([("a", float(i)) for i in range(9)] + [("b", float(i)) for i in range(10)] + [("c", 3.0)] * 12, "doc string, stroke double")
    got = {r.doc: r for r in italic.thresholds(w).collect()}
    assert set(got) == {"b", "c"} and got["c"].threshold == 3.0
    assert got["b"].threshold == pytest.approx(np.quantile(range(10), 0.9))


def test_majority(spark):
    c = spark.createDataFrame([("d", 1, x) for x in "baba"] + [("d", 2, x) for x in "aaab"], "doc string, cluster int, label string")
    got = {r.cluster: (r.label, r.share, r.n) for r in stats.majority_labels(c).collect()}
    assert got == {1: ("a", 0.5, 4), 2: ("a", 0.75, 4)}
    assert [r.cluster for r in stats.usable(stats.majority_labels(c)).collect()] == [2]


def test_page_angle(spark):
    w = spark.createDataFrame([("p", 0, 10, 10, 10, 10), ("p", 1, 9000, 9000, 9000, 9000)], "page string, word_idx int, t int, b int, l int, r int")
    n = spark.createDataFrame([("p", 12, 10, 10.0), ("p", 10, 11, -5.0), ("p", 2000, 2000, 33.0)], "page string, x int, y int, angle double")
    got = {r.word_idx: r.page_angle for r in spatial.page_angles(w, n, ["page"], 100, 100).collect()}
    assert got[0] == pytest.approx(0) and got[1] == 33.0


def test_chars_to_words_against_all_pairs(spark):
    rng = random.Random(4)

    def box(i, size):
        x, y = rng.randrange(300), rng.randrange(120)
        return ("p", i, [x, y, x + size, y + rng.randrange(3), x + size, y + 14, x, y + 14])

    words, chars = [box(i, 40) for i in range(25)], [box(i, 9) for i in range(80)]
    a = spark.createDataFrame(chars, "page string, char_idx int, polygon array<int>")
    b = spark.createDataFrame(words, "page string, word_idx int, polygon array<int>")
    want = {}
    for _, i, p in chars:
        v, j = max((round(polygon_iou(p, q), 12), -j) for _, j, q in words)
        if v > 0:
            want[i] = -j
    assert {r.char_idx: r.word_idx for r in spatial.chars_to_words(a, b, ["page"], 64).collect()} == want


def test_dpi(spark):
    r = spark.createDataFrame([(125.0,), (175.0,), (20.0,), (151.0,), (None,)], "m double").select(tx.rounded_dpi(F.col("m"))).collect()
    assert [x[0] for x in r] == [100, 200, 50, 150, 150]


def test_names(spark):
    r = spark.createDataFrame([("K/123/4", "Anna von Berg"), ("a_b%", " "), ("A?/2", "X")], "s string, n string")
    got = r.select(tx.signature_pattern(F.col("s")), tx.short_name(F.col("n")), tx.short_name(F.col("n"), names={"X": "Y"})).collect()
    assert [tuple(x) for x in got] == [("%K-123-4.pdf", "Berg", "Berg"), ("%a\\_b\\%.pdf", " ", " "), ("%A_-2.pdf", "X", "Y")]
    assert [x[0] for x in spark.createDataFrame([({"b": 1.0, "a": 1.0, "c": 0.5},), ({},)], "m map<string,double>").select(tx.best_label(F.col("m"))).collect()] == ["a", "?"]


def test_lexicon_against_all_pairs(spark):
    rng = random.Random(8)
    make = lambda: "".join(rng.choice("ab") for _ in range(rng.randrange(1, 7)))
    words, lexicon = {make() for _ in range(80)}, {make() for _ in range(30)}

    def edits(a, b):
        d = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            n = [i]
            for j, y in enumerate(b, 1):
                n.append(min(d[j] + 1, n[-1] + 1, d[j - 1] + (x != y)))
            d = n
        return d[-1]

    for most in (1, 2):
        want = {w: min((edits(w, e), e.upper()) for e in lexicon) for w in words}
        got = matching.lexicon_matches(spark.createDataFrame([(w,) for w in words], "word string"), spark.createDataFrame([(e,) for e in lexicon], "entry string"), most)
        assert {r.word: (r.distance, r.entry) for r in got.collect()} == {w: v for w, v in want.items() if v[0] <= most}


def test_tables_without_rows(spark):
    c = spark.createDataFrame([], "doc string, cluster_id int, letter string, share double, n int, italic double, v array<double>")
    assert dist.compute_distances(c).count() == 0
    d = spark.createDataFrame([], "style string, letter string, doc_a string, doc_b string, dist double")
    assert scoring.score_documents(d, 5).count() == 0


def test_words_json(spark, tmp_path):
    path = f"file://{tmp_path}/corpus"
    (tmp_path / "corpus" / "d1").mkdir(parents=True)
    (tmp_path / "corpus" / "d1" / "p1.json").write_text('[{"tblr": [1, 2, 3, 4], "text": "ab", "chars": [{"tblr": [1, 2, 3, 4], "labels": {"a": 0.9, "b": 0.1}}]},\n {"tblr": [5, 6, 7, 8]}]')
    got = files.read_words(spark, path).orderBy("word_idx").collect()
    assert [(r.doc, r.page, r.word_idx, r.tblr, r.text) for r in got] == [("d1", "p1", 0, [1, 2, 3, 4], "ab"), ("d1", "p1", 1, [5, 6, 7, 8], None)]
    assert got[0].chars[0].labels == {"a": 0.9, "b": 0.1}


def test_words_json_written_and_read_back(spark, tmp_path):
    path = f"file://{tmp_path}/words"
    rows = [("d/1 ü%", "007", 0, "a\nb"), ("d/1 ü%", "007", 1, "é\u2028\U0001f600"), ("..", "+ =", 3, None), (None, "p", 0, ""), ("d", "", 0, "x")]
    old = spark.createDataFrame([("gone", "p", 0, "x")], "doc string, page string, word_idx int, text string")
    sinks.write_words_json(old, path)
    sinks.write_words_json(spark.createDataFrame(rows, old.schema), path)
    got = sorted((tuple(r) for r in sinks.read_words_json(spark, path, "text: string").collect()), key=str)
    want = [(d, p or None, 0 if k == 3 else k, t) for d, p, k, t in rows]
    assert got == sorted(want, key=str)
    # a file a page, without a folder of its own
    assert len(list((tmp_path / "words").glob("doc=*/page=*.json"))) == 4 == sum(p.is_file() and p.suffix == ".json" for p in (tmp_path / "words").rglob("*"))


def test_crops_are_computed_once_a_word(spark, sf):
    from glyphkin.plans import QUERIES

    plan = QUERIES["p8_boxes_in_crops"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    # the least top and left, the largest bottom and right, each written out once and not again in a filter
    assert plan.count("array_min(") == plan.count("array_max(") == 2 and "transform(" not in plan


def test_page_angles_without_a_row_a_pair(spark):
    rng = random.Random(4)
    words = [(rng.choice("pq"), rng.randrange(60), *(lambda t, l: (t, t + 20, l, l + 30))(rng.randrange(0, 300, 10), rng.randrange(0, 300, 10))) for _ in range(150)] + [("none", 1, 0, 2, 0, 2), (None, 1, 0, 2, 0, 2)]
    windows = [(p, x, y, None if (x, y) == (150, 50) else float((x * 7 + y * 3) % 90 - 45)) for p in "pq" for x in (50, 100, 150) for y in (50, 100, 150)]
    w = spark.createDataFrame(words, "page string, word_idx long, t int, b int, l int, r int").distinct()
    n = spark.createDataFrame([*windows, (None, 1, 1, 1.0)], "page string, x int, y int, angle double")
    want = {}
    for page, idx in {r[:2] for r in words if r[0] in ("p", "q")}:
        spots = {((l + r) / 2, (t + b) / 2) for q, k, t, b, l, r in words if (q, k) == (page, idx)}
        pairs = [(math.hypot(x - cx, y - cy), y, x, a, x - 50 <= cx < x + 50 and y - 50 <= cy < y + 50) for cx, cy in spots for q, x, y, a in windows if q == page]
        held = [(1 / max(d, 1), a) for d, _, _, a, inside in pairs if inside]
        known = [a * v for v, a in held if a is not None]
        nearest = min(pairs, key=lambda v: (round(v[0], 9), v[1], v[2]))[3]
        want[page, idx] = (sum(known) / sum(v for v, _ in held) if known else None) if held else nearest
    found = spatial.page_angles(w, n, ["page"], 100, 100)
    got = {(r.page, r.word_idx): r.page_angle for r in found.collect()}
    assert got.keys() == want.keys() and all((got[k] is None) == (v is None) and (v is None or math.isclose(got[k], v, abs_tol=1e-9)) for k, v in want.items())
    assert None in want.values() and "Join" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_touching_boxes_in_flat_cells(spark):
    rng = random.Random(5)
    some = lambda n: [("p", k, {"t": (t := rng.randrange(-40, 200)), "b": t + rng.randrange(0, 40), "l": (le := rng.randrange(-40, 300)), "r": le + rng.randrange(0, 90)}) for k in range(n)]
    a, b = some(60), some(50)
    box = "struct<t: int, b: int, l: int, r: int>"
    found = spatial.touching(spark.createDataFrame(a, f"page string, i int, a_box {box}"), spark.createDataFrame(b, f"page string, j int, b_box {box}"), ["page"], cell=50, height=8)
    want = [(i, j) for _, i, x in a for _, j, y in b if x["l"] <= y["r"] and x["r"] >= y["l"] and x["t"] <= y["b"] and x["b"] >= y["t"]]
    assert sorted((r.i, r.j) for r in found.collect()) == sorted(want)


def test_array_files(spark, tmp_path):
    (tmp_path / "d2").mkdir()
    np.savez_compressed(tmp_path / "d2" / "p_data.npz", char_imgs=np.arange(12, dtype=np.float32).reshape(2, 2, 3), char_labels=np.array(["a", "é"]), char_word_idx=np.array([0, 3], np.int32))
    got = files.read_npz(spark, f"file://{tmp_path}").orderBy("char_idx").collect()
    assert [(r.doc, r.page, r.char_idx, r.word_idx, r.label, r.img) for r in got] == [("d2", "p", 0, 0, "a", [0, 1, 2, 3, 4, 5]), ("d2", "p", 1, 3, "é", [6, 7, 8, 9, 10, 11])]


def test_metadata_choice(spark, tmp_path):
    assert files.prefer_metadata(["x/a.csv", "x/my_corpus.csv", "x/z_table.csv"]) == "x/z_table.csv"
    assert files.prefer_metadata(["b.csv", "a.csv"]) == "a.csv" and files.prefer_metadata([]) is None
    (tmp_path / "the_table.csv").write_text("Index,Printer,FileName\n1,Berg,doc1\n2,,doc2\n")
    got = files.read_metadata(spark, f"file://{tmp_path}").orderBy("row").collect()
    assert [(r.Index, r.Printer, r.FileName, r.Remarks) for r in got] == [(1, "Berg", "doc1", None), (2, None, "doc2", None)]
    (tmp_path / "the_table.csv").write_text("Index,Printer\n1,Berg\n")
    assert files.read_metadata(spark, f"file://{tmp_path}") is None


def test_metadata_join(spark):
    m = spark.createDataFrame([(0, "doc10", "P", None, 1), (1, "doc1", None, "new", 2)], "row int, FileName string, Printer string, Remarks string, Index int")
    d = spark.createDataFrame([("doc1",), ("oc10",), ("nothing",), ("doc1-extra",)], "doc string")
    got = {r.doc: (r["printer"], r["remark"], r["index"]) for r in matching.with_metadata(d, m).collect()}
    assert got == {"doc1": ("unknown", "new", 2), "oc10": ("P", "nan", 1), "nothing": ("unknown", "nan", -1), "doc1-extra": ("unknown", "new", 2)}


def test_text_sources(spark, tmp_path):
    (tmp_path / "lexicon.txt").write_text("# head\n alpha \nbeta\n")
    (tmp_path / "chars.txt").write_text("a\x1f0\n\"\x1f1\n")
    (tmp_path / "catalogue.csv").write_text("Signature\n T/1/2 \n   \nX\n")
    assert [r.entry for r in files.read_lexicon(spark, f"file://{tmp_path}/lexicon.txt").collect()] == ["alpha", "beta"]
    assert {(r.char, r.id) for r in files.read_char_dict(spark, f"file://{tmp_path}/chars.txt").collect()} == {("A", 0), ('"', 1)}
    assert [r.Signature for r in files.read_catalogue(spark, f"file://{tmp_path}/catalogue.csv").collect()] == ["T/1/2", "X"]


def test_discovery_and_copies(spark, tmp_path):
    (tmp_path / "src" / "scan").mkdir(parents=True)
    (tmp_path / "src" / "a.pdf").write_bytes(b"1")
    (tmp_path / "src" / "scan" / "p1.tif").write_bytes(b"22")
    got = files.discover(spark, f"file://{tmp_path}/src").collect()
    assert [(r.source.rsplit("/", 1)[-1], r.kind) for r in got] == [("a.pdf", "pdf"), ("scan", "tiff")]
    todo = spark.createDataFrame([(f"file://{tmp_path}/src/a.pdf",)], "file string")
    assert [r.bytes for r in sinks.copy_files(todo, f"file://{tmp_path}/out").collect()] == [1]
    assert sinks.copy_files(todo, f"file://{tmp_path}/out", skip_existing=True).count() == 0


def test_word_lines(spark, tmp_path):
    w = spark.createDataFrame([("d", "p", [1, 2, 3], "hi")], "doc string, page string, polygon array<int>, text string")
    sinks.write_word_lines(w, f"file://{tmp_path}/w")
    assert spark.read.text(f"file://{tmp_path}/w").first().value == "1,2,3,hi"


def test_stream_takes_each_file_once(spark, tmp_path):
    src, out, cp = (f"file://{tmp_path}/{x}" for x in ("in", "out", "cp"))
    step = lambda df: df.withColumn("y", F.col("x") * 2)
    for part in ((1, 2), (2, 3)):
        spark.createDataFrame([(x,) for x in part], "x long").write.mode("append").parquet(src)
        process_new(spark, src, "x long", step, out, ["x"], cp).awaitTermination()
    assert sorted(tuple(r) for r in spark.read.parquet(out).collect()) == [(1, 2), (2, 4), (3, 6)]


def test_ordering(spark):
    d = spark.createDataFrame([("b",), ("a",), ("c",)], "doc string")
    i = spark.createDataFrame([("c", 0)], "doc string, index int")
    assert {r.doc: r.place for r in documents.ordered_documents(d, i).collect()} == {"c": 1, "a": 2, "b": 3}


def test_whole_catalogue_meets_all_files(spark, sf):
    """Every signature of every part, against file names one by one."""
    import fnmatch

    from glyphkin.plans import QUERIES

    part = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", "p_brand").collect()
    names = {f"scan_{b.replace('#', '-')}-{k % 40}.pdf" for k, b in part}
    signatures = {f"Brand-?/{k % 40}" if k % 17 == 0 else f"none/{k}" if k % 13 == 0 else f"{b.replace('#', '/')}/{k % 40}" for k, b in part}
    want = set()
    for s in signatures:
        found = fnmatch.filter(names, f"*{s.replace('/', '-')}.pdf")
        want |= {(s, f) for f in found or [None]}
    got = [tuple(r) for r in QUERIES["j10_files_of_all_signatures"](spark, sf).select("Signature", "file").collect()]
    assert len(got) == len(want) and set(got) == want
    assert {s for s, _ in got} == signatures


def test_bytes_of_vectors_in_single_precision(spark, tmp_path):
    """A thousand times these numbers is a whole number in single precision, and below it in double precision."""
    from glyphkin.plans import kernel_queries, scan_queries

    path = str(tmp_path)
    rows = spark.createDataFrame([(0, [np.float32(v).item() for v in (-0.061, 0.053, 0.072, 0.5)], 0)], "vec_id long, embedding array<float>, label int")
    rows.write.parquet(f"{path}/embeddings.parquet")
    for module in (scan_queries, kernel_queries):
        assert module._pixels(spark, path).first()["p"] == [195, 53, 72, 244]


def join_rows(df):
    """The most rows that a join of the query's last run has given."""

    def walk(node):
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if kind.endswith("QueryStageExec"):
            return walk(node.plan())
        rows = node.metrics().get("numOutputRows")
        own = rows.get().value() if "Join" in kind and rows.isDefined() else 0
        children = node.children()
        return max([own, *(walk(children.apply(i)) for i in range(children.length()))])

    df.collect()
    return walk(df._jdf.queryExecution().executedPlan())


def test_neighbours_of_words_in_one_place(spark):
    """Narrow words that reach those of their own place, 400 of each: against all pairs, without joining all pairs."""
    rng = random.Random(5)
    at = [(10, 30, x, x + 8) for x in (0, 14, 29)] + [(40, 60, 0, 8)]
    rows = [("d", "p", i, *rng.choice(at)) for i in range(1600)]
    words = spark.createDataFrame(rows, "doc string, page string, word_idx long, t int, b int, l int, r int")
    found = italic.side_neighbours(words)
    got = {(r["word_idx"], r["rank"]): (r["gap"], r["other_idx"]) for r in found.collect()}
    want = {}
    for _, _, i, t, b, left, right in rows:
        near = sorted((min(abs(right - l2), abs(left - r2)), j) for _, _, j, t2, _, l2, r2 in rows if j != i and t2 == t and min(abs(right - l2), abs(left - r2)) < 10)
        want |= {(i, k + 1): x for k, x in enumerate(near[:2])}
    assert got == want
    assert join_rows(found) < 10 * len(rows)


def test_representatives_make_no_row_of_a_pair(spark):
    """The quantile of each candidate against brute force, from a plan without a join of candidates to candidates."""
    rng = np.random.default_rng(3)
    v = rng.normal(size=(60, 4))
    v[7] = 0
    rows = [("ab"[i % 2], f"d{i % 5}" if i % 2 == 0 else "d0", i, v[i].tolist()) for i in range(60)]
    found = stats.representatives(spark.createDataFrame(rows, "letter string, doc string, cluster_id long, v array<double>"), digits=6)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
    want = {}
    for letter, doc, i, x in rows:
        far = [1.0 if not np.any(x) or not np.any(y) else 1 - np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y) for other, d, _, y in rows if other == letter and d != doc]
        worth = round(float(np.quantile(np.round(far, 6), 0.25)), 6) if far else math.inf
        want[letter, doc] = min(want.get((letter, doc), (math.inf, math.inf)), (worth, i))
    assert {(r.letter, r.doc): r.cluster_id for r in found.collect()} == {k: i for k, (_, i) in want.items()}
