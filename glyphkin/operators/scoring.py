"""The a-contrario test: which pairs of documents are closer in more letters than chance allows.

Distances: (style, letter, doc_a, doc_b, dist). For each letter the background is the exact distribution of its
distances; k(alpha) letters of a pair lie below their alpha-quantile; n1hat is the least number of letters to take
away so that for every alpha the rest is explained by chance, P(Bin(n - n1, alpha) >= k - n1) >= epsilon / N.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..config import Alphas
from ..functions.stats import alpha_values, binomial_tail


#: The most distances of a letter whose values one task may hold at a time.
LARGEST_GROUP = 1 << 20
#: Equal parts that a letter's range is cut into, and each of them that holds a wanted rank again.
PARTS = 4096


def quantiles(distances: DataFrame, grid: Alphas = Alphas(), digits: int | None = None, largest: int = LARGEST_GROUP) -> DataFrame:
    """(style, letter, a, alpha, q): exact, linearly interpolated quantiles of each letter's distances.

    Distances are finite by construction. The sizes of the letters are counted first: where all have at most `largest`
    distances, percentile() holds a letter's values in a task; else they are selected by rank (ranked_quantiles).
    """
    alphas = alpha_values(grid)
    top = distances.groupBy("style", "letter").count().agg(F.max("count")).first()[0] or 0
    if top > largest:
        rows = ranked_quantiles(distances, ["style", "letter"], "dist", alphas)
    else:
        rows = distances.groupBy("style", "letter").agg(F.percentile("dist", F.array(*map(F.lit, alphas))).alias("q"))
        rows = rows.select("style", "letter", F.posexplode("q").alias("a", "q"))
    q = F.col("q") if digits is None else F.round("q", digits)
    return rows.select("style", "letter", "a", F.get(F.array(*map(F.lit, alphas)), F.col("a")).alias("alpha"), q.alias("q"))


def ranked_quantiles(rows: DataFrame, by: list[str], value: str, shares: list[float]) -> DataFrame:
    """(by, a, q): exact quantiles of finite values of groups of any size, by two histograms and a few values.

    A group's range is cut into equal parts, each part that holds a wanted rank into parts again; only the values of
    these smallest parts are put in order, by value and count. Histograms are pre-summed on the map side, and what is
    joined back has two rows a share and group.
    """
    span = rows.groupBy(*by).agg(F.min(value).cast("double").alias("low"), F.max(value).cast("double").alias("high"), F.count(value).alias("n")).filter("n > 0")
    share = F.explode(F.array(*(F.struct(F.lit(i).alias("a"), F.lit(x).alias("share")) for i, x in enumerate(shares)))).alias("s")
    place = (F.col("n") - 1) * F.col("s.share")
    wanted = span.select(*by, "n", share).select(*by, "s.a", F.floor(place).alias("r"), (place - F.floor(place)).alias("rest"), "n")
    wanted = wanted.select(*by, "a", "rest", F.explode(F.array("r", F.least(F.col("r") + 1, F.col("n") - 1))).alias("rank"), "r")
    ranks = wanted.select(*by, "rank").distinct()
    # the same double for the same value everywhere, and never less for a larger one
    at = F.when(F.col("high") > F.col("low"), (F.col(value) - F.col("low")) / (F.col("high") - F.col("low")) * PARTS).otherwise(F.lit(0.0))
    part = F.least(F.floor("x"), F.lit(PARTS - 1)).cast("int")
    fine = F.least(F.floor((F.col("x") - F.col("p1")) * PARTS), F.lit(PARTS - 1)).cast("int")
    placed = rows.filter(F.col(value).isNotNull()).join(span.drop("n"), by).withColumn("x", at).withColumn("p1", part).withColumn("p2", fine).select(*by, "p1", "p2", F.col(value).cast("double").alias("v"))

    def choose(counts: DataFrame, keys: list[str], part: str, ranks: DataFrame) -> DataFrame:
        """(keys, part, rank): where each rank lies, and which one it is in there."""
        upto = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, 0)
        counts = counts.withColumn("upto", F.sum("n").over(upto))
        held = ranks.join(counts, keys).filter((F.col("inner") >= F.col("upto") - F.col("n")) & (F.col("inner") < F.col("upto")))
        return held.select(*keys, part, "rank", (F.col("inner") - F.col("upto") + F.col("n")).alias("inner"))

    first = choose(placed.groupBy(*by, "p1").agg(F.count("*").alias("n")), by, "p1", ranks.withColumn("inner", F.col("rank")))
    near = placed.join(first.select(*by, "p1").distinct(), [*by, "p1"], "left_semi")
    second = choose(near.groupBy(*by, "p1", "p2").agg(F.count("*").alias("n")), [*by, "p1"], "p2", first)
    nearest = near.join(second.select(*by, "p1", "p2").distinct(), [*by, "p1", "p2"], "left_semi")
    third = choose(nearest.groupBy(*by, "p1", "p2", "v").agg(F.count("*").alias("n")), [*by, "p1", "p2"], "v", second)
    ends = wanted.join(third.select(*by, "rank", "v"), [*by, "rank"])
    low, high = (F.max(F.when(F.col("rank") == r, F.col("v"))) for r in (F.col("r"), F.col("r") + 1))
    ends = ends.groupBy(*by, "a", "rest").agg(low.alias("low"), high.alias("high"))
    return ends.select(*by, "a", F.when(F.col("rest") > 0, F.col("high") * F.col("rest") + F.col("low") * (1 - F.col("rest"))).otherwise(F.col("low")).alias("q"))


def cross_quantiles(target: DataFrame, reference: DataFrame, grid: Alphas = Alphas(), digits: int | None = None) -> DataFrame:
    """Quantiles of the reference corpus for letters that it has, else of the target; `from_reference` says which."""
    own, ref = quantiles(target, grid, digits), quantiles(reference, grid, digits)
    ref = ref.select("style", "letter", "a", F.col("q").alias("rq"))
    rows = own.join(ref, ["style", "letter", "a"], "left")
    return rows.select("style", "letter", "a", "alpha", F.coalesce("rq", "q").alias("q"), F.col("rq").isNotNull().alias("from_reference"))


def letters_below(distances: DataFrame, levels: DataFrame) -> DataFrame:
    """(style, doc_a, doc_b, a, alpha, n, k): letters of each pair, and those strictly below their quantile.

    The level table has one row for each letter and level; it is broadcast by the planner when it is small and
    joined by key otherwise.
    """
    rows = distances.select("style", "letter", "doc_a", "doc_b", "dist").join(levels, ["style", "letter"])
    return rows.groupBy("style", "doc_a", "doc_b", "a", "alpha").agg(F.count("*").cast("int").alias("n"), F.count_if(F.col("dist") < F.col("q")).cast("int").alias("k"))


def tails(counts: DataFrame) -> DataFrame:
    """(style, doc_a, doc_b, n, n1, p, a): for each n1 the least tail over all levels and the first level that has it."""
    each = counts.withColumn("n1", F.explode(F.sequence(F.lit(0), F.col("n"))))
    each = each.withColumn("p", binomial_tail(F.col("k") - F.col("n1"), F.col("n") - F.col("n1"), F.col("alpha")))
    return each.groupBy("style", "doc_a", "doc_b", "n", "n1").agg(F.min(F.struct("p", "a")).alias("m")).select("style", "doc_a", "doc_b", "n", "n1", "m.p", "m.a")


def scores(counts: DataFrame, tests: Column | int, epsilon: float = 0.01) -> DataFrame:
    """(style, doc_a, doc_b, n, n1hat, a): equation of the method; `a` is the best level at n1hat.

    tests: the number N of pairs of documents tested.
    """
    enough = F.col("p") >= F.lit(epsilon) / tests
    return tails(counts).filter(enough).groupBy("style", "doc_a", "doc_b", "n").agg(F.min(F.struct(F.col("n1").cast("int").alias("n1hat"), "a")).alias("m")).select("style", "doc_a", "doc_b", "n", "m.n1hat", "m.a")


def candidates(scored: DataFrame, distances: DataFrame, levels: DataFrame) -> DataFrame:
    """(style, doc_a, doc_b, letters): the letters below their quantile at the pair's best level, in order."""
    rows = scored.select("style", "doc_a", "doc_b", "a").join(distances, ["style", "doc_a", "doc_b"])
    rows = rows.join(levels.select("style", "letter", "a", "q"), ["style", "letter", "a"])
    below = F.when(F.col("dist") < F.col("q"), F.col("letter"))
    return rows.groupBy("style", "doc_a", "doc_b").agg(F.array_sort(F.collect_set(below)).alias("letters"))


def weighted(scored: DataFrame) -> DataFrame:
    """With weight = n1hat / n, 0 where n1hat is 0."""
    return scored.withColumn("weight", F.when(F.col("n1hat") > 0, F.col("n1hat") / F.col("n")).otherwise(F.lit(0.0)))


def combined(scored: DataFrame, documents: DataFrame, metric: str = "average") -> DataFrame:
    """(doc_a, doc_b, weight, distance, total) for each scored pair of documents that all available styles have.

    metric: one style, or the average; a style that no document has falls back to the other. A pair without letters
    in an available style weighs 0 there; pairs without any are absent rows of weight 0 and distance 1.
    documents: (style, doc), the documents each style is available for.
    """
    styles = documents.select("style", "doc").distinct()
    available = styles.agg(F.max((F.col("style") == "roman").cast("int")).alias("has_r"), F.max((F.col("style") == "italic").cast("int")).alias("has_i"))
    shared = styles.join(F.broadcast(available)).groupBy("doc", "has_r", "has_i").agg(F.countDistinct("style").alias("s")).filter(F.col("s") == F.col("has_r") + F.col("has_i"))
    a, b = shared.select(F.col("doc").alias("doc_a"), "has_r", "has_i"), shared.select(F.col("doc").alias("doc_b"))
    w = weighted(scored).groupBy("doc_a", "doc_b").agg(*(F.max(F.when(F.col("style") == s, F.col("weight"))).alias(n) for s, n in (("roman", "r"), ("italic", "i"))))
    r = F.when(F.col("has_r") == 1, F.coalesce("r", F.lit(0.0)))
    i = F.when(F.col("has_i") == 1, F.coalesce("i", F.lit(0.0)))
    mean = F.coalesce((r + i) / 2, r, i)
    weight = {"roman": F.coalesce(r, i), "italic": F.coalesce(i, r)}.get(metric, mean)
    rows = w.join(a, "doc_a").join(b, "doc_b").withColumn("weight", weight).withColumn("total", F.coalesce(r, F.lit(0.0)) + F.coalesce(i, F.lit(0.0)))
    return rows.select("doc_a", "doc_b", "weight", F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - F.col("weight"))).alias("distance"), "total")


def connected(pairs: DataFrame, documents: DataFrame, has_letters: DataFrame | None = None) -> DataFrame:
    """(doc, partners, isolated): documents without any pair of positive total weight are isolated.

    A document that has letters at all matches itself; it takes a partner besides to be shown.
    """
    ends = pairs.filter("total > 0").select(F.explode(F.array("doc_a", "doc_b")).alias("doc"))
    count = ends.groupBy("doc").agg(F.count("*").alias("partners"))
    return documents.select("doc").distinct().join(count, "doc", "left").select("doc", F.coalesce("partners", F.lit(0)).alias("partners"), F.col("partners").isNull().alias("isolated"))


def edges(pairs: DataFrame) -> DataFrame:
    """(doc_a, doc_b, weight, alpha): pairs of positive weight, and the weight relative to the largest."""
    some = pairs.filter("weight > 0")
    top = some.agg(F.max("weight").alias("top"))
    return some.join(F.broadcast(top)).select("doc_a", "doc_b", "weight", (F.col("weight") / F.col("top")).alias("alpha"))


def score_documents(distances: DataFrame, n_documents: int | Column, grid: Alphas = Alphas(), epsilon: float = 0.01, reference: DataFrame | None = None, digits: int | None = None) -> DataFrame:
    """Distances to weighted scores."""
    levels = quantiles(distances, grid, digits) if reference is None else cross_quantiles(distances, reference, grid, digits).drop("from_reference")
    tests = F.lit(n_documents) * (F.lit(n_documents) - 1) / 2 if isinstance(n_documents, int) else n_documents * (n_documents - 1) / 2
    return weighted(scores(letters_below(distances, levels), tests, epsilon))
