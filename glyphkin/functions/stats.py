"""Level grid, binomial tails, histogram threshold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..config import Alphas


def alpha_values(grid: Alphas = Alphas()) -> list[float]:
    """The sorted products b * 2**i of the grid that lie strictly between 0 and 1."""
    low, high = grid.exponent_range
    return sorted(x for b in grid.base_factors for i in range(low, high + 1) if 0 < (x := b * 2.0**i) < 1)


def alpha_table(spark: SparkSession, grid: Alphas = Alphas()) -> DataFrame:
    """(a, alpha): the grid as rows, numbered from 0 in ascending order, made by the engine."""
    low, high = grid.exponent_range
    base = spark.range(1).select(F.explode(F.array(*map(F.lit, map(float, grid.base_factors)))).alias("base"))
    rows = base.select("base", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("exponent"))
    rows = rows.select((F.col("base") * F.pow(F.lit(2.0), "exponent")).alias("alpha")).filter((F.col("alpha") > 0) & (F.col("alpha") < 1))
    return rows.select((F.row_number().over(Window.orderBy("alpha")) - 1).alias("a"), "alpha")


def binomial_tail(k: Column, n: Column, alpha: Column) -> Column:
    """P(X >= k) for X binomial with n trials of chance alpha; 1 for k <= 0, 0 for k > n. For any number of trials.

    The logarithm of P(X = k) is a sum over the factors of its binomial coefficient; that of each next term follows
    from the one before, so terms far out in a tail may vanish without taking the others with them.
    """
    k, n = k.cast("double"), n.cast("double")
    odds = F.log(alpha) - F.log1p(-alpha)
    upto = lambda a, b: F.sequence(a.cast("int"), F.greatest(a, b).cast("int"))
    ways = F.aggregate(upto(F.lit(1.0), k), F.lit(0.0), lambda s, j: s + F.log((n - k + j) / j))
    first = ways + k * F.log(alpha) + (n - k) * F.log1p(-alpha)
    start = F.struct(first.alias("log"), F.exp(first).alias("sum"))

    def step(s: Column, i: Column) -> Column:
        # from P(X = i - 1) to P(X = i); past n nothing is added
        log = s["log"] + F.log((n - i + 1) / i) + odds
        return F.when(i > n, s).otherwise(F.struct(log.alias("log"), (s["sum"] + F.exp(log)).alias("sum")))

    tail = F.aggregate(upto(k + 1, n), start, step, lambda s: s["sum"])
    return F.when(k <= 0, F.lit(1.0)).when(k > n, F.lit(0.0)).otherwise(F.least(tail, F.lit(1.0)))


def otsu_thresholds(rows: DataFrame, by: str, value: str, bins: int = 256) -> DataFrame:
    """(by, otsu): the centre of the histogram bin that best parts each group's values in two.

    The histogram has equally wide bins from the least to the largest value; ties go to the lowest bin.
    One shuffle by group, counts pre-aggregated; a group whose values are all equal gets that value.
    """
    span = rows.groupBy(by).agg(F.min(value).cast("double").alias("low"), F.max(value).cast("double").alias("high"))
    width = (F.col("high") - F.col("low")) / bins
    place = F.least(F.floor((F.col(value) - F.col("low")) / F.col("width")).cast("int"), F.lit(bins - 1))
    wide = span.withColumn("width", width)
    held = rows.join(wide.filter("width > 0"), by).groupBy(by, "low", "width", place.alias("bin")).agg(F.count("*").alias("n"))
    held = held.withColumn("centre", F.col("low") + (F.col("bin") + 0.5) * F.col("width"))
    total = Window.partitionBy(by)
    upto = total.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    mass = F.col("n") * F.col("centre")
    cut = held.select(by, "bin", "centre", F.sum("n").over(upto).alias("n1"), F.sum(mass).over(upto).alias("s1"), F.sum("n").over(total).alias("nt"), F.sum(mass).over(total).alias("st"))
    cut = cut.withColumn("n2", F.col("nt") - F.col("n1")).filter("n2 > 0")
    gap = F.col("s1") / F.col("n1") - (F.col("st") - F.col("s1")) / F.col("n2")
    cut = cut.withColumn("between", F.col("n1").cast("double") * F.col("n2") * gap * gap)
    best = cut.groupBy(by).agg(F.min_by("centre", F.struct(-F.round("between", 9), "bin")).alias("otsu"))
    return best.unionByName(wide.filter("width = 0").select(by, F.col("low").alias("otsu")))
