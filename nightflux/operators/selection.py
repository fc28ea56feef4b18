"""Selection and ranking of (object, template) fits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .taxonomy import SEED_RANGE, in_range, true_class


def good_fits(fits: DataFrame, max_chidof: float = 3.0, target: str = "SN II (w)", peak_fit: bool = True, aic_from_peak: bool = False) -> DataFrame:
    """Metrics of successful fits: aic, peakndof, peakchisqdof, peakaic, chidof, goodfit, correct.

    With peak_fit, chi2 per degree of freedom is that of the points around the peak, and pairs without a degree of
    freedom there are dropped.
    """
    k = F.col("ndet") - F.col("ndof")
    out = fits.filter("success").withColumns({"aic": 2 * k + F.col("chisq"), "peakndof": F.col("peakdet") - k})
    if peak_fit:
        out = out.filter("peakndof > 0").withColumns({"peakchisqdof": F.col("peakchi") / F.col("peakndof"), "peakaic": 2 * k + F.col("peakchi")})
        out = out.withColumn("chidof", F.col("peakchisqdof"))
        if aic_from_peak:
            out = out.withColumn("aic", F.col("peakaic"))
    return out.withColumns({"goodfit": F.col("chidof") < max_chidof, "correct": true_class("class", target)})


def pair_totals(good: DataFrame) -> DataFrame:
    return good.agg(F.count("*").alias("pairs"), F.count_if("correct").alias("correct"), F.count_if("goodfit").alias("good"), F.count_if(F.col("correct") & F.col("goodfit")).alias("both"))


def best_per(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """The first row of each group in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def seeds(summary: DataFrame, z_range=SEED_RANGE, min_bands: int = 2, min_peakndof: int = 6, require_peak_good: bool = False, ranges: dict | None = None, column: str = "class") -> DataFrame:
    """Rows with enough bands and points whose redshift lies strictly within z_range, or within that of their class in column where
    ranges has one."""
    ok = (F.col("nbr_bands") >= min_bands) & (F.col("peakndof") >= min_peakndof)
    return in_range(summary.filter(ok & F.col("peak_good") if require_peak_good else ok), column, "z", z_range, ranges or {}, strict=True)


def prioritised(good: DataFrame) -> DataFrame:
    """priority: 2 for a good fit of a true class, 1 for a true class, else 0."""
    return good.withColumn("priority", F.when(F.col("correct") & F.col("goodfit"), 2).when(F.col("correct"), 1).otherwise(0))


def by_priority() -> tuple:
    return F.desc("priority"), F.asc("chidof"), F.asc("model")


def until_enough(df: DataFrame, key: str, good: Column, wanted: int, order: tuple | None = None) -> DataFrame:
    """Rows of each group in order until wanted rows are good; the row that reaches it is the last."""
    w = Window.partitionBy(key).orderBy(*(order or by_priority())).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(good.cast("int")).over(w), F.lit(0))
    return df.withColumn("__before", before).filter(F.col("__before") < wanted).drop("__before")


def likely_or_best(df: DataFrame, key: str, score: str, cut: float = 0.01, at_least: int = 3, tie: str = "model") -> DataFrame:
    """Rows above the cut where a group has enough of them, else its best; good_fit tells which."""
    g = Window.partitionBy(key)
    many = F.count_if(F.col(score) > cut).over(g) >= at_least
    nth = F.row_number().over(g.orderBy(F.desc(score), tie))
    return df.withColumns({"good_fit": many, "__n": nth}).filter(F.when(F.col("good_fit"), F.col(score) > cut).otherwise(F.col("__n") <= at_least)).drop("__n")


def draw_probability(df: DataFrame, key: str, p: str, floor: float = 0.01) -> DataFrame:
    """draw_prob: at least floor for each row, the rest by the excess over it; even where there is no excess. An error
    where the floor alone exceeds 1."""
    g = Window.partitionBy(key)
    n, excess = F.count("*").over(g), F.greatest(F.col(p) - floor, F.lit(0.0))
    total = F.sum(excess).over(g)
    rest = F.lit(1.0) - F.lit(floor) * n
    share = F.when(total > 0, excess / total).otherwise(F.lit(1.0) / n)
    return df.withColumn("draw_prob", F.when(F.lit(floor) * n > 1, F.raise_error(F.lit("floor too large for the group")).cast("double")).otherwise(F.lit(floor) + rest * share))


def akaike(df: DataFrame, key: str, cut: float = 0.001, top: int | None = None) -> DataFrame:
    """One row for each group: its similarly good fits by Akaike weight, or its first top rows by aic."""
    g = Window.partitionBy(key)
    w = F.exp(-(F.col("aic") - F.min("aic").over(g)) / 2)
    ranked = df.withColumns({"w": w, "nth": F.row_number().over(g.orderBy("aic", "model"))}).withColumn("weight", F.col("w") / F.sum("w").over(g))
    match = F.col("weight") > cut if top is None else F.col("nth") <= top
    return ranked.groupBy(key).agg(
        F.max(F.when(F.col("nth") == 1, F.col("model"))).alias("model"),
        F.count_if(match).alias("matches"),
        F.concat_ws("_", F.array_sort(F.collect_set(F.when(match, F.col("class"))))).alias("types"),
        F.bool_and(F.when(match, F.col("correct"))).alias("allgood"),
    )


def volume_counts(fits: DataFrame, z_lo: float = 0.0, z_hi: float = 0.07) -> DataFrame:
    good = F.col("success") & F.col("peak_good")
    return fits.agg(F.count_distinct("id").alias("n_fit"), F.count_distinct(F.when(good, F.col("id"))).alias("n_good"), F.count_distinct(F.when(good & F.col("z").between(z_lo, z_hi), F.col("id"))).alias("n_volume"))


def describe(df: DataFrame, key: str, column: str) -> DataFrame:
    q = F.percentile(column, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = df.groupBy(key).agg(F.count(column).alias("n"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("sd"), F.min(column).alias("lo"), q.alias("q"), F.max(column).alias("hi"))
    return out.select(key, "n", "mean", "sd", "lo", F.col("q")[0].alias("q25"), F.col("q")[1].alias("q50"), F.col("q")[2].alias("q75"), "hi")


def acceptable(df: DataFrame) -> DataFrame:
    """Fits whose peak lies in the data and whose data don't begin long before the template or after the peak."""
    return df.filter("t0 between t_min and t_max and t_min - t0 >= minphase - 3 and t_min - t0 <= 5")


def covered(df: DataFrame) -> DataFrame:
    """Pairs whose data the model covers and whose peak it reaches."""
    return df.filter("premod <= 1 and postmod <= 1 and predt >= -3 and postdt <= 3 and peak_residual between 0.5 and 1.5")


def peak_good() -> Column:
    return ~F.expr("t0diff > 15 or presum < 3 or postsum < 3 or earlydet < 2 or postdet < 2 or latedet < 2")


def without(df: DataFrame, listed: DataFrame, *columns: str) -> DataFrame:
    """Rows whose value in none of the columns is listed (listed has one column)."""
    name = listed.columns[0]
    for c in columns:
        df = df.join(listed, df[c] == listed[name], "left_anti")
    return df


QUALITY = {"gold": 2, "silver": 1, "bronze": 0}


def min_quality(df: DataFrame, least: str, column: str = "quality") -> DataFrame:
    """Rows at least that good; unknown and null qualities go. ValueError for an unknown least."""
    if least.lower() not in QUALITY:
        raise ValueError(f"quality must be one of {sorted(QUALITY)}")
    rank = F.element_at(F.create_map(*(F.lit(x) for kv in QUALITY.items() for x in kv)), F.lower(column))
    return df.filter(F.coalesce(rank, F.lit(-1)) >= QUALITY[least.lower()])


def quality(sf: str = "sf", priority: str = "priority", good: float = 0.5) -> Column:
    return F.when((F.col(sf) > good) & (F.col(priority) == 2), "gold").when((F.col(sf) > good) & (F.col(priority) == 1), "silver").otherwise("bronze")


def quality_scores(warps: DataFrame, key: str = "id") -> DataFrame:
    """key, score: gold counts 3, silver 2, bronze 1; other qualities count nothing."""
    rank = F.element_at(F.create_map(*(F.lit(x) for kv in QUALITY.items() for x in kv)), F.col("quality"))
    return warps.groupBy(key).agg(F.sum(F.coalesce(rank + 1, F.lit(0))).alias("score"))


def quality_sizes(warps: DataFrame) -> DataFrame:
    """Templates and objects at each least quality, and the score of the set (gold 3, silver 2, bronze 1)."""
    rank = F.element_at(F.create_map(*(F.lit(x) for kv in QUALITY.items() for x in kv)), F.col("quality"))
    return warps.agg(*(f for q, r in QUALITY.items() for f in (F.count_if(rank >= r).alias(f"{q}_models"), F.count_distinct(F.when(rank >= r, F.col("id"))).alias(f"{q}_objects"))), F.sum(rank + 1).alias("score"))
