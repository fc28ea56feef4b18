"""Light curves: cuts, error floors, coverage and phase counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import hot


def light_curves(phot: DataFrame, cat: DataFrame, ids: DataFrame | None = None, min_sigma: float = 0.0) -> DataFrame:
    """Points of the objects with their catalogue data, in order of time within each object."""
    if ids is not None:
        phot = phot.join(ids, "object_id", "left_semi")
    out = phot.filter(F.abs("flux") / F.col("fluxerr") >= min_sigma).join(cat, "object_id")
    return out.sortWithinPartitions("object_id", "time")


def phase(time="time", t0="t0", z="z") -> Column:
    return (F.col(time) - F.col(t0)) / (1 + F.col(z))


def error_floor(phot: DataFrame, mean_fraction: float = 0.05, own_fraction: float = 0.0, key: str = "object_id", hot_rows: int = hot.ROWS) -> DataFrame:
    """fluxerr with a share of the object's mean flux and of the point's own flux added in quadrature. The points of hot objects (see
    hot) stay where they lie and get their mean by a broadcast of those few."""
    groups = hot.hot_groups(phot, [key], hot_rows)
    if groups is None:
        withed = phot.withColumn("__mean", F.avg("flux").over(Window.partitionBy(key)))
    else:
        cold, rest = hot.split(phot, groups, [key])
        mean = rest.groupBy(key).agg(F.avg("flux").alias("__mean"))
        columns = [*phot.columns, "__mean"]
        withed = cold.withColumn("__mean", F.avg("flux").over(Window.partitionBy(key))).select(columns).unionByName(rest.join(F.broadcast(mean), key).select(columns))
    floor = F.lit(mean_fraction) * F.col("__mean")
    out = withed.withColumn("fluxerr", F.sqrt(floor * floor + F.col("fluxerr") * F.col("fluxerr"))).drop("__mean")
    return out.withColumn("fluxerr", F.sqrt((F.lit(own_fraction) * F.col("flux")) * (F.lit(own_fraction) * F.col("flux")) + F.col("fluxerr") * F.col("fluxerr")))


def with_pulls(points: DataFrame, window=(-20.0, 100.0), pull_cut: float = 10.0) -> DataFrame:
    """pull, and whether a point passes the phase window (strict, also within the template's phases) and the pull cut.
    points has phase, flux, fluxerr, model_flux, min_phase and max_phase."""
    ok = (F.col("phase") > window[0]) & (F.col("phase") < window[1]) & (F.col("phase") > F.col("min_phase")) & (F.col("phase") < F.col("max_phase"))
    pull = (F.col("flux") - F.col("model_flux")) / F.col("fluxerr")
    return points.withColumns({"pull": pull, "in_phase": ok, "in_pull": F.abs(pull) < pull_cut})


def cut_counts(points: DataFrame, *keys: str) -> DataFrame:
    return points.groupBy(*keys).agg(F.count("*").alias("dps_init"), F.count_if("in_phase").alias("dps_tcut"), F.count_if("in_pull").alias("dps_fcut"), F.count_if(F.col("in_phase") & F.col("in_pull")).alias("dps_allcut"))


def band_counts(points: DataFrame, *keys: str) -> DataFrame:
    """lceval: points by band; bands_over: bands with more than 5."""
    per = points.groupBy(*keys, "band").agg(F.count("*").alias("n"))
    return per.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("band", "n")))).alias("lceval"), F.count("*").alias("nbr_bands"), F.sum("n").alias("ndet"), F.count_if(F.col("n") > 5).alias("bands_over"))


def coverage(points: DataFrame, *keys: str) -> DataFrame:
    """Points before, in and after the time that the model covers (t_start to t_end), and counts around its peak (t_peak):
    early up to 3 days before, then 3 days around, post up to 15 days after, late 15 to 30 days after (15 counts twice)."""
    t = F.col("time")
    inside = t.between(F.col("t_start"), F.col("t_end"))
    d = t - F.col("t_peak")
    wide = 10 * (1 + F.col("z"))
    near = d.between(-wide, wide)
    return points.groupBy(*keys).agg(
        F.count_if(t < F.col("t_start")).alias("premod"), F.count_if(t > F.col("t_end")).alias("postmod"), F.min(t - F.col("t_start")).alias("predt"), F.max(t - F.col("t_end")).alias("postdt"),
        F.count_if(inside).alias("peakdet"), F.count_distinct(F.when(inside, F.col("band"))).alias("peakbands"), (F.max(F.when(inside, t)) - F.min(F.when(inside, t))).alias("peakduration"),
        F.count_if(inside & (d <= -3)).alias("earlydet"), F.count_if(inside & (d > -3) & (d <= 3)).alias("thendet"), F.count_if(inside & (d > 3) & (d <= 15)).alias("postdet"), F.count_if(inside & (d >= 15) & (d <= 30)).alias("latedet"),
        F.count_if(near).alias("verypeakcount"), F.count_distinct(F.when(near, F.col("band"))).alias("verypeakbands"),
    )


def peak_chi2(points: DataFrame, *keys: str, dispersion: float = 0.1, of_mean: bool = False) -> DataFrame:
    """peakchi: chi2 of the points inside with an intrinsic dispersion, of each flux or of the mean flux."""
    inside = points.filter(F.col("time").between(F.col("t_start"), F.col("t_end")))
    level = F.avg("flux").over(Window.partitionBy(*keys)) if of_mean else F.col("flux")
    serr2 = (level * dispersion) * (level * dispersion) + F.col("fluxerr") * F.col("fluxerr")
    d = F.col("flux") - F.col("model_flux")
    return inside.withColumn("__c", d * d / serr2).groupBy(*keys).agg(F.sum("__c").alias("peakchi"))


def peak_point(points: DataFrame, *keys: str) -> DataFrame:
    """The point of highest flux of each group."""
    w = Window.partitionBy(*keys).orderBy(F.desc("flux"), "time", "point_id")
    return points.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


#: Why an object can't be fitted, in this order: rejected, no points, one band, no colour, too few points around the peak.
def fail_code() -> Column:
    return (
        F.when(F.col("rejected"), 1).when(F.coalesce("ndet", F.lit(0)) == 0, 2).when(F.col("nbr_bands") < 2, 3).when(F.col("g_r").isNull(), 4)
        .when((F.col("presum") < 2) | (F.col("postsum") < 2), 5).otherwise(0)
    )


def outcome(code: str = "code", accepted: str = "accepted", peak_good: str = "peak_good") -> Column:
    """What became of an object: its fail_code; of those that were fitted 6 (no fit accepted), 9 (none with a well-sampled peak) or
    99. accepted and peak_good say whether any of its fits is accepted, and any accepted one has a well-sampled peak."""
    return F.when(F.col(code) > 0, F.col(code)).when(~F.coalesce(accepted, F.lit(False)), 6).when(~F.coalesce(peak_good, F.lit(False)), 9).otherwise(99)
