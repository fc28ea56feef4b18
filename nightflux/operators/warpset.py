"""Warp sets: which refitted pairs are kept, with which quality and probability, and samples drawn from them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nightflux.functions.astro import uniform

from . import photometry as P
from . import selection as S
from . import synphot as Syn


def warp_set(refits: DataFrame, key: str = "id", wanted: int = 5, good: float = 0.5, least: float = 0.01, prefilter: bool = True) -> DataFrame:
    """Pairs of each object in order of priority and chi2, until wanted good ones; those under least go; quality and
    draw_prob. refits has model, correct, goodfit, chidof and sf. prefilter keeps good first fits only, so that silver
    can't occur; without it, true classes with a poor first fit can be silver."""
    df = refits.filter("goodfit") if prefilter else refits
    df = S.prioritised(df.filter(~F.col("model").contains("salt"))).filter(F.col("sf") >= least)
    df = S.until_enough(df, key, F.col("sf") > good, wanted).withColumn("quality", S.quality(good=good))
    return S.draw_probability(df, key, "sf", least)


def warp_set_simple(refits: DataFrame, key: str = "id") -> DataFrame:
    """The older rule: true classes with two bands and six points around the peak; those likely enough, or the best three."""
    df = refits.filter(F.col("correct") & (F.col("nbr_bands") >= 2) & (F.col("peakdet") >= 6) & ~F.col("model").contains("salt"))
    return S.draw_probability(S.likely_or_best(df, key, "sf"), key, "sf")


def serve(warps: DataFrame, bases: int | str = 1, templates: int | str = 1, seed: int = 0, least: str | None = None, exclude: list[str] | None = None, key: str = "id") -> DataFrame:
    """Sample of a warp set: draw (number of the drawn base), base, nth (number in the draw) and the row drawn.

    bases: 'all' or how many objects to draw, with replacement and all alike; templates: 'all', n > 0 draws by draw_prob,
    n < 0 draws evenly. Excluded names go both as objects and as templates. The draws depend on seed and keys alone, not
    on partitions. Objects are numbered within hash blocks and offset by the block totals, so no task sorts them all.
    """
    for name, v in (("bases", bases), ("templates", templates)):
        if not (v == "all" or isinstance(v, int) and not isinstance(v, bool) and (v > 0 or name == "templates" and v < 0)):
            raise ValueError(f"{name} must be 'all' or a number")
    df = S.min_quality(warps, least) if least else warps
    if exclude:
        df = df.filter(~F.col(key).cast("string").isin(exclude) & ~F.col("model").isin(exclude))
    if bases == "all":
        drawn = df.select(F.col(key)).distinct().withColumn("draw", F.lit(0))
    else:
        drawn = drawn_evenly(df.select(key).distinct(), key, bases, seed)
    pool = drawn.join(df, key)
    if templates == "all":
        return pool.withColumn("nth", F.row_number().over(Window.partitionBy("draw", key).orderBy("model")) - 1)
    w = Window.partitionBy("draw", key).orderBy("model")
    p = F.col("draw_prob") / F.sum("draw_prob").over(Window.partitionBy("draw", key)) if templates > 0 else F.lit(1.0) / F.count("*").over(Window.partitionBy("draw", key))
    pool = pool.withColumn("__p", p).withColumn("__hi", F.sum("__p").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    last = F.lead("model").over(w).isNull()
    pool = pool.withColumns({"__lo": F.col("__hi") - F.col("__p"), "__last": last}).withColumn("nth", F.explode(F.sequence(F.lit(0), F.lit(abs(templates) - 1))))
    u = uniform(seed + 1, "draw", key, "nth")
    return pool.withColumn("__u", u).filter((F.col("__u") >= F.col("__lo")) & ((F.col("__u") < F.col("__hi")) | F.col("__last"))).drop("__p", "__hi", "__lo", "__u", "__last")


BLOCKS = 256


def drawn_evenly(objects: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n draws with replacement: each draw's uniform picks the object of that rank, in order of (hash block, key)."""
    block = objects.withColumn("block", F.pmod(F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("long"), F.lit(BLOCKS)))
    numbered = block.withColumn("r", F.row_number().over(Window.partitionBy("block").orderBy(key)) - 1)
    sizes = block.groupBy("block").agg(F.count("*").alias("c"))
    before = sizes.select("block", (F.sum("c").over(Window.orderBy("block")) - F.col("c")).alias("before"), F.sum("c").over(Window.partitionBy()).alias("total"))  # at most BLOCKS rows
    ranked = numbered.join(F.broadcast(before), "block").select(key, (F.col("before") + F.col("r")).alias("rank"), "total")
    draws = objects.sparkSession.range(n).select(F.col("id").cast("int").alias("draw")).withColumn("u", uniform(seed, "draw"))
    total = before.select("total").limit(1)
    picks = draws.join(F.broadcast(total)).select("draw", F.floor(F.col("u") * F.col("total")).alias("rank"))
    return ranked.drop("total").join(picks, "rank").select(key, "draw")


def ranked_models(fits: DataFrame, max_chidof: float = 100, min_peakdof: int = 3, which: str = "full", per: str = "object_id", chidof=("chidof", "peakchidof"), peakdof: str = "peakdof", ties=("model",)) -> DataFrame:
    """The best warped model of each object (or of each base or template) by chi2 per degree of freedom, over all points
    or those around the peak."""
    rank = F.col(chidof[0] if which == "full" else chidof[1])
    return S.best_per(fits.withColumn("rankchi", rank).filter((F.col("rankchi") < max_chidof) & (F.col(peakdof) >= min_peakdof)), [per], "rankchi", *ties)


def evaluated(points: DataFrame, fits: DataFrame, nodes: DataFrame, keys: list[str], phase_range: float = 60.0) -> DataFrame:
    """fits (object_id, keys, z, t0, ebv, amplitude, chisq, ndof) with chidof, and peakndof and peakchidof of the points between the
    model's first phase and phase_range days later. nodes: of the models as arrays, a small table (see synphot.at_phase_of_few)."""
    own = ["object_id", *keys]
    p = points.join(fits.select(*own, "t0", "ebv", "amplitude"), "object_id").withColumn("phase", P.phase())
    p = Syn.at_phase_of_few(p, nodes, *keys, "z", "ebv", "band").withColumn("model_flux", F.col("amplitude") * F.col("model_flux"))
    start = F.col("t0") + Syn.PHASE_0 * (1 + F.col("z"))
    p = p.withColumns({"t_start": start, "t_end": start + phase_range})
    inside = p.filter("time between t_start and t_end").groupBy(*own).agg((F.count("*") - 3).alias("peakndof"))
    out = fits.withColumn("chidof", F.col("chisq") / F.col("ndof")).join(inside, own, "left").join(P.peak_chi2(p, *own), own, "left")
    return out.withColumn("peakndof", F.coalesce("peakndof", F.lit(-3).cast("long"))).withColumn("peakchidof", F.when(F.col("peakndof") > 0, F.col("peakchi") / F.col("peakndof")))


def reach(factors: DataFrame, waves: list[float], *keys: str) -> DataFrame:
    """keys, lo, hi: bounds of the ratio of a warped spectrum to its template's, from the factors at the nodes alone: a cubic
    leaves 1 by at most the nodes' distances from 1, each times the most that it weighs at any wavelength."""
    each = np.abs(Syn.wave_weights(waves))
    far = F.array(*(F.abs(F.col("f")[j] - 1) for j in range(len(waves))))
    rows = factors.withColumn("d", far).groupBy(*keys).agg(*(F.max(F.col("d")[j]).alias(f"d{j}") for j in range(len(waves))))
    most = F.greatest(*(sum((F.col(f"d{j}") * float(row[j]) for j in range(len(waves))), F.lit(0.0)) for row in each))
    return rows.select(*keys, F.greatest(1 - most * (1 + 1e-12), F.lit(0.0)).alias("lo"), (1 + most * (1 + 1e-12)).alias("hi"))


def usage(best: DataFrame, column: str) -> DataFrame:
    return best.groupBy(column).agg(F.count("*").alias("n"))


def leave_one_out(objects: DataFrame, warps: DataFrame, on: str = "class", blocks: int = 16) -> DataFrame:
    """Objects with the warp models of their class that were not made from themselves. A class is dealt in blocks of its bases, so
    that one with most of the rows is many tasks' work; each object meets each block once."""
    w = warps.withColumnRenamed("id", "base_id").withColumn("__block", F.pmod(F.xxhash64("base_id"), F.lit(blocks)).cast("int"))
    o = objects.withColumn("__block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return o.join(w, [on, "__block"]).filter(F.col("base_id") != F.col("object_id")).drop("__block")


def leave_one_out_counts(objects: DataFrame, warps: DataFrame, on: str = "class") -> DataFrame:
    """object_id, n, first_base: how many pairs leave_one_out gives an object, and the least base_id among them; objects
    without a pair are left out. From counts by class and by base, so that no pair is made."""
    own = warps.groupBy(on, F.col("id").alias("base_id")).agg(F.count("*").alias("own"))
    total = own.groupBy(on).agg(F.sum("own").alias("total"), F.min("base_id").alias("least"))
    second = own.join(F.broadcast(total.select(on, "least")), on).filter("base_id > least").groupBy(on).agg(F.min("base_id").alias("second"))
    by_class = total.join(second, on, "left")  # a row for each class
    mine = objects.join(F.broadcast(by_class), on).join(own.withColumnRenamed("base_id", "object_id"), ["object_id", on], "left")
    n = F.col("total") - F.coalesce("own", F.lit(0))
    out = mine.select("object_id", n.alias("n"), F.when(F.col("least") == F.col("object_id"), F.col("second")).otherwise(F.col("least")).alias("first_base"))
    return out.filter("n > 0")
