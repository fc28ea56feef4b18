"""Peaks and peak colours of light curves, all objects and bands at once."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nightflux.functions.astro import matern32

from . import hot

KEYS = ("object_id", "band")
PEAK = ("peak_flux", "peak_flux_err", "peak_time")


def sigma_clip(phot: DataFrame, n_sigma: float = 3.0, n_iter: int = 3, keys=KEYS, hot_rows: int = hot.ROWS) -> DataFrame:
    """phot with kept. Each round keeps points nearer to the median of the kept ones than n_sigma robust deviations
    (1.4826 times the median absolute deviation) or their own error, whichever is larger; groups of fewer than 3 kept
    points stay as they are. All rounds share one shuffle; hot groups (see hot) stay where they lie."""
    groups = hot.hot_groups(phot, keys, hot_rows)
    if groups is None:
        return _clipped(phot, n_sigma, n_iter, keys)
    cold, rest = hot.split(phot, groups, keys)
    return _clipped(cold, n_sigma, n_iter, keys).unionByName(_clipped_in_place(rest, n_sigma, n_iter, keys))


def _clipped(phot: DataFrame, n_sigma: float, n_iter: int, keys) -> DataFrame:
    g = Window.partitionBy(*keys)
    df = phot.withColumn("kept", F.lit(True))
    for _ in range(n_iter):
        mine = F.when(F.col("kept"), F.col("flux"))
        df = df.withColumns({"__m": F.percentile(mine, F.lit(0.5)).over(g), "__n": F.count_if("kept").over(g)})
        df = df.withColumn("__d", F.abs(F.col("flux") - F.col("__m")))
        df = df.withColumn("__s", F.percentile(F.when(F.col("kept"), F.col("__d")), F.lit(0.5)).over(g) * 1.4826)
        near = F.col("__d") < F.greatest(F.col("__s") * n_sigma, F.col("fluxerr"))
        df = df.withColumn("kept", F.when(F.col("__n") < 3, F.col("kept")).otherwise(F.col("kept") & near)).drop("__m", "__n", "__d", "__s")
    return df


def _clipped_in_place(phot: DataFrame, n_sigma: float, n_iter: int, keys) -> DataFrame:
    """The same for a few groups of any size: medians by counts, joined to the points where they are."""
    df = phot.withColumn("kept", F.lit(True))
    for _ in range(n_iter):
        m = hot.medians(df.filter("kept"), keys, "flux").withColumnRenamed("median", "__m")
        df = df.join(F.broadcast(m), list(keys), "left").withColumn("__d", F.abs(F.col("flux") - F.col("__m")))
        own = df.filter("kept").groupBy(*keys).agg(F.count("*").alias("__n"))
        s = hot.medians(df.filter("kept"), keys, "__d").withColumnRenamed("median", "__s").join(own, list(keys))
        df = df.join(F.broadcast(s), list(keys), "left")
        near = F.col("__d") < F.greatest(F.col("__s") * 1.4826 * n_sigma, F.col("fluxerr"))
        df = df.withColumn("kept", F.when(F.col("__n") < 3, F.col("kept")).otherwise(F.col("kept") & near)).drop("__m", "__n", "__d", "__s").select(*phot.columns, "kept")
    return df


def series(points: DataFrame, keys=KEYS) -> DataFrame:
    """One row for each group of spans: its kept points in order and the smoothing length, for solves that need a group
    whole: a group is the points of one object in one band."""
    own = F.when(F.col("kept"), F.struct("time", "flux", "fluxerr"))
    return points.groupBy(*keys).agg(F.array_sort(F.collect_list(own)).alias("points"), F.max("length").alias("length"), F.max("n_count").alias("n_count"))


def spans(clipped: DataFrame, length_scale: float | None = None, keys=KEYS, groups: DataFrame | None = None) -> DataFrame:
    """clipped with the first and last kept time, the smoothing length and the counts of its group. groups: the hot ones (see hot),
    whose numbers are joined to the points where they are."""
    if length_scale is not None and length_scale <= 0:
        raise ValueError("length_scale must be positive")
    kept = F.when(F.col("kept"), F.col("time"))
    base = lambda lo, hi: F.lit(float(length_scale)) if length_scale is not None else (hi - lo) / 5
    numbers = {"first": F.min(kept), "last": F.max(kept), "n_clipped": F.count_if(~F.col("kept")), "n_count": F.count_if("kept")}
    order = [*clipped.columns, "first", "last", "length", "n_clipped", "n_count"]
    if groups is not None:
        cold, rest = hot.split(clipped, groups, keys)
        by = rest.groupBy(*keys).agg(*(v.alias(n) for n, v in numbers.items()), base(F.min("time"), F.max("time")).alias("length"))
        return spans(cold, length_scale, keys).select(order).unionByName(rest.join(F.broadcast(by), list(keys)).select(order))
    g = Window.partitionBy(*keys)
    return clipped.withColumns({**{n: v.over(g) for n, v in numbers.items()}, "length": base(F.min("time").over(g), F.max("time").over(g))}).select(order)


def smoothed(points: DataFrame, n_grid: int = 500, keys=KEYS) -> DataFrame:
    """Keys, i, t, smooth: the time-weighted mean of the kept points of spans with Gaussian weights, on a grid between the
    first and last of them; null where the weights vanish. Each point adds to each grid point, and what it adds is summed
    before it is shuffled (with the points dealt by group already, nothing is)."""
    each = points.filter("kept and n_count >= 2").select(*keys, "time", "flux", "first", "last", "length", F.explode(F.sequence(F.lit(0), F.lit(n_grid - 1))).alias("i"))
    d = (F.col("t") - F.col("time")) / F.col("length")
    each = each.withColumn("t", F.col("first") + (F.col("last") - F.col("first")) * F.col("i") / (n_grid - 1)).withColumn("w", F.exp(F.lit(-0.5) * d * d))
    sums = each.groupBy(*keys, "i").agg(F.min("t").alias("t"), F.sum("w").alias("w"), F.sum(F.col("w") * F.col("flux")).alias("f"))
    return sums.select(*keys, "i", "t", F.when(F.col("w") > 1e-12, F.col("f") / F.col("w")).alias("smooth"))


def side_counts(points: DataFrame, peaks: DataFrame, kernel: str = "gauss", keys=KEYS) -> DataFrame:
    """peaks with n_before_peak, n_after_peak, and effective counts: kept points weighted by the kernel at their distance
    from the peak."""
    d = F.col("time") - F.col("peak_time")
    k = matern32(d, F.col("length")) if kernel == "matern" else F.exp(F.lit(-0.5) * (d / F.col("length")) * (d / F.col("length")))
    both = points.filter("kept").select(*keys, "time", "length").join(peaks.select(*keys, "peak_time"), list(keys))
    add = lambda side: F.coalesce(F.sum(F.when(side, k)), F.lit(0.0))
    counts = both.groupBy(*keys).agg(F.count_if(d < 0).cast("int").alias("n_before_peak"), F.count_if(d > 0).cast("int").alias("n_after_peak"), add(d < 0).alias("n_eff_before_peak"), add(d > 0).alias("n_eff_after_peak"))
    return peaks.join(counts, list(keys))


def peak_flux(phot: DataFrame, method: str = "twa", n_sigma: float = 3.0, n_clip_iter: int = 3, length_scale: float | None = None, n_grid: int = 500, gp_amplitude: float | None = None, keys=KEYS, hot_rows: int = hot.ROWS) -> DataFrame:
    """Peak of each group: the largest smoothed value (twa), the median of the top twentieth of the grid (top5), or the
    largest mean of a Gaussian process (gp). Groups with fewer than 2 kept points have null peaks. Points of hot groups are clipped
    and smoothed where they lie, each task adding up what its own give to the grid; the process takes a group whole."""
    if method not in ("gp", "twa", "top5"):
        raise ValueError(f"unknown method {method}")
    groups = hot.hot_groups(phot, keys, hot_rows)
    if groups is None:
        clipped = _clipped(phot, n_sigma, n_clip_iter, keys)
    else:
        cold, rest = hot.split(phot, groups, keys)
        clipped = _clipped(cold, n_sigma, n_clip_iter, keys).unionByName(_clipped_in_place(rest, n_sigma, n_clip_iter, keys))
    points = spans(clipped, length_scale, keys, groups)
    if method == "gp":
        found = gp_peaks(series(points, keys), n_grid, gp_amplitude, keys)
    else:
        curve = smoothed(points, n_grid, keys).filter("smooth is not null")
        # rounded, so that equal values tie and the first grid point wins on any engine
        top = F.min(F.struct((-F.round("smooth", 9)).alias("o"), F.col("i"), F.col("t"), F.col("smooth"))).alias("top")
        cut = [F.percentile("smooth", F.lit(0.95)).alias("cut"), F.collect_list("smooth").alias("values")] if method == "top5" else []  # n_grid values at most
        found, value = curve.groupBy(*keys).agg(top, *cut), F.col("top.smooth")
        if method == "top5":
            found = found.select(*keys, "top", F.array_sort(F.filter("values", lambda v: v >= F.col("cut"))).alias("high"))
            n = F.size("high")
            value = (F.element_at("high", F.floor((n + 1) / 2).cast("int")) + F.element_at("high", F.floor((n + 2) / 2).cast("int"))) / 2
        found = found.select(*keys, value.alias("peak_flux"), F.lit(0.0).alias("peak_flux_err"), F.col("top.t").alias("peak_time"))
    full = side_counts(points, found, "matern" if method == "gp" else "gauss", keys)
    groups = points.groupBy(*keys).agg(F.max("n_clipped").alias("n_clipped"), F.max("n_count").alias("n_count"))
    return groups.join(full, list(keys), "left")


def gp_posterior(t, f, e, at, length: float, amplitude: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of an exact zero-mean Gaussian process with a Matern-3/2 kernel."""
    amp = amplitude if amplitude is not None else (np.std(f) or 1.0)

    def kernel(a, b):
        s = np.sqrt(3.0) * np.abs(a[:, None] - b[None, :]) / length
        return amp**2 * (1 + s) * np.exp(-s)

    k = kernel(t, t) + np.diag(e**2 + 1e-9)
    try:
        low = np.linalg.cholesky(k)
    except np.linalg.LinAlgError:
        low = np.linalg.cholesky(k + 1e-6 * np.eye(len(t)))
    cross = kernel(t, at)
    v = np.linalg.solve(low, cross)
    mean = cross.T @ np.linalg.solve(low.T, np.linalg.solve(low, f))
    return mean, np.sqrt(np.maximum(amp**2 - (v * v).sum(axis=0), 0))


def gp_filtered(t, f, e, at, length: float, amplitude: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """What gp_posterior gives, in time and memory that grow with the number of points and not with its square: the kernel is that
    of a process of two states (value and slope), so a Kalman filter runs through points and places in order of time, and a backward
    pass (of adjoint variables, so nothing is inverted) smooths. t and at ascend."""
    amp = float(amplitude if amplitude is not None else (np.std(f) or 1.0))
    rate = math.sqrt(3.0) / length
    times = np.concatenate([t, at])
    order = np.argsort(times, kind="stable")
    steps = np.diff(times[order], prepend=times[order[0]])
    seen = order < len(t)
    value, noise = (np.where(seen, np.concatenate([x, np.zeros(len(at))])[order], 0.0).tolist() for x in (f, e**2 + 1e-9))
    still = [amp**2, 0.0, rate * rate * amp**2]  # variances far from any point
    m0, m1, (p00, p01, p11) = 0.0, 0.0, still
    past = []
    for d, s, y, r in zip(steps.tolist(), seen.tolist(), value, noise):
        g = math.exp(-rate * d)
        a00, a01, a10, a11 = g * (1 + rate * d), g * d, -g * rate * rate * d, g * (1 - rate * d)
        m0, m1 = a00 * m0 + a01 * m1, a10 * m0 + a11 * m1
        x00, x01, x11 = p00 - still[0], p01, p11 - still[2]  # the step adds what its own part of the stationary variance lacks
        b00, b01, b10, b11 = a00 * x00 + a01 * x01, a00 * x01 + a01 * x11, a10 * x00 + a11 * x01, a10 * x01 + a11 * x11
        p00, p01, p11 = still[0] + b00 * a00 + b01 * a01, b00 * a10 + b01 * a11, still[2] + b10 * a10 + b11 * a11
        off, var = y - m0, p00 + r
        past.append((a00, a01, a10, a11, m0, p00, p01, off, var))
        if s:
            k0, k1 = p00 / var, p01 / var
            m0, m1 = m0 + k0 * off, m1 + k1 * off
            p00, p01, p11 = p00 * r / var, p01 * r / var, p11 - k1 * p01
    mean, sd = np.zeros(len(order)), np.zeros(len(order))
    l0 = l1 = w00 = w01 = w11 = 0.0
    for i in range(len(order) - 1, -1, -1):
        a00, a01, a10, a11, m, q00, q01, off, var = past[i]
        if order[i] < len(t):
            k0, k1, c = q00 / var, q01 / var, 1 - q00 / var
            # C = [[c, 0], [-k1, 1]]: adjoints before the point's own gain
            l0, l1 = c * l0 - k1 * l1 - off / var, l1
            w00, w01, w11 = c * c * w00 - 2 * c * k1 * w01 + k1 * k1 * w11 + 1 / var, c * w01 - k1 * w11, w11
        mean[i] = m - q00 * l0 - q01 * l1
        sd[i] = q00 - (q00 * (q00 * w00 + q01 * w01) + q01 * (q00 * w01 + q01 * w11))
        l0, l1 = a00 * l0 + a10 * l1, a01 * l0 + a11 * l1
        v00, v01, v10, v11 = w00 * a00 + w01 * a10, w00 * a01 + w01 * a11, w01 * a00 + w11 * a10, w01 * a01 + w11 * a11
        w00, w01, w11 = a00 * v00 + a10 * v10, a00 * v01 + a10 * v11, a01 * v01 + a11 * v11
    back = np.empty(len(order), int)
    back[order] = np.arange(len(order))
    place = back[len(t) :]
    return mean[place], np.sqrt(np.maximum(sd[place], 0))


#: Points of a group up to which the dense solve is the quicker one; it takes so many squared numbers.
DENSE = 256


def gp_peaks(groups: DataFrame, n_grid: int, amplitude: float | None, keys=KEYS) -> DataFrame:
    """The process of each group in Arrow batches; a group is the points of one object in one band. Small groups are solved
    densely, larger ones by the filter, in time and memory that grow with their points."""

    def work(frames):
        for pdf in frames:
            out = []
            for ps, length in zip(pdf["points"], pdf["length"]):
                t, f, e = (np.array([p[c] for p in ps]) for c in ("time", "flux", "fluxerr"))
                at = np.linspace(t[0], t[-1], n_grid)
                mean, sd = (gp_posterior if len(t) <= DENSE else gp_filtered)(t, f, e, at, length or 1.0, amplitude)
                i = int(np.argmax(mean))
                out.append((mean[i], sd[i], at[i]))
            yield pdf[list(keys)].assign(**dict(zip(PEAK, np.array(out).reshape(-1, 3).T)))

    own = groups.filter("n_count >= 2").select(*keys, "points", "length")
    fields = [*(own.schema[k] for k in keys), *(T.StructField(c, T.DoubleType()) for c in PEAK)]
    return own.mapInPandas(work, T.StructType(fields))


def peak_colors(peaks: DataFrame, pairs=(("ztfg", "ztfr"), ("ztfr", "ztfi")), min_eff_points: float = 1) -> DataFrame:
    """One row for each object and pair of bands that it has: colour, its error, difference of peak times, and a warning
    where a band has few points before or after its peak."""
    rest = [c for c in peaks.columns if c not in ("object_id", "band")]
    bands = sorted({b for p in pairs for b in p})
    # a column for each band of one row for each object: no join of peaks with themselves
    by = peaks.filter(F.col("band").isin(bands)).groupBy("object_id").agg(*(F.max(F.when(F.col("band") == b, F.struct(*rest))).alias(f"by_{i}") for i, b in enumerate(bands)))
    each = F.array(*(F.struct(F.lit(a).alias("band_1"), F.lit(b).alias("band_2"), F.col(f"by_{bands.index(a)}").alias("one"), F.col(f"by_{bands.index(b)}").alias("two")) for a, b in pairs))
    both = by.select("object_id", F.inline(each)).filter("one is not null and two is not null")
    both = both.select("object_id", "band_1", "band_2", *(F.col(f"{side}.{c}").alias(f"{c}_{n}") for n, side in ((1, "one"), (2, "two")) for c in rest))
    rel = lambda n: F.col(f"peak_flux_err_{n}") / F.col(f"peak_flux_{n}")
    few = F.lit(False)
    for n in (1, 2):
        for s in ("before", "after"):
            few = few | (F.col(f"n_eff_{s}_peak_{n}") < min_eff_points)
    return both.select(
        "object_id", F.concat_ws("-", "band_1", "band_2").alias("pair"), (-2.5 * F.log10(F.col("peak_flux_1") / F.col("peak_flux_2"))).alias("color"), (F.sqrt(rel(1) * rel(1) + rel(2) * rel(2)) * 1.085736).alias("color_err"),
        (F.col("peak_time_1") - F.col("peak_time_2")).alias("dt"), (F.col("n_eff_before_peak_1") + F.col("n_eff_before_peak_2")).alias("presum"), (F.col("n_eff_after_peak_1") + F.col("n_eff_after_peak_2")).alias("postsum"),
        "n_clipped_1", "n_clipped_2", "n_count_1", "n_count_2", few.alias("warning"),
    )
