"""Corrections: observed over model flux, smoothed in phase, on a grid of phase and wavelength."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEYS = ("object_id", "template")


def correction_points(points: DataFrame, bands: DataFrame) -> DataFrame:
    """phase, frac (flux over model flux), err and rest wavelength of each point; points without a finite ratio go.
    bands: band, wave_eff (a few rows)."""
    ratio = F.try_divide("flux", "model_flux")
    out = points.withColumn("frac", ratio).filter(F.col("frac").isNotNull() & ~F.isnan("frac") & (F.abs("frac") < float("inf")))
    return out.join(F.broadcast(bands), "band").withColumn("wave", F.col("wave_eff") / (1 + F.col("z"))).select(*KEYS, "band", "phase", "frac", F.col("fluxerr").alias("err"), "wave")


def with_edges(points: DataFrame, start: float, end: float, cadence: float = 3.0) -> DataFrame:
    """Points with factors of 1 before the first and after the last point of each band, every cadence days up to start and
    end; their errors go evenly from 0.01 to the nearest point's. None on a side where the data go beyond it."""
    ends = points.groupBy(*KEYS, "band").agg(F.min("phase").alias("lo"), F.max("phase").alias("hi"), F.min_by("err", F.struct("phase", "err")).alias("e_lo"), F.max_by("err", F.struct("phase", "err")).alias("e_hi"), F.first("wave").alias("wave"))
    step = F.lit(cadence)
    n_pre = F.greatest(F.ceil((F.col("lo") - start) / step).cast("int"), F.lit(1))
    pre = F.transform(F.sequence(F.lit(0), n_pre - 1), lambda i: F.struct((F.lit(start) + i * step).alias("phase"), F.when(n_pre > 1, F.lit(0.01) + (F.col("e_lo") - 0.01) * i / (n_pre - 1)).otherwise(0.01).alias("err")))
    first = F.col("hi") + step
    n_post = F.ceil((F.lit(end) - first) / step).cast("int")
    post = F.transform(F.sequence(F.lit(0), F.greatest(n_post, F.lit(1)) - 1), lambda i: F.struct(F.when(n_post > 0, first + i * step).otherwise(F.lit(end)).alias("phase"), F.when(n_post > 1, F.col("e_hi") + (F.lit(0.01) - F.col("e_hi")) * i / (n_post - 1)).otherwise(F.col("e_hi")).alias("err")))
    empty = F.array().cast("array<struct<phase:double,err:double>>")
    edges = ends.select(*KEYS, "band", "wave", F.explode(F.concat(F.when(F.col("lo") < start, empty).otherwise(pre), F.when(F.col("hi") > end, empty).otherwise(post))).alias("p"))
    return points.unionByName(edges.select(*KEYS, "band", F.col("p.phase").alias("phase"), F.lit(1.0).alias("frac"), F.col("p.err").alias("err"), "wave"))


def smoothing_spline(x: np.ndarray, y: np.ndarray, w: np.ndarray, lam: float):
    """Natural cubic that minimises sum w (y - f)^2 + lam integral f''^2; returns nodes, values and second derivatives.
    Equal x count as one point with the weighted mean."""
    u, back = np.unique(x, return_inverse=True)
    weight = np.bincount(back, w)
    y = np.bincount(back, w * y) / weight
    gamma, bend = banded_gamma(np.diff(u), y, lam / weight, lam)
    return u, y - bend, np.concatenate([[0], gamma, [0]])


def banded_gamma(h: np.ndarray, y: np.ndarray, pull: np.ndarray, lam: float) -> tuple[np.ndarray, np.ndarray]:
    """Second derivatives at the inner nodes, and what the curve takes off y: the equations have five bands, which are kept as
    three rows and factorised from the left (L D L' without pivots, as they are positive definite), so n nodes take n steps."""
    a, c = 1 / h[:-1], 1 / h[1:]
    b = -a - c
    main = (h[:-1] + h[1:]) / 3 + pull[:-2] * a * a + pull[1:-1] * b * b + pull[2:] * c * c
    first = h[1:-1] / 6 + pull[1:-2] * b[:-1] * a[1:] + pull[2:-1] * c[:-1] * b[1:]
    second = pull[2:-2] * c[:-2] * a[2:]
    right = (a * y[:-2] + b * y[1:-1] + c * y[2:]).tolist()
    n = len(right)
    d, one, two = main.tolist(), [*first.tolist(), 0.0], [*second.tolist(), 0.0, 0.0]
    for i in range(n - 1):  # column i leaves its two neighbours below
        l1, l2 = one[i] / d[i], two[i] / d[i]
        d[i + 1] -= l1 * one[i]
        right[i + 1] -= l1 * right[i]
        if i + 2 < n:
            one[i + 1] -= l1 * two[i]
            d[i + 2] -= l2 * two[i]
            right[i + 2] -= l2 * right[i]
    for i in range(n - 1, -1, -1):
        right[i] = (right[i] - (one[i] * right[i + 1] if i + 1 < n else 0.0) - (two[i] * right[i + 2] if i + 2 < n else 0.0)) / d[i]
    gamma = np.array(right)
    q = np.zeros(len(y))
    q[:-2] += a * gamma
    q[1:-1] += b * gamma
    q[2:] += c * gamma
    return gamma, pull * q


def evaluate(u, f, m, at):
    """A natural cubic at any place; outside its nodes it goes on straight."""
    i = np.clip(np.searchsorted(u, at, side="right") - 1, 0, len(u) - 2)
    h = u[i + 1] - u[i]
    a, b = u[i + 1] - at, at - u[i]
    inner = (m[i] * a**3 + m[i + 1] * b**3) / (6 * h) + (f[i] / h - m[i] * h / 6) * a + (f[i + 1] / h - m[i + 1] * h / 6) * b
    slope_lo = (f[1] - f[0]) / (u[1] - u[0]) - (u[1] - u[0]) * (2 * m[0] + m[1]) / 6
    slope_hi = (f[-1] - f[-2]) / (u[-1] - u[-2]) + (u[-1] - u[-2]) * (m[-2] + 2 * m[-1]) / 6
    return np.where(at < u[0], f[0] + slope_lo * (at - u[0]), np.where(at > u[-1], f[-1] + slope_hi * (at - u[-1]), inner))


#: Nodes up to which splines are solved side by side.
SIDE_BY_SIDE = 1000


def padded(n: np.ndarray, values: np.ndarray, fill: float) -> np.ndarray:
    out = np.full((len(n), int(n.max(initial=1))), fill)
    out[np.arange(out.shape[1]) < n[:, None]] = values
    return out


def splines(n: np.ndarray, x: np.ndarray, ys: list, w: np.ndarray, lam: float, at: np.ndarray) -> list:
    """smoothing_spline of many groups of n points each (one after the other, x ascending in each) for each of ys, evaluated at at: the same
    equations, each step of which is taken for all groups together."""
    group = np.repeat(np.arange(len(n)), n)
    new = np.r_[True, (np.diff(x) > 0) | (np.diff(group) > 0)]
    back = np.cumsum(new) - 1
    weight, n = np.bincount(back, w), np.bincount(group[new], minlength=len(n))
    u = padded(n, x[new], np.inf)
    pull = padded(n, lam / weight, 0.0)
    y = np.stack([padded(n, np.bincount(back, w * v) / weight, 0.0) for v in ys])
    j = np.arange(u.shape[1])
    with np.errstate(invalid="ignore"):
        h = np.where(j[:-1] < n[:, None] - 1, np.diff(u, axis=1), 1.0)
    a, c = 1 / h[:, :-1], 1 / h[:, 1:]
    b = -a - c
    inner = lambda k: j[: u.shape[1] - 2 - k] < n[:, None] - 2 - k
    d = np.where(inner(0), (h[:, :-1] + h[:, 1:]) / 3 + pull[:, :-2] * a * a + pull[:, 1:-1] * b * b + pull[:, 2:] * c * c, 1.0)
    one, two = np.zeros_like(d), np.zeros_like(d)
    one[:, :-1] = np.where(inner(1), h[:, 1:-1] / 6 + pull[:, 1:-2] * b[:, :-1] * a[:, 1:] + pull[:, 2:-1] * c[:, :-1] * b[:, 1:], 0.0)
    two[:, :-2] = np.where(inner(2), pull[:, 2:-2] * c[:, :-2] * a[:, 2:], 0.0)
    right = np.where(inner(0), a * y[:, :, :-2] + b * y[:, :, 1:-1] + c * y[:, :, 2:], 0.0)
    m = d.shape[1]
    for i in range(m - 1):
        l1, l2 = one[:, i] / d[:, i], two[:, i] / d[:, i]
        d[:, i + 1] -= l1 * one[:, i]
        right[:, :, i + 1] -= l1 * right[:, :, i]
        if i + 2 < m:
            one[:, i + 1] -= l1 * two[:, i]
            d[:, i + 2] -= l2 * two[:, i]
            right[:, :, i + 2] -= l2 * right[:, :, i]
    for i in range(m - 1, -1, -1):
        right[:, :, i] = (right[:, :, i] - (one[:, i] * right[:, :, i + 1] if i + 1 < m else 0.0) - (two[:, i] * right[:, :, i + 2] if i + 2 < m else 0.0)) / d[:, i]
    bend = np.zeros_like(y)
    bend[:, :, :-2] += a * right
    bend[:, :, 1:-1] += b * right
    bend[:, :, 2:] += c * right
    f, gamma = y - pull * bend, np.concatenate([np.zeros((*y.shape[:2], 1)), right, np.zeros((*y.shape[:2], 1))], axis=2)
    k = np.clip((u[:, :, None] <= at).sum(axis=1) - 1, 0, (n - 2)[:, None])
    rows = np.arange(len(n))[:, None]
    step, lo, hi = h[rows, k], at - u[rows, k], u[rows, k + 1] - at
    last = (np.arange(len(n)), n - 1)
    out = []
    for v, g in zip(f, gamma, strict=True):
        inside = (g[rows, k] * hi**3 + g[rows, k + 1] * lo**3) / (6 * step) + (v[rows, k] / step - g[rows, k] * step / 6) * hi + (v[rows, k + 1] / step - g[rows, k + 1] * step / 6) * lo
        h0, h1 = h[:, 0], h[np.arange(len(n)), n - 2]
        slope_lo = (v[:, 1] - v[:, 0]) / h0 - h0 * (2 * g[:, 0] + g[:, 1]) / 6
        slope_hi = (v[last] - v[last[0], n - 2]) / h1 + h1 * (g[last[0], n - 2] + 2 * g[last]) / 6
        before, after = at < u[:, :1], at > u[last][:, None]
        out.append(np.where(before, v[:, :1] + slope_lo[:, None] * (at - u[:, :1]), np.where(after, v[last][:, None] + slope_hi[:, None] * (at - u[last][:, None]), inside)))
    return out


def correction_curves(points: DataFrame, phases: list[float], lam: float = 0.1) -> DataFrame:
    """The smoothed factor and its error at the template's phases, for bands with at least 5 points. A group is the points
    of one object in one band, a row here, so it is small; an Arrow batch of them is solved side by side."""
    at, keys = np.array(phases), [*KEYS, "band"]
    each = points.groupBy(*keys).agg(F.first("wave").alias("wave"), F.array_sort(F.collect_list(F.struct("phase", "frac", "err"))).alias("p"))
    each = each.filter(F.size(F.array_distinct(F.transform("p", lambda x: x["phase"]))) >= 5)

    def work(batches):
        for whole in batches:
            for begin in range(0, whole.num_rows, 500):
                batch = whole.slice(begin, 500)
                p = batch.column("p")
                n, p = np.asarray(p.value_lengths()), p.flatten()
                x, y, e = (np.asarray(p.field(c), float) for c in ("phase", "frac", "err"))
                t, error = np.zeros((2, len(n), len(at)))
                big, ends = n > SIDE_BY_SIDE, np.cumsum(n)
                of = np.repeat(~big, n)
                if of.any():
                    t[~big], error[~big] = splines(n[~big], x[of], [y[of], e[of]], 1 / e[of] ** 2, lam, at)
                for i in np.flatnonzero(big):
                    own = slice(ends[i] - n[i], ends[i])
                    t[i], error[i] = (evaluate(*smoothing_spline(x[own], v[own], 1 / e[own] ** 2, lam), at) for v in (y, e))
                offsets = pa.array(np.arange(len(n) + 1) * len(at), pa.int32())
                lists = (pa.ListArray.from_arrays(offsets, pa.array(v.ravel())) for v in (np.tile(at, len(n)), t, error))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (*keys, "wave")), *lists], [*keys, "wave", "tphase", "tcorr", "terr"])

    kinds = [*(each.schema[c] for c in (*keys, "wave")), *(T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("tphase", "tcorr", "terr"))]
    return each.mapInArrow(work, T.StructType(kinds)).select(*keys, "wave", F.inline(F.arrays_zip("tphase", "tcorr", "terr")))


def surface(curves: DataFrame, first_wave: float, last_wave: float, bands=("ztfg", "ztfr", "ztfi"), least: int = 2) -> DataFrame:
    """object_id, template, phase, wave, factor: the curves of the bands with factor 1 at both ends of the wavelengths.
    Pairs with fewer bands than least have none."""
    own = curves.filter(F.col("band").isin(*bands)).select(*KEYS, "band", F.col("tphase").alias("phase"), "wave", F.col("tcorr").alias("factor"))
    enough = own.groupBy(*KEYS).agg(F.count_distinct("band").alias("n")).filter(F.col("n") >= least).drop("n")
    own = own.join(enough, list(KEYS), "left_semi").drop("band")
    edge = own.select(*KEYS, "phase").distinct().withColumn("wave", F.explode(F.array(F.lit(float(first_wave)), F.lit(float(last_wave))))).withColumn("factor", F.lit(1.0))
    return own.unionByName(edge)


def bulk(fits: DataFrame, surfaces: DataFrame) -> DataFrame:
    """The record of each pair that succeeds and has a surface: dps_init, hostebv, success, ndof, absmag, chidof, lceval and
    corrmodel, its surface as an array of phase, wave and factor. A surface is one fixed grid, so an array of it is small."""
    cells = surfaces.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("phase", "wave", "factor"))).alias("corrmodel"))
    return fits.filter("success").join(cells, list(KEYS)).select(*KEYS, "dps_init", F.col("ebv").alias("hostebv"), "success", "ndof", "absmag", "chidof", "lceval", "corrmodel")
