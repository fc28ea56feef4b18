"""Peak-colour populations: outlier filters, ex-Gaussian fits, E(B-V) that gives a target colour."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nightflux.functions.astro import dust_ratio, emg_logpdf, emg_scores, uniform


def outlier_free(df: DataFrame, column: str = "color", key: str = "class", mode: str = "finite", k: float = 3.0, n_sigma: float = 5.0) -> DataFrame:
    """finite: finite values; iqr: within k interquartile ranges of the quartiles; clip5: of those, within n_sigma
    deviations of the mean of their central nine tenths; auto: clip5 from 5 rows on."""
    if mode not in ("finite", "iqr", "clip5", "auto"):
        raise ValueError(f"unknown mode {mode}")
    x = F.col(column)
    df = df.filter(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    if mode == "finite":
        return df
    n = df.groupBy(key).agg(F.percentile(column, F.array(F.lit(0.25), F.lit(0.75))).alias("q"), F.count("*").alias("n"))
    q1, q3 = F.col("q")[0], F.col("q")[1]
    inner = df.join(n, key).filter(((x >= q1 - k * (q3 - q1)) & (x <= q3 + k * (q3 - q1))) | (F.lit(mode == "auto") & (F.col("n") < 5)))
    if mode == "iqr":
        return inner.drop("q", "n")
    core = inner.groupBy(key).agg(F.percentile(column, F.array(F.lit(0.05), F.lit(0.95))).alias("c"))
    middle = inner.join(core, key).filter(x.between(F.col("c")[0], F.col("c")[1]))
    stats = middle.groupBy(key).agg(F.avg(column).alias("mu"), F.stddev_pop(column).alias("sd"))
    near = (x > F.col("mu") - n_sigma * F.col("sd")) & (x < F.col("mu") + n_sigma * F.col("sd"))
    return inner.join(stats, key, "left").filter(F.coalesce(near, F.lit(False)) | (F.lit(mode == "auto") & (F.col("n") < 5))).drop("q", "n", "mu", "sd")


def emg_fit(df: DataFrame, column: str = "color", key: str = "class") -> DataFrame:
    """Ex-Gaussian by moments: shape k, loc, scale, n; degenerate where the skewness allows none or there are under 5 rows."""
    m = df.groupBy(key).agg(F.count(column).alias("n"), F.avg(column).alias("m"), F.stddev_pop(column).alias("s"), F.skewness(column).alias("g"))
    g = F.least(F.greatest("g", F.lit(0.0)), F.lit(1.99))
    tau = F.col("s") * F.pow(g / 2, F.lit(1 / 3))
    sigma = F.sqrt(F.col("s") * F.col("s") - tau * tau)
    return m.select(key, "n", F.try_divide(tau, sigma).alias("k"), (F.col("m") - tau).alias("loc"), sigma.alias("scale"), ((F.col("g") <= 0) | (F.col("n") < 5)).alias("degenerate"))


def emg_likelihood(df: DataFrame, fits: DataFrame, column: str = "color", key: str = "class", rounds: int = 40, small: float = 1e-9) -> DataFrame:
    """key, n, k, loc, scale, loglik: the most likely parameters, by Newton steps from the moment fits (fits: key, k, loc, scale).

    Each round is one pass over the rows: every task sums the log density and its derivatives by class, at the parameters and beside
    them (for the second derivatives). A class is one row of such sums, which is what reaches the driver. Steps that lower the
    likelihood are halved; the shape stays between 1e-3 and 1e3, where the density is a Gaussian or an exponential.
    """
    x = df.select(F.col(key).cast("string").alias(key), F.col(column).cast("double").alias("x")).filter("x is not null and not isnan(x) and abs(x) < double('inf')")
    now = {}
    for r in fits.select(F.col(key).cast("string"), "k", "loc", "scale", "n").collect():  # one row a class
        if r["scale"] and r["scale"] > 0 and r["n"] > 2:
            k = r["k"] if r["k"] and 0.05 < r["k"] < 50 else 0.3
            now[r[0]] = np.array([r["loc"], math.log(r["scale"]), math.log(r["scale"] * k)])
    step, best, open_ = {c: np.zeros(3) for c in now}, {}, set(now)
    fields = ["n", "l", *(f"d{i}_{j}" for i in range(7) for j in range(3))]
    for _ in range(rounds):
        if not open_:
            break
        tried = {c: now[c] + step[c] for c in open_}

        def work(frames, tried=tried):
            for pdf in frames:
                out = []
                for c, rows in pdf.groupby(key)["x"]:
                    if c in tried:
                        t, v = tried[c], rows.to_numpy()
                        h = 1e-4 * np.array([math.exp(t[1]), 1.0, 1.0])
                        beside = [t, *(t + sign * h[i] * np.eye(3)[i] for i in range(3) for sign in (1, -1))]
                        logs = emg_logpdf(v, math.exp(t[2] - t[1]), t[0], math.exp(t[1]))
                        out.append((c, float(len(v)), float(logs.sum()), *np.concatenate([emg_scores(v, *b).sum(axis=0) for b in beside])))
                yield pd.DataFrame(out, columns=[key, *fields])

        sums = x.mapInPandas(work, f"`{key}` string, " + ", ".join(f"{f} double" for f in fields)).groupBy(key).agg(*(F.sum(f).alias(f) for f in fields))
        for r in sums.collect():  # one row a class
            c, n = r[key], r["n"]
            if c in best and not r["l"] >= best[c][1] - 1e-9 * abs(best[c][1]):
                step[c] = step[c] / 2
                if np.abs(step[c]).max() < small:
                    open_.discard(c)
                continue
            now[c] = tried[c]
            best[c] = (now[c], r["l"], int(n))
            d = np.array([[r[f"d{i}_{j}"] for j in range(3)] for i in range(7)])
            h = 1e-4 * np.array([math.exp(now[c][1]), 1.0, 1.0])
            second = np.array([(d[1 + 2 * i] - d[2 + 2 * i]) / (2 * h[i]) for i in range(3)])
            second = (second + second.T) / 2
            top = np.linalg.eigvalsh(second)[-1]
            move = -np.linalg.solve(second - (max(top, 0) * 1.5 + 1e-9 * n) * np.eye(3), d[0])
            move = np.clip(move, -1.0, 1.0)
            low, high = now[c][1] + math.log(1e-3), now[c][1] + math.log(1e3)
            move[2] = min(max(now[c][2] + move[2], low), high) - now[c][2]
            step[c] = move
            if np.abs(move / np.array([math.exp(now[c][1]), 1, 1])).max() < small:
                open_.discard(c)
    rows = [(c, n, math.exp(t[2] - t[1]), float(t[0]), math.exp(t[1]), float(ll)) for c, (t, ll, n) in best.items()]
    return df.sparkSession.createDataFrame(rows, f"`{key}` string, n long, k double, loc double, scale double, loglik double")


def emg_draw(k, loc, scale, seed: int, *keys):
    """A draw from the distribution, from hash uniforms: Gaussian by Box-Muller plus exponential."""
    u1, u2, u3 = (F.greatest(uniform(seed + i, *keys), F.lit(1e-12)) for i in range(3))
    normal = F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(6.283185307179586) * u2)
    return loc + scale * (normal - k * F.log(u3))


def histogram(df: DataFrame, column: str, lo: float, hi: float, bins: int, *keys: str) -> DataFrame:
    """bin, n: even bins, the last one closed on the right; values outside are not counted."""
    x = F.col(column)
    b = F.least(F.floor((x - lo) / ((hi - lo) / bins)), F.lit(bins - 1))
    return df.filter(x.between(lo, hi)).groupBy(*keys, b.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def bins_for(n):
    """5, 10 or 20 bins by the number of rows."""
    return F.when(n < 30, 5).when(n < 120, 10).otherwise(20)


def peak_normalised(hist: DataFrame, *keys: str) -> DataFrame:
    return hist.withColumn("height", F.col("n") / F.max("n").over(Window.partitionBy(*keys)))


def cells(df: DataFrame, x: str, y: str, dx: float, dy: float) -> DataFrame:
    return df.groupBy(F.floor(F.col(x) / dx).alias("ix"), F.floor(F.col(y) / dy).alias("iy")).agg(F.count("*").alias("n")).withColumn("log_n", F.log10("n"))


def latest(log: DataFrame, key: str = "model", stamp: str = "timestamp", tie: str = "row_id") -> DataFrame:
    """The row with the latest time of each key; times that can't be read count as the earliest."""
    w = Window.partitionBy(key).orderBy(F.desc_nulls_last(F.try_to_timestamp(F.col(stamp))), F.desc(tie))
    return log.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def cubic_fit(pairs: DataFrame, key: str = "class", x: str = "x", y: str = "y") -> DataFrame:
    """c0 to c3 of the least-squares cubic of each group: sums of powers in one pass, then elimination in expressions."""
    p = lambda n: F.lit(1.0) if n == 0 else F.pow(F.col(x), F.lit(float(n)))
    sums = pairs.groupBy(key).agg(F.count("*").alias("n"), *(F.sum(p(i)).alias(f"s{i}") for i in range(7)), *(F.sum(p(i) * F.col(y)).alias(f"t{i}") for i in range(4)))
    rows = {(i, j): F.col(f"s{i + j}") for i in range(4) for j in range(4)} | {(i, 4): F.col(f"t{i}") for i in range(4)}
    out = sums
    for c in range(4):  # each step is a projection, so that expressions stay small
        step = {}
        for i in range(c + 1, 4):
            for j in range(c, 5):
                step[f"m{c}_{i}_{j}"] = rows[i, j] - rows[i, c] / rows[c, c] * rows[c, j]
        out = out.withColumns(step) if step else out
        rows |= {(i, j): F.col(f"m{c}_{i}_{j}") for i in range(c + 1, 4) for j in range(c, 5)}
    for i in (3, 2, 1, 0):
        known = rows[i, 4]
        for j in range(i + 1, 4):
            known = known - rows[i, j] * F.col(f"c{j}")
        out = out.withColumn(f"c{i}", known / rows[i, i])
    return out.select(key, "n", "c0", "c1", "c2", "c3")


def regression_rows(pairs: DataFrame, cls: str = "class", color: str = "natcol") -> DataFrame:
    """Rows that a class's regression may use."""
    low = F.col(cls).isin("SLSN-I", "SLSN-II", "SLSN (e)", "SLSN (w)")
    return pairs.filter(F.when(low, F.col(color) > -1).when(F.col(cls) == "SN Ic-BL", F.col(color) < 1).otherwise(True))


def solve_ebv(nodes: DataFrame, targets: DataFrame, *keys: str) -> DataFrame:
    """ebv at which a model's colour is the target: the first bracket of its colour by ebv node, linear inside; null where
    none holds the target. nodes: keys, ebv, color; targets: keys, target."""
    w = Window.partitionBy(*keys).orderBy("ebv")
    n = nodes.withColumns({"ebv2": F.lead("ebv").over(w), "color2": F.lead("color").over(w)})
    t = F.col("target")
    inside = ((t >= F.col("color")) & (t < F.col("color2"))) | ((t <= F.col("color")) & (t > F.col("color2")))
    value = F.col("ebv") + (t - F.col("color")) / (F.col("color2") - F.col("color")) * (F.col("ebv2") - F.col("ebv"))
    return targets.join(n, list(keys)).groupBy(*keys, "target").agg(F.min_by(F.when(inside, value), F.when(inside, F.col("ebv"))).alias("ebv_fit"))


#: Natural logarithm of the factor that a unit of E(B-V) takes at a dust ratio of 1.
DIM = 0.4 * 3.1 * math.log(10.0)


def color_lines(at_peak: DataFrame, bandpass: DataFrame, *keys: str) -> DataFrame:
    """keys, lines: what a model's colour depends on, at redshift 0: for each wavelength of its two bands the photons that its
    spectrum gives there over those of the AB reference, the dust ratio, and the side (1 or 2).

    at_peak: keys, side, band, wave, flux, the rest-frame spectrum at the band's own peak. A model has some 40 lines.
    """
    from .synphot import WAVE_STEP, ab_scale

    lit = at_peak.join(F.broadcast(bandpass.join(ab_scale(bandpass), "band").select("band", "wave", "trans", "ab")), ["band", "wave"])
    line = F.struct("side", (F.col("flux") * F.col("trans") * F.col("wave") * WAVE_STEP / F.col("ab")).alias("w"), dust_ratio(F.col("wave")).alias("k"))
    return lit.groupBy(*keys).agg(F.collect_list(line).alias("lines"))


def colors_behind(w: list, k: list, ebv: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Colour of each row behind dust of its ebv, and the change of it by ebv. w, k: for side 1 and side 2, a row's photons and dust
    ratios by line."""
    y = [a * np.exp(-DIM * ebv[:, None] * b) for a, b in zip(w, k, strict=True)]
    s1, s2 = (v.sum(axis=1) for v in y)
    t1, t2 = (np.einsum("ij,ij->i", v, b) for v, b in zip(y, k, strict=True))
    return -2.5 * np.log10(s1 / s2), 2.5 / math.log(10.0) * DIM * (t1 / s1 - t2 / s2)


def dust_behind(w: list, k: list, of: np.ndarray, target: np.ndarray, bounds=(-5.0, 5.0), rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """E(B-V) at which the colour of row of is the target, and the colour there; NaN where none within bounds gives it to 1e-6. Newton
    steps within a bracket (colours get redder with dust); targets that are met take no part in further rounds."""
    n = len(target)
    lo, hi, e, color = np.full(n, bounds[0]), np.full(n, bounds[1]), np.zeros(n), np.full(n, np.nan)
    left = np.flatnonzero(np.isfinite(target))
    with np.errstate(all="ignore"):
        for _ in range(rounds):
            if not len(left):
                break
            at, mine = e[left], of[left]
            c, slope = colors_behind([x[mine] for x in w], [x[mine] for x in k], at)
            color[left] = c
            off = c - target[left]
            low, high = np.where(off <= 0, at, lo[left]), np.where(off >= 0, at, hi[left])
            newton = at - off / slope
            to = np.where((newton >= low) & (newton <= high), newton, (low + high) / 2)
            lo[left], hi[left] = low, high
            going = np.abs(to - at) >= 1e-13
            left = left[going]
            e[left] = to[going]
        color[left] = colors_behind([x[of[left]] for x in w], [x[of[left]] for x in k], e[left])[0] if len(left) else color[left]
    miss = ~(np.abs(color - target) < 1e-6)
    return np.where(miss, np.nan, e), np.where(miss, np.nan, color)


def dense(n: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Rows of n values each, filled up with 0."""
    out = np.zeros((len(n), int(n.max(initial=1))))
    out[np.arange(out.shape[1]) < n[:, None]] = values
    return out


def ebv_for(lines: DataFrame, targets: DataFrame, *keys: str, bounds=(-5.0, 5.0), rounds: int = 60) -> DataFrame:
    """keys, target, ebv_fit, color: the E(B-V) within bounds at which a model's colour is the target, and the colour there; null
    where no such dust gives it. lines: of color_lines, targets: keys, target. Rows are solved an Arrow batch at a time (dust_behind).
    """
    both = targets.select(*keys, "target").join(lines.select(*keys, "lines"), list(keys)).filter("target is not null and size(lines) > 0")

    def work(batches):
        for batch in batches:
            if batch.num_rows:
                column = batch.column("lines")
                rows = np.repeat(np.arange(batch.num_rows), np.asarray(column.value_lengths()))
                each = column.flatten()
                side = np.asarray(each.field("side"))
                part = lambda f, i: dense(np.bincount(rows[side == i], minlength=batch.num_rows), np.asarray(each.field(f), float)[side == i])  # noqa: B023, E731
                e, color = dust_behind([part("w", 1), part("w", 2)], [part("k", 1), part("k", 2)], np.arange(batch.num_rows), np.asarray(batch.column("target"), float), bounds, rounds)
                kept = [batch.column(c) for c in (*keys, "target")]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(e, mask=np.isnan(e)), pa.array(color, mask=np.isnan(color))], [*keys, "target", "ebv_fit", "color"])

    fields = [*(both.schema[c] for c in (*keys, "target")), T.StructField("ebv_fit", T.DoubleType()), T.StructField("color", T.DoubleType())]
    return both.mapInArrow(work, T.StructType(fields))


def warped_ebv(rows: DataFrame, factors, lines: dict, *keys: str) -> DataFrame:
    """keys, target, ebv_fit for each of a row's targets, as ebv_for gives them. rows: of synphot.warped_peaks, with targets (an array); factors and lines
    as there. A model's lines are made where they are needed and never leave their task."""
    from .synphot import by_lines

    told = rows.sparkSession.sparkContext.broadcast(lines)

    def work(batches):
        for batch in batches:
            n = np.asarray(batch.column("targets").value_lengths())
            ends = np.concatenate([[0], np.cumsum(n)])
            target = np.asarray(batch.column("targets").flatten(), float)
            e = np.full(len(target), np.nan)
            for at, part, sides in by_lines(batch, told.value):
                w, k = [], []
                for i, (phases, v, ratio, weights) in enumerate(sides, 1):
                    phase = np.asarray(part.column(f"phase_{i}"), float)
                    f = factors(part, phase[:, None])[:, 0]
                    w.append(v[np.searchsorted(phases, phase)] * np.maximum(f @ weights.T, 0.0))
                    k.append(np.broadcast_to(ratio, w[-1].shape))
                mine = np.concatenate([np.arange(ends[x], ends[x + 1]) for x in at])
                e[mine] = dust_behind(w, k, np.repeat(np.arange(len(at)), n[at]), target[mine])[0]
            lists = (pa.ListArray.from_arrays(pa.array(ends, pa.int32()), x) for x in (pa.array(target), pa.array(e, mask=np.isnan(e))))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keys), *lists], [*keys, "target", "ebv_fit"])

    array = T.ArrayType(T.DoubleType())
    solved = rows.mapInArrow(work, T.StructType([*(rows.schema[c] for c in keys), T.StructField("target", array), T.StructField("ebv_fit", array)]))
    return solved.select(*keys, F.inline(F.arrays_zip("target", "ebv_fit")))


def ebv_shift(df: DataFrame, mode: str = "none", seed: int = 0, formula: str = "difference", key: str = "model"):
    """samplecorr_ebv: none; harmonize to the class's loc; draw from its ex-Gaussian. formula: the cubic of target less
    peak colour ('difference'), or the cubic of the target less the peak colour ('served')."""
    if mode not in ("none", "harmonize", "draw"):
        raise ValueError(f"unknown mode {mode}")
    if mode == "none":
        return df.withColumn("samplecorr_ebv", F.lit(None).cast("double"))
    target = F.col("loc") if mode == "harmonize" else emg_draw(F.col("k"), F.col("loc"), F.col("scale"), seed, "id", key)
    cubic = lambda x: F.col("c0") + x * (F.col("c1") + x * (F.col("c2") + x * F.col("c3")))
    d = target - F.col("peakcol")
    return df.withColumns({"target": target, "samplecorr_ebv": cubic(d) if formula == "difference" else cubic(target) - F.col("peakcol")})


def peak_color(fluxes: DataFrame, band1: str, band2: str, *keys: str, at: str = "peak") -> DataFrame:
    """Difference of magnitudes of two bands, each at its own peak, or both at phase 0."""
    from .synphot import peak_phases

    if at not in ("peak", "zero"):
        raise ValueError(f"unknown place {at}")
    p = peak_phases(fluxes, *keys).select(*keys, "band", F.col("peak_flux").alias("f")) if at == "peak" else fluxes.filter("phase = 0").select(*keys, "band", F.col("flux").alias("f"))
    a, b = (p.filter(F.col("band") == n).select(*keys, F.col("f").alias(f"f{i}")) for i, n in ((1, band1), (2, band2)))
    return a.join(b, list(keys)).select(*keys, (-2.5 * F.log10(F.col("f1") / F.col("f2"))).alias("color"))
