"""Column functions: dust law, distances, kernels, survival function, uniforms."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def horner(x: Column, *coefficients: float) -> Column:
    """Polynomial, coefficients from the constant on."""
    out = F.lit(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        out = F.lit(c) + x * out
    return out


# Published coefficients of the optical and near-infrared dust law of 1989 (fixed values, from the constant on).
OPTICAL_A = (1.0, 0.17699, -0.50447, -0.02427, 0.72085, 0.01979, -0.77530, 0.32999)
OPTICAL_B = (0.0, 1.41338, 2.28305, 1.07233, -5.38434, -0.62251, 5.30260, -2.09002)


def dust_ratio(wave: Column, r_v: float = 3.1) -> Column:
    """A(wave) / A(V), wave in Angstrom: infrared, optical and ultraviolet parts of the law, up to 10 per micron."""
    x = F.lit(1e4) / wave
    y = x - 1.82
    infrared = F.pow(x, F.lit(1.61)) * (0.574 - 0.527 / r_v)
    optical = horner(y, *OPTICAL_A) + horner(y, *OPTICAL_B) / r_v
    u = x - 5.9
    fa = F.when(x >= 5.9, -0.04473 * u * u - 0.009779 * u * u * u).otherwise(0.0)
    fb = F.when(x >= 5.9, 0.2130 * u * u + 0.1207 * u * u * u).otherwise(0.0)
    ua = 1.752 - 0.316 * x - 0.104 / ((x - 4.67) * (x - 4.67) + 0.341) + fa
    ub = -3.090 + 1.825 * x + 1.206 / ((x - 4.62) * (x - 4.62) + 0.263) + fb
    v = x - 8
    far = horner(v, -1.073, -0.628, 0.137, -0.070) + horner(v, 13.670, 4.257, -0.420, 0.374) / r_v
    return F.when(x < 1.1, infrared).when(x < 3.3, optical).when(x < 8, ua + ub / r_v).otherwise(far)


def dust_sql(wave: str, r_v: float = 3.1) -> str:
    """The law as SQL, down to 1250 Angstrom."""
    x = f"(10000.0::DOUBLE / {wave})"
    y = f"({x} - 1.82::DOUBLE)"
    u = f"greatest({x} - 5.9::DOUBLE, 0)"
    poly = lambda cs: " + ".join(f"({c!r})::DOUBLE * pow({y}, {i})" for i, c in enumerate(cs))
    ua = f"1.752::DOUBLE - 0.316::DOUBLE * {x} - 0.104::DOUBLE / (pow({x} - 4.67::DOUBLE, 2) + 0.341::DOUBLE) - 0.04473::DOUBLE * pow({u}, 2) - 0.009779::DOUBLE * pow({u}, 3)"
    ub = f"-3.090::DOUBLE + 1.825::DOUBLE * {x} + 1.206::DOUBLE / (pow({x} - 4.62::DOUBLE, 2) + 0.263::DOUBLE) + 0.2130::DOUBLE * pow({u}, 2) + 0.1207::DOUBLE * pow({u}, 3)"
    return f"CASE WHEN {x} < 1.1 THEN pow({x}, 1.61) * {0.574 - 0.527 / r_v!r} WHEN {x} < 3.3 THEN ({poly(OPTICAL_A)}) + ({poly(OPTICAL_B)}) / {r_v!r} ELSE ({ua}) + ({ub}) / {r_v!r}::DOUBLE END"


def extinction(wave: Column, a_v: Column, r_v: float = 3.1) -> Column:
    """Factor of transmitted flux."""
    return F.pow(F.lit(10.0), F.lit(-0.4) * a_v * dust_ratio(wave, r_v))


#: Flat universe (published 2013 values): Hubble constant, matter density; speed of light in km/s.
H0, OMEGA_M, LIGHT = 67.77, 0.30712, 299792.458
Z_STEP = 0.0005


#: Redshifts beyond it are an error.
Z_MAX = 10.0


def distance_modulus_nodes(spark, z_max: float = Z_MAX) -> DataFrame:
    """i, dm: distance modulus at z = i Z_STEP, by running sums of the trapezoids of 1 / E(z). A constant table of z_max / Z_STEP rows."""
    n = int(round(z_max / Z_STEP))
    nodes = spark.range(0, n + 1, 1, 1).select(F.col("id").alias("i"), (F.col("id") * Z_STEP).alias("z"))
    inv = F.lit(1.0) / F.sqrt(F.lit(OMEGA_M) * F.pow(1 + F.col("z"), F.lit(3.0)) + F.lit(1 - OMEGA_M))
    w = Window.orderBy("i")  # the constant node table, not data
    part = nodes.withColumn("f", inv).withColumn("t", F.coalesce((F.col("f") + F.lag("f").over(w)) / 2 * Z_STEP, F.lit(0.0)))
    d = part.withColumn("d", F.sum("t").over(w.rowsBetween(Window.unboundedPreceding, 0)) * (LIGHT / H0) * (1 + F.col("z")))
    return d.select("i", F.when(F.col("d") > 0, 5 * F.log10(F.col("d")) + 25).alias("dm"))


def with_distance_modulus(df: DataFrame, z: str = "z") -> DataFrame:
    """distmod, linear between the nodes; null at z = 0 and below, an error beyond Z_MAX."""
    nodes = distance_modulus_nodes(df.sparkSession)
    a, b = nodes.select(F.col("i").alias("__i"), F.col("dm").alias("__a")), nodes.select(F.col("i").alias("__j"), F.col("dm").alias("__b"))
    at = F.col(z) / Z_STEP
    out = df.withColumn("__k", F.floor(at + 1e-9)).join(F.broadcast(a), F.col("__k") == F.col("__i"), "left").join(F.broadcast(b), F.col("__k") + 1 == F.col("__j"), "left")
    far = F.when(F.col(z) >= Z_MAX, F.raise_error(F.lit(f"redshifts of {Z_MAX:g} and more have no distance here")).cast("double"))
    return out.withColumn("distmod", F.coalesce(far, F.col("__a") + (at - F.col("__k")) * (F.col("__b") - F.col("__a")))).drop("__k", "__i", "__j", "__a", "__b")


DISTMOD_CTE = f"""dm AS (SELECT i, CASE WHEN d > 0 THEN 5 * log10(d) + 25 END AS dm FROM (SELECT i, sum(t) OVER (ORDER BY i) * {LIGHT / H0!r} * (1 + z) AS d FROM (SELECT i, z, coalesce((f + lag(f) OVER (ORDER BY i)) / 2 * {Z_STEP!r}, 0) AS t
    FROM (SELECT i, i * {Z_STEP!r}::DOUBLE AS z, 1 / sqrt({OMEGA_M!r}::DOUBLE * pow(1 + i * {Z_STEP!r}::DOUBLE, 3) + {1 - OMEGA_M!r}::DOUBLE) AS f FROM (SELECT unnest(range(0, 1001)) AS i)))))"""


def distmod_sql(z: str) -> str:
    return f"(SELECT a.dm + ({z} / {Z_STEP!r}::DOUBLE - a.i) * (b.dm - a.dm) FROM dm a JOIN dm b ON b.i = a.i + 1 WHERE a.i = CAST(floor({z} / {Z_STEP!r}::DOUBLE + 1e-9) AS BIGINT))"


def matern32(r: Column, length: Column | float, amplitude: float = 1.0) -> Column:
    s = F.sqrt(F.lit(3.0)) * F.abs(r) / length
    return F.lit(amplitude**2) * (1 + s) * F.exp(-s)


def chi2_survival_even(chi2: Column, dof: Column) -> Column:
    """Chance of a larger chi2 for an even number of degrees of freedom: a finite sum."""
    h = chi2 / 2
    terms = F.aggregate(F.sequence(F.lit(1), F.greatest((dof / 2).cast("int") - 1, F.lit(1))), F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total")), lambda a, i: F.struct((a["term"] * h / i).alias("term"), (a["total"] + a["term"] * h / i).alias("total")))
    return F.exp(-h) * F.when(dof <= 2, 1.0).otherwise(terms["total"])


def upper_gamma(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised upper incomplete gamma function: series below a + 1, continued fraction above."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    log_g = np.array([math.lgamma(v) if v > 0 else np.nan for v in a.ravel()]).reshape(a.shape)
    with np.errstate(all="ignore"):
        front = np.exp(-x + a * np.log(np.where(x > 0, x, 1)) - log_g)
        term = total = 1 / a
        for n in range(1, 400):
            term = term * x / (a + n)
            total = total + term
        b = x + 1 - a
        c, d = np.full_like(x, 1e300), 1 / np.where(b == 0, 1e-300, b)
        h = d
        for i in range(1, 400):
            an = -i * (i - a)
            b = b + 2
            d = an * d + b
            d = 1 / np.where(np.abs(d) < 1e-300, 1e-300, d)
            c = b + an / c
            c = np.where(np.abs(c) < 1e-300, 1e-300, c)
            h = h * d * c
        out = np.where(x < a + 1, 1 - front * total, front * h)
    return np.where(x <= 0, 1.0, np.clip(out, 0, 1))


@F.pandas_udf(DoubleType())
def chi2_survival(chi2: pd.Series, dof: pd.Series) -> pd.Series:
    """Chance of a larger chi2 for any number of degrees of freedom; null for none."""
    ok = chi2.notna() & (dof > 0)
    out = pd.Series(np.nan, index=chi2.index)
    out[ok] = upper_gamma(dof[ok].to_numpy(float) / 2, chi2[ok].to_numpy(float) / 2)
    return out.where(ok, None)


def erfcx(u: np.ndarray) -> np.ndarray:
    """exp(u^2) erfc(u), without overflow for large u (for u below -26 it is infinite)."""
    u = np.asarray(u, float)
    near = np.clip(u, -27.0, 25.0)
    with np.errstate(over="ignore"):
        inner = np.exp(near * near) * np.array([math.erfc(v) for v in near.ravel()]).reshape(near.shape)
    far = np.maximum(u, 25.0)
    q = 1 / (2 * far * far)
    return np.where(u < 25.0, inner, (1 - q * (1 - 3 * q * (1 - 5 * q))) / (far * math.sqrt(math.pi)))


def emg_logpdf(x, k, loc, scale) -> np.ndarray:
    """Logarithm of the density of the exponentially modified Gaussian with shape k = tau / scale; down to k = 0 the Gaussian."""
    x, k, loc, scale = np.broadcast_arrays(*(np.asarray(v, float) for v in (x, k, loc, scale)))
    z, small = (x - loc) / scale, k < 1e-6
    safe = np.where(small, 1.0, k)
    u = (1 / safe - z) / math.sqrt(2)
    with np.errstate(all="ignore"):
        above = -z * z / 2 + np.log(erfcx(np.maximum(u, 0)))  # exp(1 / 2k^2 - z / k - u^2) is exp(-z^2 / 2)
        below = 1 / (2 * safe * safe) - z / safe + np.log([math.erfc(v) for v in np.minimum(u, 0).ravel()]).reshape(u.shape)
    out = np.where(u > 0, above, below) - np.log(2 * safe * scale)
    return np.where(small, -z * z / 2 - np.log(scale * math.sqrt(2 * math.pi)), out)


@F.pandas_udf(DoubleType())
def emg_pdf(x: pd.Series, k: pd.Series, loc: pd.Series, scale: pd.Series) -> pd.Series:
    """Density of the exponentially modified Gaussian."""
    return pd.Series(np.exp(emg_logpdf(x, k, loc, scale)))


def emg_scores(x: np.ndarray, loc: float, log_scale: float, log_tau: float) -> np.ndarray:
    """Derivatives of the log density by loc, log(scale) and log(tau), a column each: expectations of the exponential part given x."""
    s, tau = math.exp(log_scale), math.exp(log_tau)
    d = x - loc
    m = d - s * s / tau
    hazard = math.sqrt(2 / math.pi) / erfcx(-m / (s * math.sqrt(2)))
    y = np.maximum(m + s * hazard, 0.0)
    yy = m * y + s * s
    return np.column_stack([(d - y) / (s * s), (d * d - 2 * d * y + yy) / (s * s) - 1, y / tau - 1])


def uniform(seed: int, *keys: Column | str) -> Column:
    """A number in [0, 1) that depends on seed and keys alone, on any partitioning."""
    text = F.concat_ws("|", F.lit(str(seed)), *(k.cast("string") if isinstance(k, Column) else F.col(k).cast("string") for k in keys))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(2.0**52)


def uniform_sql(seed: int, *keys: str) -> str:
    text = " || '|' || ".join([f"'{seed}'", *(f"CAST({k} AS VARCHAR)" for k in keys)])
    return f"(CAST(('0x' || substr(md5({text}), 1, 13)) AS BIGINT) / 4503599627370496.0::DOUBLE)"
