"""Queries on light curves and their peaks."""

from __future__ import annotations

from pyspark.sql import functions as F

from nightflux.functions.astro import dust_ratio, dust_sql
from nightflux.operators import peaks as P
from nightflux.operators import photometry as L
from nightflux.operators import synphot as S
from nightflux.operators import taxonomy as T
from nightflux.sources import adapters as A

from .registry import query, rounded

N_GRID = 500


@query(A.with_ctes("photometry catalog", " SELECT p.object_id, p.band, round(p.time, 8) AS time, p.flux, round(p.fluxerr, 8) AS fluxerr, c.type, c.redshift FROM photometry p JOIN catalog c USING (object_id) WHERE abs(flux) / fluxerr >= 5 AND object_id IN (SELECT object_id FROM catalog WHERE redshift <> '-')"))
def light_curves(spark, d):
    """Significant points of the wanted objects with their catalogue data, in order of time in each object."""
    cat = A.catalog(spark, d)
    out = L.light_curves(A.photometry(spark, d), cat, T.without_missing(cat, "redshift").select("object_id"), 5.0)
    return rounded(out.select("object_id", "band", "time", "flux", "fluxerr", "type", "redshift"), "time", "fluxerr", digits=8)


@query("SELECT wave, round(" + dust_sql("wave") + ", 9) AS ratio, round(" + dust_sql("wave", 2.5) + ", 9) AS ratio25 FROM (SELECT DISTINCT 1300.0::DOUBLE + p_partkey * 7 % 11000 AS wave FROM part)")
def dust_law(spark, d):
    w = A.table(spark, d, "part").select((F.lit(1300.0) + F.col("p_partkey") * 7 % 11000).alias("wave")).distinct()
    return w.select("wave", F.round(dust_ratio(F.col("wave")), 9).alias("ratio"), F.round(dust_ratio(F.col("wave"), 2.5), 9).alias("ratio25"))


DEREDDEN = f", factors AS (SELECT A_V, band, 1 / (sum(trans * pow(10.0, -0.4::DOUBLE * A_V * ({dust_sql('wave')}))) / sum(trans)) AS factor FROM (SELECT DISTINCT A_V FROM catalog), bandpass GROUP BY A_V, band)"


@query(A.with_ctes("photometry catalog bandpass", f"{DEREDDEN} SELECT point_id, round(flux * coalesce(factor, 1), 6) AS flux, round(fluxerr * coalesce(factor, 1), 6) AS fluxerr FROM photometry JOIN catalog USING (object_id) LEFT JOIN factors USING (A_V, band)"))
def dereddened(spark, d):
    out = S.deredden(A.photometry(spark, d), A.catalog(spark, d), A.bandpass(spark))
    return rounded(out.select("point_id", "flux", "fluxerr"), "flux", "fluxerr")


@query(A.with_ctes("photometry", " SELECT point_id, round(sqrt(0.03 * flux * 0.03 * flux + e * e), 6) AS fluxerr FROM (SELECT point_id, flux, sqrt(pow(0.05 * avg(flux) OVER (PARTITION BY object_id), 2) + fluxerr * fluxerr) AS e FROM photometry)"))
def error_floor(spark, d):
    return rounded(L.error_floor(A.photometry(spark, d), 0.05, 0.03).select("point_id", "fluxerr"), "fluxerr")


@query(A.with_ctes("photometry", ", b AS (SELECT object_id, band, count(*) AS n FROM photometry GROUP BY 1, 2) SELECT object_id, count(*) AS nbr_bands, CAST(sum(n) AS BIGINT) AS ndet, count_if(n > 5)::BIGINT AS bands_over, string_agg(band || ':' || CAST(n AS VARCHAR), ',' ORDER BY band) AS lceval FROM b GROUP BY object_id HAVING count(*) >= 2"))
def band_counts(spark, d):
    """Points by band; objects with one band are left out."""
    b = L.band_counts(A.photometry(spark, d), "object_id").filter("nbr_bands >= 2")
    text = F.array_join(F.transform(F.map_entries("lceval"), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ",")
    return b.select("object_id", "nbr_bands", "ndet", "bands_over", text.alias("lceval"))


# A model that is a Gaussian bump in time, so that cuts and metrics have something to judge.
MODELED = """, m AS (SELECT point_id, object_id, band, time, flux, fluxerr, z, t0, (time - t0) / (1 + z) AS phase, 150.0 * exp(-0.5::DOUBLE * pow((time - t0) / 12.0, 2)) AS model_flux
    FROM photometry JOIN (SELECT object_id, CAST(redshift AS DOUBLE) AS z FROM catalog WHERE redshift <> '-') USING (object_id) JOIN (SELECT object_id, min(time) + 0.4::DOUBLE * (max(time) - min(time)) AS t0 FROM photometry GROUP BY 1) USING (object_id))"""


def modeled(spark, d):
    p = A.photometry(spark, d)
    z = T.numeric(T.without_missing(A.catalog(spark, d), "redshift"), "redshift").select("object_id", F.col("redshift").alias("z"))
    t0 = p.groupBy("object_id").agg((F.min("time") + 0.4 * (F.max("time") - F.min("time"))).alias("t0"))
    out = p.join(z, "object_id").join(t0, "object_id").withColumn("phase", L.phase())
    return out.withColumn("model_flux", F.lit(150.0) * F.exp(F.lit(-0.5) * F.pow((F.col("time") - F.col("t0")) / 12.0, F.lit(2.0))))


@query(A.with_ctes("photometry catalog", f"{MODELED}, c AS (SELECT *, phase > -20 AND phase < 100 AND phase > -15 AND phase < 60 AS a, abs((flux - model_flux) / fluxerr) < 10 AS b FROM m) SELECT object_id, count(*) AS dps_init, count_if(a)::BIGINT AS dps_tcut, count_if(b)::BIGINT AS dps_fcut, count_if(a AND b)::BIGINT AS dps_allcut FROM c GROUP BY object_id"))
def cut_accounting(spark, d):
    """Phase window and pull cut, counted over all points."""
    p = modeled(spark, d).withColumns({"min_phase": F.lit(-15.0), "max_phase": F.lit(60.0)})
    return L.cut_counts(L.with_pulls(p), "object_id")


COVERED = f"{MODELED}, k AS (SELECT *, t0 - 15.0 * (1 + z) AS t_start, t0 - 15.0 * (1 + z) + 60.0 AS t_end, time - t0 AS d FROM m), i AS (SELECT *, time BETWEEN t_start AND t_end AS inside FROM k)"


def with_span(spark, d):
    start = F.col("t0") - 15.0 * (1 + F.col("z"))
    return modeled(spark, d).withColumns({"t_start": start, "t_end": start + 60.0, "t_peak": F.col("t0")})


@query(A.with_ctes("photometry catalog", f"""{COVERED} SELECT object_id, count_if(time < t_start)::BIGINT AS premod, count_if(time > t_end)::BIGINT AS postmod, round(min(time - t_start), 6) AS predt, round(max(time - t_end), 6) AS postdt, count_if(inside)::BIGINT AS peakdet,
    count(DISTINCT band) FILTER (inside) AS peakbands, round(max(time) FILTER (inside) - min(time) FILTER (inside), 6) AS peakduration, count_if(inside AND d <= -3)::BIGINT AS earlydet, count_if(inside AND d > -3 AND d <= 3)::BIGINT AS thendet, count_if(inside AND d > 3 AND d <= 15)::BIGINT AS postdet,
    count_if(inside AND d >= 15 AND d <= 30)::BIGINT AS latedet, count_if(d BETWEEN -10 * (1 + z) AND 10 * (1 + z))::BIGINT AS verypeakcount, count(DISTINCT band) FILTER (d BETWEEN -10 * (1 + z) AND 10 * (1 + z)) AS verypeakbands FROM i GROUP BY object_id"""))
def coverage_metrics(spark, d):
    return rounded(L.coverage(with_span(spark, d), "object_id"), "predt", "postdt", "peakduration")


@query(A.with_ctes("photometry catalog", f"{COVERED} SELECT object_id, round(sum(pow(flux - model_flux, 2) / (pow(0.1::DOUBLE * flux, 2) + fluxerr * fluxerr)), 4) AS peakchi, round(sum(pow(flux - model_flux, 2) / (pow(0.1::DOUBLE * mean, 2) + fluxerr * fluxerr)), 4) AS peakchi_mean FROM (SELECT *, avg(flux) OVER (PARTITION BY object_id) AS mean FROM i WHERE inside) GROUP BY object_id"))
def peak_chi2(spark, d):
    p = with_span(spark, d)
    mean = L.peak_chi2(p, "object_id", of_mean=True).withColumnRenamed("peakchi", "peakchi_mean")
    return rounded(L.peak_chi2(p, "object_id").join(mean, "object_id"), "peakchi", "peakchi_mean", digits=4)


@query(A.with_ctes("photometry catalog", f"{MODELED} SELECT object_id, point_id, flux, round((flux - model_flux) / flux, 6) AS residual FROM (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY flux DESC, time, point_id) AS n FROM m) WHERE n = 1"))
def peak_point(spark, d):
    p = L.peak_point(modeled(spark, d), "object_id")
    return p.select("object_id", "point_id", "flux", F.round((F.col("flux") - F.col("model_flux")) / F.col("flux"), 6).alias("residual"))


def clip_sql(rounds: int = 3) -> str:
    out = ", c0 AS (SELECT *, true AS kept FROM photometry)"
    for i in range(rounds):
        out += f""", a{i} AS (SELECT *, quantile_cont(flux, 0.5) FILTER (kept) OVER w AS m, count_if(kept) OVER w AS n FROM c{i} WINDOW w AS (PARTITION BY object_id, band)),
        b{i} AS (SELECT *, 1.4826::DOUBLE * quantile_cont(abs(flux - m), 0.5) FILTER (kept) OVER (PARTITION BY object_id, band) AS s FROM a{i}),
        c{i + 1} AS (SELECT point_id, object_id, band, time, flux, fluxerr, zp, zpsys, CASE WHEN n < 3 THEN kept ELSE kept AND abs(flux - m) < greatest(3 * s, fluxerr) END AS kept FROM b{i})"""
    return out


@query(A.with_ctes("photometry", f"{clip_sql()} SELECT point_id, kept FROM c3"))
def sigma_clip(spark, d):
    return P.sigma_clip(A.photometry(spark, d)).select("point_id", "kept")


CURVE = f"""{clip_sql()}, g AS (SELECT object_id, band, min(time) FILTER (kept) AS t1, max(time) FILTER (kept) AS t2, (max(time) - min(time)) / 5 AS len, count_if(NOT kept)::BIGINT AS n_clipped, count_if(kept)::BIGINT AS n_count FROM c3 GROUP BY 1, 2),
    e AS (SELECT *, t1 + (t2 - t1) * i / {N_GRID - 1} AS t FROM g, (SELECT unnest(range(0, {N_GRID})) AS i) WHERE n_count >= 2),
    w AS (SELECT e.object_id, e.band, i, t, exp(-0.5::DOUBLE * pow((t - time) / len, 2)) AS w, flux FROM e JOIN c3 ON c3.object_id = e.object_id AND c3.band = e.band AND kept),
    s AS (SELECT object_id, band, i, t, CASE WHEN sum(w) > 1e-12 THEN sum(w * flux) / sum(w) END AS smooth FROM w GROUP BY ALL)"""


@query(A.with_ctes("photometry", f"{CURVE} SELECT object_id, band, i::INTEGER AS i, round(smooth, 6) AS smooth FROM s"))
def smooth_curve(spark, d):
    points = P.spans(P.sigma_clip(A.photometry(spark, d)))
    return rounded(P.smoothed(points, N_GRID).select("object_id", "band", "i", "smooth"), "smooth")


PEAK = f"""{CURVE}, p AS (SELECT object_id, band, t AS peak_time, smooth AS peak_flux FROM (SELECT *, row_number() OVER (PARTITION BY object_id, band ORDER BY round(smooth, 9) DESC, i) AS n FROM s WHERE smooth IS NOT NULL) WHERE n = 1),
    q AS (SELECT p.object_id, p.band, peak_time, peak_flux, count_if(time < peak_time)::INTEGER AS n_before_peak, count_if(time > peak_time)::INTEGER AS n_after_peak, coalesce(sum(exp(-0.5::DOUBLE * pow((time - peak_time) / len, 2))) FILTER (time < peak_time), 0) AS n_eff_before_peak,
    coalesce(sum(exp(-0.5::DOUBLE * pow((time - peak_time) / len, 2))) FILTER (time > peak_time), 0) AS n_eff_after_peak FROM p JOIN c3 ON c3.object_id = p.object_id AND c3.band = p.band AND kept JOIN g ON g.object_id = p.object_id AND g.band = p.band GROUP BY ALL)"""
PEAK_COLUMNS = "object_id, band, n_clipped, n_count, round(peak_flux, 6) AS peak_flux, round(peak_time, 6) AS peak_time, n_before_peak, n_after_peak, round(n_eff_before_peak, 5) AS n_eff_before_peak, round(n_eff_after_peak, 5) AS n_eff_after_peak"


def peaks(spark, d, method):
    return P.peak_flux(A.photometry(spark, d), method, n_grid=N_GRID)


def shown(p):
    p = rounded(rounded(p, "peak_flux", "peak_time"), "n_eff_before_peak", "n_eff_after_peak", digits=5)
    return p.select("object_id", "band", "n_clipped", "n_count", "peak_flux", "peak_time", "n_before_peak", "n_after_peak", "n_eff_before_peak", "n_eff_after_peak")


@query(A.with_ctes("photometry", f"{PEAK} SELECT {PEAK_COLUMNS} FROM g LEFT JOIN q USING (object_id, band)"))
def peak_flux_twa(spark, d):
    return shown(peaks(spark, d, "twa"))


@query(A.with_ctes("photometry", f"{PEAK}, h AS (SELECT object_id, band, quantile_cont(smooth, 0.95) AS cut FROM s GROUP BY 1, 2), j AS (SELECT s.object_id, s.band, quantile_cont(smooth, 0.5) AS top FROM s JOIN h USING (object_id, band) WHERE smooth >= cut GROUP BY 1, 2) SELECT object_id, band, round(top, 6) AS peak_flux, round(peak_time, 6) AS peak_time FROM j JOIN p USING (object_id, band)"))
def peak_flux_top5(spark, d):
    return rounded(peaks(spark, d, "top5").filter("peak_flux is not null").select("object_id", "band", "peak_flux", "peak_time"), "peak_flux", "peak_time")


@query()
def peak_flux_gp(spark, d):
    """Exact Gaussian process for each object and band (dense solves in Arrow batches)."""
    p = P.peak_flux(A.photometry(spark, d), "gp", n_grid=N_GRID)
    return rounded(shown(p), "peak_flux", "peak_time", digits=4)


@query(A.with_ctes("photometry", f"{PEAK}, f AS (SELECT * FROM g LEFT JOIN q USING (object_id, band)) SELECT a.object_id, a.band || '-' || b.band AS pair, round(-2.5::DOUBLE * log10(a.peak_flux / b.peak_flux), 5) AS color, round(a.peak_time - b.peak_time, 5) AS dt, round(a.n_eff_before_peak + b.n_eff_before_peak, 5) AS presum, round(a.n_eff_after_peak + b.n_eff_after_peak, 5) AS postsum, a.n_eff_before_peak < 1 OR a.n_eff_after_peak < 1 OR b.n_eff_before_peak < 1 OR b.n_eff_after_peak < 1 AS warning FROM f a JOIN f b ON a.object_id = b.object_id AND (a.band = 'ztfg' AND b.band = 'ztfr' OR a.band = 'ztfr' AND b.band = 'ztfi')"))
def peak_colors(spark, d):
    """Colours at peak, the flagship: clip, smooth, find peaks, pair the bands."""
    c = P.peak_colors(peaks(spark, d, "twa"))
    return rounded(c.select("object_id", "pair", "color", "dt", "presum", "postsum", "warning"), "color", "dt", "presum", "postsum", digits=5)


@query(A.with_ctes("photometry catalog", f"{PEAK}, f AS (SELECT g.object_id, g.band, peak_flux, n_eff_before_peak, n_eff_after_peak FROM g LEFT JOIN q USING (object_id, band)), c AS (SELECT a.object_id, -2.5::DOUBLE * log10(a.peak_flux / b.peak_flux) AS g_r, a.n_eff_before_peak + b.n_eff_before_peak AS presum, a.n_eff_after_peak + b.n_eff_after_peak AS postsum FROM f a JOIN f b ON a.object_id = b.object_id AND a.band = 'ztfg' AND b.band = 'ztfr'), n AS (SELECT object_id, count(*) AS ndet, count(DISTINCT band) AS nb FROM photometry GROUP BY 1), k AS (SELECT object_id, CASE WHEN object_id % 10 = 0 THEN 1 WHEN coalesce(ndet, 0) = 0 THEN 2 WHEN nb < 2 THEN 3 WHEN g_r IS NULL THEN 4 WHEN presum < 2 OR postsum < 2 THEN 5 ELSE 0 END AS code FROM catalog LEFT JOIN n USING (object_id) LEFT JOIN c USING (object_id)) SELECT code, count(*) AS n FROM k GROUP BY code"))
def fail_codes(spark, d):
    """Why objects can't be fitted, counted (every tenth object is on the reject list)."""
    p = A.photometry(spark, d)
    c = P.peak_colors(peaks(spark, d, "twa"), (("ztfg", "ztfr"),)).select("object_id", F.col("color").alias("g_r"), "presum", "postsum")
    n = p.groupBy("object_id").agg(F.count("*").alias("ndet"), F.count_distinct("band").alias("nbr_bands"))
    rows = A.catalog(spark, d).select("object_id", (F.col("object_id") % 10 == 0).alias("rejected")).join(n, "object_id", "left").join(c, "object_id", "left")
    return rows.select(L.fail_code().alias("code")).groupBy("code").agg(F.count("*").alias("n"))
