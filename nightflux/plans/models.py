"""Queries on template spectra, fits and corrections."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from nightflux.functions.astro import DISTMOD_CTE, distmod_sql, dust_sql
from nightflux.operators import correction as K
from nightflux.operators import fit as G
from nightflux.operators import photometry as L
from nightflux.operators import synphot as S
from nightflux.operators import taxonomy as T
from nightflux.operators import warpset as W
from nightflux.operators.selection import best_per
from nightflux.sources import adapters as A

from .light_curves import MODELED, modeled
from .registry import query, rounded, shared_folder

EBV = G.EBV_NODES


def checkpoints(spark) -> None:
    """The cluster's shared folder for checkpoints; a new one only where none is set, as in tests."""
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


BANDS = "('ztfg', 'ztfr', 'ztfi')"


def flux_sql(source: str = "template_flux", zs: str = "SELECT DISTINCT TRY_CAST(redshift AS DOUBLE) AS z FROM catalog WHERE redshift <> '-'", ebv=EBV, name: str = "bf", keys: str = "template", bands: str = "bandpass") -> str:
    es = ", ".join(f"{e!r}::DOUBLE" for e in ebv)
    return f""", {name}_n AS (SELECT *, lead(flux) OVER (PARTITION BY {keys}, phase ORDER BY wave) AS nx, CAST(round((wave - 3000) / 100) AS INTEGER) AS node FROM {source}),
    {name}_r AS (SELECT band, trans, z, ebv, wave AS seen, wave / (1 + z) AS rest FROM {bands}, ({zs}), (SELECT unnest([{es}]) AS ebv)),
    {name}_l AS (SELECT *, CAST(floor((rest - 3000) / 100) AS INTEGER) AS node, (rest - 3000) / 100 - floor((rest - 3000) / 100) AS part, pow(10.0, -0.4::DOUBLE * (ebv * 3.1::DOUBLE) * ({dust_sql('rest')})) AS dust FROM {name}_r),
    {name}_a AS (SELECT band, sum({S.AB!r} * {S.LIGHT_A!r} / (wave * wave) * wave * trans * 100) AS ab FROM {bands} GROUP BY band),
    {name} AS (SELECT {keys}, z, ebv, l.band, phase, sum((flux + part * (coalesce(nx, flux) - flux)) / (1 + z) * dust * trans * seen * 100) / max(ab) * 1e10 AS flux FROM {name}_n n JOIN {name}_l l ON n.node = l.node JOIN {name}_a a ON a.band = l.band GROUP BY {keys}, z, ebv, l.band, phase)"""


def redshifts(spark, d):
    cat = T.numeric(T.without_missing(A.catalog(spark, d), "redshift"), "redshift")
    return cat.select("object_id", F.col("redshift").alias("z"))


def fluxes(spark, d, ebv=None):
    return S.band_flux(A.template_flux(spark), A.bandpass(spark), G.shifts(spark, redshifts(spark, d), ebv))


def rest_fluxes(spark, ebv=(0.0,), bands=A.bandpass):
    zero = spark.range(1).select(F.lit(0.0).alias("z"))
    return S.band_flux(A.template_flux(spark), bands(spark), G.shifts(spark, zero, ebv))


REST = flux_sql(zs="SELECT 0.0::DOUBLE AS z", ebv=[0.0])


@query(A.with_ctes("catalog template_flux bandpass", f"{flux_sql()} SELECT template, z, ebv, band, phase, round(flux / 1e18, 7) AS flux FROM bf"))
def band_flux(spark, d):
    return fluxes(spark, d).select("template", "z", "ebv", "band", "phase", F.round(F.col("flux") / 1e18, 7).alias("flux"))


ZS = ", zn AS (SELECT CAST(redshift AS DOUBLE) AS z, count(*) AS objects FROM catalog WHERE redshift <> '-' GROUP BY 1)"


def objects_at(spark, d):
    """z, objects: how many objects are at each redshift."""
    return redshifts(spark, d).groupBy("z").agg(F.count("*").alias("objects"))


@query(A.with_ctes("catalog template_flux bandpass", f"{flux_sql(ebv=[0.0])}{ZS}, p AS (SELECT z, template, band, phase AS peak_phase, flux FROM (SELECT *, row_number() OVER (PARTITION BY z, template, band ORDER BY round(flux, 6) DESC, phase) AS n FROM bf) WHERE n = 1) SELECT z, template, band, peak_phase, round(flux / 1e18, 7) AS peak_flux, round(avg(peak_phase) FILTER (band IN ('ztfg', 'ztfr')) OVER (PARTITION BY z, template), 6) AS avg_phase, objects FROM p JOIN zn USING (z)"))
def template_peak_phases(spark, d):
    """Peak of each template by band as seen at each redshift of the catalogue, and the mean of g and r."""
    p = S.peak_phases(fluxes(spark, d, [0.0]), "z", "template")
    avg = F.avg(F.when(F.col("band").isin("ztfg", "ztfr"), F.col("peak_phase"))).over(Window.partitionBy("z", "template"))
    return p.join(objects_at(spark, d), "z").select("z", "template", "band", "peak_phase", F.round(F.col("peak_flux") / 1e18, 7).alias("peak_flux"), F.round(avg, 6).alias("avg_phase"), "objects")


POINTS = f", pts AS (SELECT point_id, object_id, z, band, time, flux, fluxerr FROM photometry JOIN (SELECT object_id, CAST(redshift AS DOUBLE) AS z FROM catalog WHERE redshift <> '-') USING (object_id) WHERE band IN {BANDS})"
NODES = ", nd AS (SELECT template, z, ebv, band, CAST(round((phase + 20) / 2) AS INTEGER) AS node, flux AS nf, lead(flux) OVER (PARTITION BY template, z, ebv, band ORDER BY phase) AS nn FROM bf)"


def points(spark, d):
    return A.photometry(spark, d).filter(F.col("band").isin("ztfg", "ztfr", "ztfi")).join(redshifts(spark, d), "object_id")


def nodes(spark, d, ebv=None):
    return S.phase_nodes(fluxes(spark, d, ebv), "template", "z", "ebv", "band")


def nodes_at(spark):
    """shifts -> the nodes of all templates there."""
    return lambda shifts: S.phase_nodes(S.band_flux(A.template_flux(spark), A.bandpass(spark), shifts), "template", "z", "ebv", "band")


@query(A.with_ctes("photometry catalog template_flux bandpass", f"{flux_sql(ebv=[0.2])}{NODES}{POINTS}, q AS (SELECT pts.*, ('tpl-' || CAST(object_id % 4 AS VARCHAR)) AS template, 0.2::DOUBLE AS ebv, (time - (min(time) OVER (PARTITION BY object_id) + 10)) / (1 + z) AS phase FROM pts), r AS (SELECT *, CAST(floor((phase + 20) / 2) AS INTEGER) AS node, (phase + 20) / 2 - floor((phase + 20) / 2) AS part FROM q) SELECT point_id, template, round(coalesce(nf + part * (coalesce(nn, CASE WHEN part = 0 THEN nf END) - nf), 0) / 1e18, 7) AS model_flux FROM r LEFT JOIN nd USING (template, z, ebv, band, node)"))
def model_flux(spark, d):
    """Model flux at each observation, by an equi-join on the phase node."""
    p = points(spark, d).withColumns({"template": F.concat(F.lit("tpl-"), (F.col("object_id") % 4).cast("string")), "ebv": F.lit(0.2), "t0": F.min("time").over(Window.partitionBy("object_id")) + 10}).withColumn("phase", L.phase())
    out = S.at_phase(p, nodes(spark, d, [0.2]), "template", "z", "ebv", "band")
    return out.select("point_id", "template", F.round(F.col("model_flux") / 1e18, 7).alias("model_flux"))


FITTED = f"""{flux_sql()}{NODES}{POINTS}, span AS (SELECT object_id, min(time) AS t_min, max(time) AS t_max, sum(flux * flux / (fluxerr * fluxerr)) AS sff, count(*) AS n FROM pts GROUP BY 1),
    t0s AS (SELECT object_id, k, t_min - 5 + (t_max + 5 - (t_min - 5)) * k / 14 AS t0 FROM span, (SELECT unnest(range(0, 15)) AS k)),
    rr AS (SELECT object_id, z, band, flux, fluxerr, k, t0, ((time - t0) / (1 + z) + 20) / 2 AS x FROM pts JOIN t0s USING (object_id)),
    mm AS (SELECT object_id, template, k, t0, ebv, flux, fluxerr, nf + (x - floor(x)) * (coalesce(nn, CASE WHEN x = floor(x) THEN nf END, 0) - nf) AS m FROM rr JOIN nd ON rr.z = nd.z AND rr.band = nd.band AND nd.node = CAST(floor(x) AS INTEGER)),
    ss AS (SELECT object_id, template, k, t0, ebv, sum(flux * m / (fluxerr * fluxerr)) AS sfm, sum(m * m / (fluxerr * fluxerr)) AS smm FROM mm GROUP BY ALL),
    ff AS (SELECT *, sfm / smm AS amplitude, sff - sfm / smm * sfm AS chisq FROM ss JOIN span USING (object_id) WHERE smm > 0),
    fit AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY object_id, template ORDER BY round(chisq, 4), k, ebv) AS nth FROM ff WHERE amplitude > 0) WHERE nth = 1)"""


@query(A.with_ctes("photometry catalog template_flux bandpass", f"{FITTED} SELECT object_id, template, k::INTEGER AS t0_node, ebv, round(log10(amplitude), 7) AS log_amplitude, round(chisq, 3) AS chisq, (n - 3)::INTEGER AS ndof FROM fit"))
def grid_fit(spark, d):
    """Every object against every template: the best of all times of peak and dust nodes."""
    f = G.full_fit(points(spark, d), nodes_at(spark), rounds=0)
    return f.select("object_id", "template", "t0_node", "ebv", F.round(F.log10("amplitude"), 7).alias("log_amplitude"), F.round("chisq", 3).alias("chisq"), "ndof")


@query(A.with_ctes("photometry catalog template_flux bandpass", f"{FITTED}, b AS (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY round(chisq / (n - 3), 6), template) AS o FROM fit WHERE n > 3), sig AS (SELECT object_id, count_if(abs(flux) / fluxerr >= 3) AS ns FROM pts GROUP BY 1) SELECT object_id, template, round(chisq / (n - 3), 4) AS chidof FROM b JOIN sig USING (object_id) WHERE o = 1 AND n - 3 >= ns - 3"))
def best_model(spark, d):
    """The best template of each object whose fit uses all significant points."""
    p = points(spark, d)
    f = G.full_fit(p, nodes_at(spark), rounds=0).filter("ndof > 0").withColumn("chidof", F.col("chisq") / F.col("ndof"))
    sig = p.groupBy("object_id").agg(F.count_if(F.abs("flux") / F.col("fluxerr") >= 3).alias("n_significant"))
    best = best_per(f, ["object_id"], F.round("chidof", 6), "template").join(sig, "object_id")
    return best.filter("ndof >= n_significant - 3").select("object_id", "template", F.round("chidof", 4).alias("chidof"))


BF0 = flux_sql(zs="SELECT 0.0::DOUBLE AS z", ebv=[0.0], name="bf0", bands="rest_bands")


@query(A.with_ctes("photometry catalog template_flux bandpass rest_bands", f"{FITTED}{BF0}, {DISTMOD_CTE}, rp AS (SELECT template, max(flux) AS rest FROM bf0 WHERE band = 'bessellb' GROUP BY 1) SELECT object_id, template, round(-2.5::DOUBLE * log10(amplitude * rest) + 25 - {distmod_sql('z')}, 4) AS absmag FROM fit JOIN (SELECT DISTINCT object_id, z FROM pts) USING (object_id) JOIN rp USING (template)"))
def peak_absmag(spark, d):
    """Absolute magnitude of each fitted template at its rest-frame peak."""
    f = G.full_fit(points(spark, d), nodes_at(spark), rounds=0)
    out = S.peak_absmag(f, S.peak_phases(rest_fluxes(spark, bands=A.rest_bands), "template"))
    return rounded(out.select("object_id", "template", "absmag"), "absmag", digits=4)


def round_sql(before: str, r: int) -> str:
    """The r-th finer round after the fits in before, as fit{r}."""
    step = (EBV[1] - EBV[0]) / G.PARTS**r
    lattice = [EBV[0] + step * i for i in range(round((EBV[-1] - EBV[0]) / step) + 1)]
    near = f"(SELECT unnest(range({1 - G.PARTS}, {G.PARTS})) AS"
    share = 1.0 / ((G.T0_NODES - 1) * G.PARTS**r)
    return f"""{flux_sql(ebv=lattice, name=f'bf_{r}')}{NODES.replace(' nd AS', f' nd_{r} AS').replace('FROM bf)', f'FROM bf_{r})')},
    tr_{r} AS (SELECT object_id, template, k, t0 + k * (((t_max + 5) - (t_min - 5)) * {share!r}::DOUBLE) AS t0, ebv + j * {step!r}::DOUBLE AS ebv, t_min, t_max, sff, n FROM (SELECT * EXCLUDE (k) FROM {before}), {near} k), {near} j)),
    rr_{r} AS (SELECT object_id, template, z, band, flux, fluxerr, k, t0, ebv, ((time - t0) / (1 + z) + 20) / 2 AS x FROM pts JOIN tr_{r} USING (object_id) WHERE t0 >= t_min - 5 - 1e-6 AND t0 <= t_max + 5 + 1e-6 AND ebv BETWEEN {EBV[0]} AND {EBV[-1]}),
    mm_{r} AS (SELECT object_id, rr.template, k, t0, rr.ebv, flux, fluxerr, nf + (x - floor(x)) * (coalesce(nn, CASE WHEN x = floor(x) THEN nf END, 0) - nf) AS m FROM rr_{r} rr JOIN nd_{r} nd ON rr.template = nd.template AND rr.ebv = nd.ebv AND rr.z = nd.z AND rr.band = nd.band AND nd.node = CAST(floor(x) AS INTEGER)),
    ss_{r} AS (SELECT object_id, template, k, t0, ebv, sum(flux * m / (fluxerr * fluxerr)) AS sfm, sum(m * m / (fluxerr * fluxerr)) AS smm FROM mm_{r} GROUP BY ALL),
    ff_{r} AS (SELECT *, sfm / smm AS amplitude, sff - sfm / smm * sfm AS chisq FROM ss_{r} JOIN span USING (object_id) WHERE smm > 0),
    fit{r} AS (SELECT * EXCLUDE (nth) FROM (SELECT *, row_number() OVER (PARTITION BY object_id, template ORDER BY round(chisq, 4), k, ebv) AS nth FROM ff_{r} WHERE amplitude > 0) WHERE nth = 1)"""


REFINED = f"{FITTED}{round_sql('fit', 1)}{round_sql('fit1', 2)}"


@query(A.with_ctes("photometry catalog template_flux bandpass", f"{REFINED} SELECT object_id, template, round(c.chisq, 3) AS coarse, round(f.chisq, 3) AS chisq, round(f.t0, 5) AS t0, f.ebv FROM fit2 f JOIN (SELECT object_id, template, chisq FROM fit) c USING (object_id, template)"))
def refined_fit(spark, d):
    """The coarse fit and two finer rounds of times and dust around it."""
    checkpoints(spark)
    f = G.full_fit(points(spark, d), nodes_at(spark))
    return f.select("object_id", "template", F.round("coarse", 3).alias("coarse"), F.round("chisq", 3).alias("chisq"), F.round("t0", 5).alias("t0"), "ebv")


@query()
def fit_metrics(spark, d):
    """One record for each pair: fit, coverage, counts around the peak, chi2 and residual there."""
    checkpoints(spark)
    p = points(spark, d)
    fits = G.full_fit(p, nodes_at(spark)).checkpoint()
    m = G.fit_metrics(p, fits, G.nodes_of(fits, nodes_at(spark)))
    return rounded(m.drop("t0", "amplitude"), "chisq", "predt", "postdt", "peakduration", "peakchi", "peak_residual", digits=4)


@query()
def clean_refit(spark, d):
    """Fit, cut in phase, fit, cut in pull, fit; counts and success of each pair."""
    checkpoints(spark)
    out = G.clean_refit(floored(spark, d), nodes_at(spark))
    return rounded(out.select("object_id", "template", "ebv", "t0", "chisq", "ndof", "dps_init", "dps_tcut", "dps_fcut", "dps_allcut", "success"), "chisq", "t0", digits=3)


def floored(spark, d):
    """Points with the error floor before corrections; the tables' fluxes scatter by far more than their errors, so the mean."""
    return L.error_floor(points(spark, d), 1.0)


WAVE_EFF = ", we AS (SELECT band, sum(wave * trans) / sum(trans) AS wave_eff FROM bandpass GROUP BY band)"
RATIOS = f"{MODELED}{WAVE_EFF}, cp AS (SELECT point_id, object_id, 'tpl-0' AS template, m.band, phase, flux / model_flux AS frac, fluxerr AS err, wave_eff / (1 + z) AS wave FROM m JOIN we USING (band) WHERE model_flux > 1e-3 AND isfinite(flux / model_flux))"


def ratio_points(spark, d):
    p = modeled(spark, d).filter("model_flux > 1e-3").withColumn("template", F.lit("tpl-0"))
    return K.correction_points(p, S.ab_scale(A.bandpass(spark)).select("band", "wave_eff"))


@query(A.with_ctes("photometry catalog bandpass", f"{RATIOS} SELECT object_id, band, round(phase, 6) AS phase, round(frac, 6) AS frac, round(err, 6) AS err, round(wave, 5) AS wave FROM cp"))
def correction_points(spark, d):
    p = rounded(ratio_points(spark, d), "phase", "frac", "err")
    return rounded(p.select("object_id", "band", "phase", "frac", "err", "wave"), "wave", digits=5)


@query(A.with_ctes("photometry catalog bandpass", f"""{RATIOS}, en AS (SELECT object_id, band, min(phase) AS lo, max(phase) AS hi, arg_min(err, {{'p': phase, 'e': err}}) AS e_lo, arg_max(err, {{'p': phase, 'e': err}}) AS e_hi FROM cp GROUP BY 1, 2),
    nn AS (SELECT *, greatest(ceil((lo + 20) / 3), 1)::INTEGER AS n1, ceil((80 - (hi + 3)) / 3)::INTEGER AS n2 FROM en),
    pre AS (SELECT object_id, band, -20.0 + i * 3.0 AS phase, CASE WHEN n1 > 1 THEN 0.01::DOUBLE + (e_lo - 0.01::DOUBLE) * i / (n1 - 1) ELSE 0.01::DOUBLE END AS err FROM (SELECT *, unnest(range(0, n1)) AS i FROM nn WHERE lo >= -20)),
    post AS (SELECT object_id, band, CASE WHEN n2 > 0 THEN hi + 3 + i * 3.0 ELSE 80.0 END AS phase, CASE WHEN n2 > 1 THEN e_hi + (0.01::DOUBLE - e_hi) * i / (n2 - 1) ELSE e_hi END AS err FROM (SELECT *, unnest(range(0, greatest(n2, 1))) AS i FROM nn WHERE hi <= 80))
    SELECT object_id, band, count(*) AS n, round(sum(phase), 7) AS phases, round(sum(err), 7) AS errs FROM (SELECT object_id, band, phase, err FROM cp UNION ALL SELECT * FROM pre UNION ALL SELECT * FROM post) GROUP BY 1, 2"""))
def edge_buffers(spark, d):
    """Correction points with factors of 1 before and after the data; counts and sums by object and band."""
    p = K.with_edges(ratio_points(spark, d), -20.0, 80.0)
    return p.groupBy("object_id", "band").agg(F.count("*").alias("n"), F.round(F.sum("phase"), 7).alias("phases"), F.round(F.sum("err"), 7).alias("errs"))


def curves(spark, d):
    return K.correction_curves(K.with_edges(ratio_points(spark, d), -20.0, 80.0), [float(p) for p in range(-20, 81, 2)])


@query()
def correction_curves(spark, d):
    """Penalised cubic spline of each object and band (dense solves in Arrow batches)."""
    return rounded(curves(spark, d), "tcorr", "terr", "wave", digits=4)


@query()
def correction_surface(spark, d):
    """Smoothed factors on the grid of phase and wavelength, for objects with at least two bands."""
    s = K.surface(curves(spark, d), 3000.0, 9000.0)
    return s.groupBy("object_id", "template").agg(F.count("*").alias("cells"), F.count_distinct("wave").alias("waves"), F.round(F.sum("factor"), 2).alias("total"))


SURFACE = f""", bd AS (SELECT object_id, band, min(wave) AS wave, round(avg(frac), 6) AS factor FROM cp WHERE band IN {BANDS} GROUP BY 1, 2), ok AS (SELECT object_id FROM bd GROUP BY 1 HAVING count(*) >= 2)"""


@query(A.with_ctes("photometry catalog bandpass", f"{RATIOS}{SURFACE} SELECT object_id, phase, round(wave, 5) AS wave, factor FROM (SELECT object_id, p::DOUBLE AS phase, wave, factor FROM bd, (SELECT unnest([-20, 0, 20]) AS p) UNION ALL SELECT object_id, p::DOUBLE, w::DOUBLE, 1.0 FROM ok, (SELECT unnest([-20, 0, 20]) AS p), (SELECT unnest([3000, 9000]) AS w)) WHERE object_id IN (SELECT object_id FROM ok)"))
def assembled_surface(spark, d):
    """Surface from flat curves (the mean ratio of each band), on three phases."""
    flat = ratio_points(spark, d).groupBy("object_id", "template", "band").agg(F.min("wave").alias("wave"), F.round(F.avg("frac"), 6).alias("tcorr")).withColumn("tphase", F.explode(F.array(F.lit(-20.0), F.lit(0.0), F.lit(20.0))))
    return rounded(K.surface(flat, 3000.0, 9000.0).select("object_id", "phase", "wave", "factor"), "wave", digits=5)


def cubic_sql(waves: list, x: str) -> str:
    w = (np.array(waves) - waves[2]) / 1000.0
    inverse = np.linalg.inv(np.column_stack([w**0, w, w**2, w**3, np.maximum(w, 0) ** 3]))
    u = f"(({x} - {waves[2]}) / 1000.0::DOUBLE)"
    powers = ["1.0", u, f"{u} * {u}", f"{u} * {u} * {u}", f"CASE WHEN {u} > 0 THEN {u} * {u} * {u} ELSE 0 END"]
    return " + ".join("(" + " + ".join(f"f{i} * ({float(inverse[k, i])!r})::DOUBLE" for i in range(5)) + f") * ({p})" for k, p in enumerate(powers))


WIDE = ", wide AS (SELECT phase, " + ", ".join(f"max(factor) FILTER (wave = {w}) AS f{i}" for i, w in enumerate(A.SURFACE_WAVES)) + " FROM corr_surface GROUP BY phase)"
WARPED = f"{WIDE}, warped AS (SELECT template, phase, wave, {cubic_sql(A.SURFACE_WAVES, 'wave')} AS factor, greatest(flux * ({cubic_sql(A.SURFACE_WAVES, 'wave')}), 0) AS flux FROM template_flux JOIN wide USING (phase))"


def warped(spark):
    return S.warped(A.template_flux(spark), A.corr_surface(spark), [float(w) for w in A.SURFACE_WAVES])


@query(A.with_ctes("catalog template_flux corr_surface", f"{WARPED}{ZS} SELECT template, z, phase, round(wave * (1 + z), 5) AS seen_wave, round(factor, 7) AS factor, round(flux / (1 + z), 7) AS flux, objects FROM warped, zn"))
def warped_spectra(spark, d):
    """Warped spectra as seen at each redshift of the catalogue."""
    seen = warped(spark).join(F.broadcast(objects_at(spark, d)))  # a row for each redshift, rounded to few
    out = seen.select("template", "z", "phase", F.round(F.col("wave") * (1 + F.col("z")), 5).alias("seen_wave"), "factor", (F.col("flux") / (1 + F.col("z"))).alias("flux"), "objects")
    return rounded(out, "factor", "flux", digits=7)


@query(A.with_ctes("catalog template_flux corr_surface bandpass", f"{WARPED}{flux_sql('warped', ebv=[0.0, 0.3])} SELECT template, z, ebv, band, phase, round(flux / 1e18, 7) AS flux FROM bf"))
def warped_band_flux(spark, d):
    """The warped model at each redshift, with host dust."""
    f = S.band_flux(warped(spark), A.bandpass(spark), G.shifts(spark, redshifts(spark, d), [0.0, 0.3]))
    return f.select("template", "z", "ebv", "band", "phase", F.round(F.col("flux") / 1e18, 7).alias("flux"))


PHASES = [float(p) for p in range(-20, 81, 2)]


def corrected(spark, points, pairs=None):
    """Fits of clean_points and the correction surfaces of those that succeed, both written once."""
    checkpoints(spark)
    fits, good = G.clean_points(points, nodes_at(spark), pairs=pairs)
    good = good.join(fits.filter("success").select("object_id", "template"), ["object_id", "template"], "left_semi")
    ratios = K.correction_points(good, S.ab_scale(A.bandpass(spark)).select("band", "wave_eff"))
    curves = K.correction_curves(K.with_edges(ratios, PHASES[0], PHASES[-1]), PHASES)
    return fits, K.surface(curves, float(A.WAVES[0]), float(A.WAVES[1])).checkpoint()


def matches(spark, d, p):
    """The fits of the tables as matches of templates and the objects of p, which are known before any fit is dealt."""
    own = p.select(F.col("object_id").alias("id")).distinct()
    f = A.fits(spark, d).join(F.broadcast(own), "id", "left_semi").filter("success and peak_good")
    model = F.concat(F.lit("tpl-"), (F.substring_index("model", "-", -1).cast("int") % A.TEMPLATES).cast("string"))
    return f.groupBy(F.col("id").alias("object_id"), model.alias("template")).agg(F.min("chidof").alias("match_chidof"), F.max("nbr_bands").alias("nbr_bands"), F.max("peakdet").alias("peakdet"))


@query()
def bulk_corrections(spark, d):
    """Corrections of all matched pairs that succeed: the eight fields that later steps need, the surface as JSON."""
    p = floored(spark, d)
    fits, surface = corrected(spark, p, matches(spark, d, p))
    out = K.bulk(S.peak_absmag(fits, S.peak_phases(rest_fluxes(spark, bands=A.rest_bands), "template")), surface)
    text = F.array_join(F.transform(F.map_entries("lceval"), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ",")
    cells = F.to_json(F.transform("corrmodel", lambda c: F.struct(c.phase, F.round(c.wave, 3).alias("wave"), F.round(c.factor, 4).alias("factor"))))
    return rounded(out.withColumns({"lceval": text, "corrmodel": cells}), "absmag", "chidof", digits=4)


def reworked(spark, d):
    """Fits of warped models, one for each matched pair whose correction succeeds, with what the rules of a warp set judge."""
    p = floored(spark, d)
    match = matches(spark, d, p)
    fits, surface = corrected(spark, p, match)
    again = G.refit_warped(p, fits.filter("success"), A.template_flux(spark), surface, A.bandpass(spark)).checkpoint()
    kinds = T.add_classes(A.catalog(spark, d)).select("object_id", F.col("type_a").alias("class"), "peakmag")
    own = A.template_flux(spark).select("template", F.col("class").alias("model_class")).distinct()
    out = again.join(match, ["object_id", "template"]).join(kinds, "object_id").join(F.broadcast(own), "template")  # a row for each template
    return out.select(
        F.col("object_id").alias("id"), F.col("template").alias("model"), "class", "z", "peakmag", T.true_for("model_class", "class").alias("correct"), (F.col("match_chidof") < 6).alias("goodfit"),
        F.col("match_chidof").alias("chidof"), "nbr_bands", "peakdet", "sf", "t0", "ebv", "chisq", "ndof",
    )


@query()
def built_warp_set(spark, d):
    """The whole chain: matches, error floor, cleaned fits, surfaces, warped models, their fits, acceptance, survival, the set."""
    w = W.warp_set(reworked(spark, d))
    return rounded(w.select("id", "model", "class", "quality", "priority", "chidof", "sf", "draw_prob", "t0", "ebv"), "chidof", "sf", "draw_prob", "t0", digits=5)


@query()
def built_warp_set_simple(spark, d):
    """The same chain under the older rule: true classes with enough points, those likely enough or the best three."""
    w = W.warp_set_simple(reworked(spark, d))
    return rounded(w.select("id", "model", "class", "good_fit", "chidof", "sf", "draw_prob", "t0", "ebv"), "chidof", "sf", "draw_prob", "t0", digits=5)
