"""Queries on seeded fits: the fit of each pair, and its whole record."""

from __future__ import annotations

from pyspark.sql import functions as F

from nightflux.operators import fit as Fit
from nightflux.operators import photometry as L
from nightflux.operators import peaks as P
from nightflux.operators import search as G
from nightflux.operators import selection as S
from nightflux.operators import synphot as Syn
from nightflux.sources import adapters as A

from .light_curves import N_GRID, PEAK
from .models import EBV, NODES, POINTS, checkpoints, flux_sql, nodes_at, points, redshifts, rest_fluxes
from .registry import query, rounded

STARTS, ROUNDS = 3, 2


def tried_sql(source: str, name: str, nodes: str, extra: str) -> str:
    """name: chisq and amplitude of source(object_id, template, extra, k, t0, and ebv where it is given) point by point."""
    return f""", {name}_x AS (SELECT s.*, p.z, p.band, p.flux, p.fluxerr, ((p.time - s.t0) / (1 + p.z) + 20) / 2 AS x FROM {source} s JOIN pts p USING (object_id)),
    {name}_m AS (SELECT x.object_id, x.template, {extra} x.k, x.t0, nd.ebv, flux, fluxerr, nf + (x - floor(x)) * (coalesce(nn, CASE WHEN x = floor(x) THEN nf END, 0) - nf) AS m FROM {name}_x x JOIN {nodes} nd ON nd.template = x.template AND nd.z = x.z AND nd.band = x.band AND nd.node = CAST(floor(x) AS INTEGER){' AND nd.ebv = x.ebv' if extra else ''}),
    {name}_s AS (SELECT object_id, template, {extra} k, t0, ebv, sum(flux * m / (fluxerr * fluxerr)) AS sfm, sum(m * m / (fluxerr * fluxerr)) AS smm FROM {name}_m GROUP BY ALL),
    {name} AS (SELECT s.*, sfm / smm AS amplitude, sff - sfm / smm * sfm AS chisq, t_min, t_max, n FROM {name}_s s JOIN span USING (object_id) WHERE smm > 0 AND sfm > 0)"""


def finer_sql(before: str, r: int) -> str:
    step = (EBV[1] - EBV[0]) / Fit.PARTS**r
    lattice = [EBV[0] + step * i for i in range(round((EBV[-1] - EBV[0]) / step) + 1)]
    near = f"(SELECT unnest(range({1 - Fit.PARTS}, {Fit.PARTS})) AS"
    return f"""{flux_sql(ebv=lattice, name=f'bf_{r}')}{NODES.replace(' nd AS', f' nd_{r} AS').replace('FROM bf)', f'FROM bf_{r})')},
    tr_{r} AS (SELECT object_id, template, start, a.k, t0 + a.k * {G.START_STEP / Fit.PARTS**r!r}::DOUBLE AS t0, ebv + j * {step!r}::DOUBLE AS ebv FROM {before}, {near} k) a, {near} j) b WHERE t0 + a.k * {G.START_STEP / Fit.PARTS**r!r}::DOUBLE BETWEEN t_min - 5 - 1e-6 AND t_max + 5 + 1e-6 AND ebv + j * {step!r}::DOUBLE BETWEEN {EBV[0]} AND {EBV[-1]}){tried_sql(f'tr_{r}', f'ts_{r}', f'nd_{r}', 'start,')},
    sf_{r} AS (SELECT object_id, template, start, t0, ebv, amplitude, chisq, t_min, t_max, n FROM (SELECT *, row_number() OVER (PARTITION BY object_id, template, start ORDER BY round(chisq, 4), k, ebv) AS o FROM ts_{r}) WHERE o = 1)"""


SEEDED = f"""{PEAK}{flux_sql()}{NODES}{POINTS}{flux_sql(zs="SELECT 0.0::DOUBLE AS z", ebv=[0.0], name="bz")},
    ph AS (SELECT template, avg(phase) AS peak_phase FROM (SELECT template, band, arg_max(phase, {{'f': round(flux, 6), 'p': -phase}}) AS phase FROM bz WHERE band IN ('ztfg', 'ztfr') GROUP BY 1, 2) GROUP BY 1),
    ob AS (SELECT DISTINCT object_id FROM pts), gu AS (SELECT object_id, template, peak_time - peak_phase AS t0guess FROM ob JOIN ph ON true LEFT JOIN (SELECT object_id, peak_time FROM q WHERE band = 'ztfr') r USING (object_id)),
    span AS (SELECT object_id, min(time) AS t_min, max(time) AS t_max, sum(flux * flux / (fluxerr * fluxerr)) AS sff, count(*) AS n FROM pts GROUP BY 1),
    st AS (SELECT object_id, template, i AS k, t_min - 5 + (t_max + 5 - (t_min - 5)) * i / many AS t0 FROM (SELECT *, unnest(range(0, many + 1)) AS i FROM (SELECT *, greatest(CAST(ceil((t_max - t_min + 10) / 5) AS INTEGER), 14) AS many FROM gu JOIN span USING (object_id)))
    UNION ALL SELECT object_id, template, j - 100, t0guess + j * 2.0::DOUBLE FROM gu JOIN span USING (object_id), (SELECT unnest(range(-5, 6)) AS j) WHERE t0guess + j * 2.0::DOUBLE BETWEEN t_min - 5 AND t_max + 5){tried_sql('st', 'c_0', 'nd', '')},
    bt AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY object_id, template, k ORDER BY round(chisq, 4), ebv) AS o FROM c_0) WHERE o = 1),
    lm AS (SELECT *, round(chisq, 4) <= coalesce(lag(round(chisq, 4)) OVER v, 1e300) AND round(chisq, 4) <= coalesce(lead(round(chisq, 4)) OVER v, 1e300) AS low FROM bt WINDOW v AS (PARTITION BY object_id, template ORDER BY t0, k)),
    mi AS (SELECT * FROM (SELECT * EXCLUDE (k, o), row_number() OVER (PARTITION BY object_id, template ORDER BY round(chisq, 4), t0, k) AS start FROM lm WHERE low) WHERE start <= {STARTS}){finer_sql('mi', 1)}{finer_sql('sf_1', 2)},
    sfit AS MATERIALIZED (SELECT s.*, t0guess, abs(s.t0 - t0guess) AS t0diff FROM (SELECT *, row_number() OVER (PARTITION BY object_id, template ORDER BY round(chisq, 4), start) AS o FROM sf_2) s JOIN gu USING (object_id, template) WHERE o = 1)"""
SEED_TABLES = "photometry catalog template_flux bandpass"


def seeded(spark, d, bands=("ztfg", "ztfr")):
    """Seeded fits of all objects and templates, the points and the peaks of bands."""
    checkpoints(spark)
    p = points(spark, d).checkpoint()
    found = P.peak_flux(A.photometry(spark, d).filter(F.col("band").isin(*bands)), "twa", n_grid=N_GRID).checkpoint()
    phases = Syn.peak_phases(rest_fluxes(spark).filter("band in ('ztfg', 'ztfr')"), "template").groupBy("template").agg(F.avg("peak_phase").alias("peak_phase"))
    red = found.filter("band = 'ztfr'").select("object_id", "peak_time")
    seeds = p.select("object_id").distinct().join(F.broadcast(phases)).join(red, "object_id", "left")  # a row for each template
    fits = G.seeded_fit(p, nodes_at(spark), seeds.select("object_id", "template", (F.col("peak_time") - F.col("peak_phase")).alias("t0guess")), STARTS, ROUNDS)
    return p, found, fits


@query(A.with_ctes(SEED_TABLES, f"{SEEDED} SELECT object_id, template, round(t0guess, 5) AS t0guess, round(t0, 5) AS t0, round(t0diff, 5) AS t0diff, ebv, round(chisq, 3) AS chisq, (n - 3)::INTEGER AS ndof FROM sfit"))
def seeded_fit(spark, d):
    """Fits that begin at the expected time as well as all over the data, with up to three minima followed."""
    f = seeded(spark, d, ("ztfr",))[2].select("object_id", "template", "t0guess", "t0", "t0diff", "ebv", "chisq", "ndof")
    return rounded(rounded(f, "t0guess", "t0", "t0diff", digits=5), "chisq", digits=3)


RECORD = f"""{SEEDED}, nf AS (SELECT template, z, ebv, band, node, nf, nn FROM nd_2), pf AS (SELECT f.object_id, f.template, t0, f.ebv, amplitude, chisq, f.n, t0diff, p.z, p.band, p.time, p.flux, p.fluxerr, p.point_id, t0 - 20 * (1 + p.z) AS t_start, t0 - 20 * (1 + p.z) + 60 AS t_end, time - t0 AS d, ((time - t0) / (1 + p.z) + 20) / 2 AS x FROM sfit f JOIN pts p USING (object_id)),
    pm AS (SELECT pf.*, time BETWEEN t_start AND t_end AS inside, amplitude * coalesce(nf + (x - floor(x)) * (coalesce(nn, CASE WHEN x = floor(x) THEN nf END) - nf), 0) AS mf FROM pf LEFT JOIN nf ON nf.template = pf.template AND nf.z = pf.z AND nf.ebv = pf.ebv AND nf.band = pf.band AND nf.node = CAST(floor(x) AS INTEGER)),
    me AS (SELECT object_id, template, count_if(time < t_start)::BIGINT AS premod, count_if(time > t_end)::BIGINT AS postmod, min(time - t_start) AS predt, max(time - t_end) AS postdt, count_if(inside)::BIGINT AS peakdet, count(DISTINCT band) FILTER (inside) AS peakbands, max(time) FILTER (inside) - min(time) FILTER (inside) AS peakduration,
    count_if(inside AND d <= -3)::BIGINT AS earlydet, count_if(inside AND d > -3 AND d <= 3)::BIGINT AS thendet, count_if(inside AND d > 3 AND d <= 15)::BIGINT AS postdet, count_if(inside AND d >= 15 AND d <= 30)::BIGINT AS latedet, sum(pow(flux - mf, 2) / (pow(0.1::DOUBLE * flux, 2) + fluxerr * fluxerr)) FILTER (inside) AS peakchi FROM pm GROUP BY 1, 2),
    re AS (SELECT object_id, template, (flux - mf) / flux AS peak_residual FROM (SELECT *, row_number() OVER (PARTITION BY object_id, template ORDER BY flux DESC, time, point_id) AS o FROM pm WHERE inside) WHERE o = 1),
    sd AS (SELECT a.object_id, a.n_eff_before_peak + b.n_eff_before_peak AS presum, a.n_eff_after_peak + b.n_eff_after_peak AS postsum FROM q a JOIN q b ON a.object_id = b.object_id AND a.band = 'ztfg' AND b.band = 'ztfr')"""


RECORDS = f"""{RECORD}, rec AS (SELECT c.object_id, ph.template, f.chisq IS NOT NULL AND f.n > 3 AS success, f.ebv, round(f.chisq, 3) AS chisq, round(f.t0diff, 5) AS t0diff, premod, postmod, round(predt, 4) AS predt, round(postdt, 4) AS postdt, peakdet, peakbands, round(peakduration, 4) AS peakduration,
    earlydet, thendet, postdet, latedet, round(peakchi, 3) AS peakchi, round(peak_residual, 4) AS peak_residual, round(presum, 4) AS presum, round(postsum, 4) AS postsum, coalesce(premod <= 1 AND postmod <= 1 AND predt >= -3 AND postdt <= 3 AND 1 - peak_residual BETWEEN 0.5 AND 1.5, false) AS accepted,
    NOT (t0diff > 15 OR presum < 3 OR postsum < 3 OR earlydet < 2 OR postdet < 2 OR latedet < 2) AS peak_good FROM (SELECT DISTINCT object_id FROM catalog WHERE redshift <> '-') c JOIN ph ON true LEFT JOIN sfit f ON f.object_id = c.object_id AND f.template = ph.template LEFT JOIN me ON me.object_id = c.object_id AND me.template = ph.template LEFT JOIN re ON re.object_id = c.object_id AND re.template = ph.template LEFT JOIN sd ON sd.object_id = c.object_id)"""


def records(spark, d):
    """fit_record's rows, unrounded, and the bands' peaks."""
    p, found, fits = seeded(spark, d)
    fits = fits.checkpoint()
    m = Fit.fit_metrics(p, fits, Fit.nodes_of(fits, nodes_at(spark))).drop("t0", "ebv", "amplitude", "chisq", "ndof")
    sums = P.peak_colors(found, (("ztfg", "ztfr"),)).select("object_id", "presum", "postsum")
    every = redshifts(spark, d).select("object_id").distinct().join(F.broadcast(rest_fluxes(spark).select("template").distinct()))  # a row for each template
    keys = ["object_id", "template"]
    r = every.join(fits.select(*keys, "ebv", "chisq", "ndof", "t0diff"), keys, "left").join(m, keys, "left").join(sums, "object_id", "left")
    ok = F.expr("premod <= 1 and postmod <= 1 and predt >= -3 and postdt <= 3 and 1 - peak_residual between 0.5 and 1.5")
    return r.withColumns({"success": F.col("chisq").isNotNull() & (F.col("ndof") > 0), "accepted": F.coalesce(ok, F.lit(False)), "peak_good": S.peak_good()}), found


@query(A.with_ctes(SEED_TABLES, f"{RECORDS} SELECT * FROM rec"))
def fit_record(spark, d):
    """One record for each object and template: the seeded fit, coverage and counts around its peak, acceptance and the flag of a
    well-sampled peak; a pair that can't be fitted keeps a row without success. The brightest point counts as met where the model there
    is between half and one and a half times as bright."""
    r, keys = records(spark, d)[0], ["object_id", "template"]
    r = rounded(rounded(rounded(r, "t0diff", digits=5), "chisq", "peakchi", digits=3), "predt", "postdt", "peakduration", "peak_residual", "presum", "postsum", digits=4)
    return r.select(*keys, "success", "ebv", "chisq", "t0diff", "premod", "postmod", "predt", "postdt", "peakdet", "peakbands", "peakduration", "earlydet", "thendet", "postdet", "latedet", "peakchi", "peak_residual", "presum", "postsum", "accepted", "peak_good")


CODES = """, n AS (SELECT object_id, count(*) AS ndet, count(DISTINCT band) AS nb FROM photometry GROUP BY 1), gr AS (SELECT a.object_id, -2.5::DOUBLE * log10(a.peak_flux / b.peak_flux) AS g_r FROM q a JOIN q b ON a.object_id = b.object_id AND a.band = 'ztfg' AND b.band = 'ztfr'),
    an AS (SELECT object_id, bool_or(accepted) AS any_accepted, bool_or(accepted AND coalesce(peak_good, false)) AS any_good FROM rec GROUP BY 1),
    oc AS (SELECT CASE WHEN object_id % 10 = 0 THEN 1 WHEN coalesce(ndet, 0) = 0 THEN 2 WHEN nb < 2 THEN 3 WHEN g_r IS NULL THEN 4 WHEN presum < 2 OR postsum < 2 THEN 5 WHEN NOT coalesce(any_accepted, false) THEN 6 WHEN NOT coalesce(any_good, false) THEN 9 ELSE 99 END AS code FROM catalog LEFT JOIN n USING (object_id) LEFT JOIN gr USING (object_id) LEFT JOIN sd USING (object_id) LEFT JOIN an USING (object_id))"""


@query(A.with_ctes(SEED_TABLES, f"{RECORDS}{CODES} SELECT code, count(*) AS n FROM oc GROUP BY code"))
def outcome_codes(spark, d):
    """What became of each object of the catalogue, counted: why it wasn't fitted, or how its fits did."""
    r, found = records(spark, d)
    fitted = r.groupBy("object_id").agg(F.bool_or("accepted").alias("accepted"), F.bool_or(F.col("accepted") & F.coalesce("peak_good", F.lit(False))).alias("peak_good"))
    c = P.peak_colors(found, (("ztfg", "ztfr"),)).select("object_id", F.col("color").alias("g_r"), "presum", "postsum")
    n = A.photometry(spark, d).groupBy("object_id").agg(F.count("*").alias("ndet"), F.count_distinct("band").alias("nbr_bands"))
    rows = A.catalog(spark, d).select("object_id", (F.col("object_id") % 10 == 0).alias("rejected")).join(n, "object_id", "left").join(c, "object_id", "left").join(fitted, "object_id", "left")
    return rows.withColumn("code", L.fail_code()).select(L.outcome().alias("code")).groupBy("code").agg(F.count("*").alias("n"))
