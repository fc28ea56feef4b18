"""Queries on peak-colour populations."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from nightflux.functions.astro import dust_sql, emg_pdf, matern32, uniform_sql
from nightflux.operators import colors as C
from nightflux.operators import selection as Sel
from nightflux.operators import synphot as S
from nightflux.operators import taxonomy as T
from nightflux.operators.synphot import AB, LIGHT_A, wave_weights
from nightflux.sources import adapters as A

from .classes import listed
from .models import flux_sql, rest_fluxes
from .registry import query, rounded
from .warpsets import WARPS, warps


def kept_sql(mode: str) -> str:
    iqr = ", q AS (SELECT class, quantile_cont(color, 0.25) AS q1, quantile_cont(color, 0.75) AS q3 FROM colors GROUP BY 1), d2 AS (SELECT colors.* FROM colors JOIN q USING (class) WHERE color >= q1 - 3 * (q3 - q1) AND color <= q3 + 3 * (q3 - q1))"
    core = ", c AS (SELECT class, quantile_cont(color, 0.05) AS lo, quantile_cont(color, 0.95) AS hi FROM d2 GROUP BY 1), m AS (SELECT class, avg(color) AS mu, stddev_pop(color) AS sd FROM d2 JOIN c USING (class) WHERE color BETWEEN lo AND hi GROUP BY 1), d3 AS (SELECT d2.* FROM d2 JOIN m USING (class) WHERE color > mu - 2 * sd AND color < mu + 2 * sd)"
    return iqr if mode == "iqr" else iqr + core


@query(A.with_ctes("colors", f"{kept_sql('clip')} SELECT class, 'iqr' AS mode, count(*) AS n, round(sum(color), 4) AS total FROM d2 GROUP BY 1 UNION ALL SELECT class, 'clip', count(*), round(sum(color), 4) FROM d3 GROUP BY 1 UNION ALL SELECT class, 'finite', count(*), round(sum(color), 4) FROM colors GROUP BY 1"))
def outlier_filters(spark, d):
    c = A.colors(spark, d)
    kept = [(m, C.outlier_free(c, mode=m if m != "clip" else "clip5", n_sigma=2.0)) for m in ("iqr", "clip", "finite")]
    out = None
    for m, k in kept:
        part = k.groupBy("class").agg(F.count("*").alias("n"), F.round(F.sum("color"), 4).alias("total")).withColumn("mode", F.lit(m))
        out = part if out is None else out.unionByName(part)
    return out.select("class", "mode", "n", "total")


EMG = ", mo AS (SELECT class, count(color) AS n, avg(color) AS m, stddev_pop(color) AS s FROM colors GROUP BY 1), sk AS (SELECT mo.*, avg(pow((color - m) / s, 3)) AS g FROM colors JOIN mo USING (class) GROUP BY ALL), ta AS (SELECT *, s * pow(least(greatest(g, 0), 1.99) / 2, 1.0 / 3) AS tau FROM sk), emg AS (SELECT class, n, tau / sqrt(s * s - tau * tau) AS k, m - tau AS loc, sqrt(s * s - tau * tau) AS scale, g <= 0 OR n < 5 AS degenerate FROM ta)"


@query(A.with_ctes("colors", f"{EMG} SELECT class, n, round(k, 5) AS k, round(loc, 5) AS loc, round(scale, 5) AS scale, degenerate FROM emg"))
def emg_fit(spark, d):
    return rounded(C.emg_fit(A.colors(spark, d)), "k", "loc", "scale", digits=5)


@query()
def emg_likelihood(spark, d):
    """The most likely parameters of each class."""
    c = A.colors(spark, d)
    return rounded(C.emg_likelihood(c, C.emg_fit(c)), "k", "loc", "scale", "loglik", digits=4)


#: The density as an integral over the exponential part, by Simpson's rule on 2000 steps where the Gaussian isn't negligible.
_Y = "(lo + i * step)"
DENSITY = f"""{EMG}, xs AS (SELECT row_id, class, color - loc AS x, scale AS s, k * scale AS tau FROM colors JOIN emg USING (class) WHERE NOT degenerate), yl AS (SELECT *, greatest(x - 9 * s, 0) AS lo, (greatest(x + 9 * s, 0) - greatest(x - 9 * s, 0)) / 2000 AS step FROM xs)
    SELECT row_id, class, round(step / 3 * list_sum(list_transform(range(0, 2001), lambda i: CASE WHEN i % 2000 = 0 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(-0.5::DOUBLE * pow((x - {_Y}) / s, 2) - {_Y} / tau))) / (s * sqrt(2 * pi()) * tau), 6) AS density FROM yl"""


@query(A.with_ctes("colors", DENSITY))
def emg_density(spark, d):
    """Density of each class's distribution at its own colours."""
    c = A.colors(spark, d)
    f = C.emg_fit(c).filter("not degenerate")
    return c.join(F.broadcast(f), "class").select("row_id", "class", F.round(emg_pdf("color", "k", "loc", "scale"), 6).alias("density"))


def draw_sql(seed: int, *keys: str) -> str:
    u = [f"greatest({uniform_sql(seed + i, *keys)}, 1e-12)" for i in range(3)]
    return f"loc + scale * (sqrt(-2.0 * ln({u[0]})) * cos(6.283185307179586::DOUBLE * {u[1]}) - k * ln({u[2]}))"


@query(A.with_ctes("colors", f"{EMG} SELECT row_id, class, round({draw_sql(3, 'row_id')}, 6) AS drawn FROM colors JOIN emg USING (class)"))
def emg_draws(spark, d):
    c = A.colors(spark, d)
    out = c.join(F.broadcast(C.emg_fit(c)), "class")
    return out.select("row_id", "class", F.round(C.emg_draw(F.col("k"), F.col("loc"), F.col("scale"), 3, "row_id"), 6).alias("drawn"))


HIST = ", h AS (SELECT class, CAST(least(floor((color - 0.0) / ((2.0 - 0.0) / 20)), 19) AS INTEGER) AS bin, count(*) AS n FROM colors WHERE color BETWEEN 0.0 AND 2.0 GROUP BY 1, 2)"


@query(A.with_ctes("colors", f"{HIST} SELECT class, bin, n, round(n / max(n) OVER (PARTITION BY class), 6) AS height, CASE WHEN count(*) OVER (PARTITION BY class) < 30 THEN 5 WHEN count(*) OVER (PARTITION BY class) < 120 THEN 10 ELSE 20 END AS bins FROM h"))
def color_histogram(spark, d):
    """Shared bins, last one closed; heights relative to the highest bin; bins that a sample of that many rows would get."""
    h = C.peak_normalised(C.histogram(A.colors(spark, d), "color", 0.0, 2.0, 20, "class"), "class")
    n = F.count("*").over(C.Window.partitionBy("class"))
    return h.select("class", "bin", "n", F.round("height", 6).alias("height"), C.bins_for(n).alias("bins"))


@query(A.with_ctes("color_pairs", " SELECT CAST(floor(x / 0.02::DOUBLE) AS BIGINT) AS ix, CAST(floor(y / 0.01::DOUBLE) AS BIGINT) AS iy, count(*) AS n, round(log10(count(*)), 6) AS log_n FROM (SELECT round(x, 6) + 0.001::DOUBLE AS x, round(y, 6) + 0.0001::DOUBLE AS y FROM color_pairs) GROUP BY 1, 2"))
def color_cells(spark, d):
    p = A.color_pairs(spark, d).select((F.round("x", 6) + 0.001).alias("x"), (F.round("y", 6) + 0.0001).alias("y"))
    return rounded(C.cells(p, "x", "y", 0.02, 0.01), "log_n")


@query(A.with_ctes("color_log", " SELECT model, timestamp, row_id, round(loc, 4) AS loc FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY TRY_CAST(timestamp AS TIMESTAMP) DESC NULLS LAST, row_id DESC) AS n FROM color_log) WHERE n = 1"))
def latest_color_fit(spark, d):
    return rounded(C.latest(A.color_log(spark, d)).select("model", "timestamp", "row_id", "loc"), "loc", digits=4)


def cubic_sql() -> str:
    out = ", sums AS (SELECT class, count(*) AS n, " + ", ".join([f"sum(pow(x, {i})) AS s{i}" for i in range(7)] + [f"sum(pow(x, {i}) * y) AS t{i}" for i in range(4)]) + " FROM color_pairs GROUP BY 1)"
    rows = {(i, j): f"s{i + j}" for i in range(4) for j in range(4)} | {(i, 4): f"t{i}" for i in range(4)}
    before = "sums"
    for c in range(3):
        step = {(i, j): f"{rows[i, j]} - {rows[i, c]} / {rows[c, c]} * {rows[c, j]} AS m{c}_{i}_{j}" for i in range(c + 1, 4) for j in range(c, 5)}
        out += f", e{c} AS (SELECT *, {', '.join(step.values())} FROM {before})"
        before = f"e{c}"
        rows |= {(i, j): f"m{c}_{i}_{j}" for i, j in step}
    for i in (3, 2, 1, 0):
        known = " - ".join([rows[i, 4], *(f"{rows[i, j]} * c{j}" for j in range(i + 1, 4))])
        out += f", k{i} AS (SELECT *, ({known}) / {rows[i, i]} AS c{i} FROM {before})"
        before = f"k{i}"
    return out


@query(A.with_ctes("color_pairs", f"{cubic_sql()} SELECT class, n, round(c0, 4) AS c0, round(c1, 4) AS c1, round(c2, 3) AS c2, round(c3, 2) AS c3 FROM k0"))
def cubic_regression(spark, d):
    f = C.cubic_fit(A.color_pairs(spark, d))
    return rounded(rounded(rounded(f, "c0", "c1", digits=4), "c2", digits=3), "c3", digits=2)


@query("SELECT class, count(*) AS n FROM (SELECT CASE o_orderkey % 4 WHEN 0 THEN 'SLSN-I' WHEN 1 THEN 'SN Ic-BL' WHEN 2 THEN 'SLSN (w)' ELSE 'SN II' END AS class, o_custkey % 5 - 2 AS natcol FROM orders) WHERE CASE WHEN class IN ('SLSN-I', 'SLSN-II', 'SLSN (e)', 'SLSN (w)') THEN natcol > -1 WHEN class = 'SN Ic-BL' THEN natcol < 1 ELSE true END GROUP BY class")
def regression_mask(spark, d):
    k = F.col("o_orderkey") % 4
    rows = A.table(spark, d, "orders").select(F.when(k == 0, "SLSN-I").when(k == 1, "SN Ic-BL").when(k == 2, "SLSN (w)").otherwise("SN II").alias("class"), (F.col("o_custkey") % 5 - 2).alias("natcol"))
    return C.regression_rows(rows).groupBy("class").agg(F.count("*").alias("n"))


WAVES = [float(w) for w in A.SURFACE_WAVES]
#: g and r at the peaks of the plain templates, at rest: peak phase and flux of each band, and the spectrum there.
NATURAL = flux_sql(zs="SELECT 0.0::DOUBLE AS z", ebv=[0.0]) + """, tp AS (SELECT template, band, CASE band WHEN 'ztfg' THEN 1 ELSE 2 END AS side, arg_max(phase, {'f': round(flux, 6), 'p': -phase}) AS phase, max(flux) AS f FROM bf WHERE band IN ('ztfg', 'ztfr') GROUP BY 1, 2),
    cn AS (SELECT a.template, -2.5::DOUBLE * log10(a.f / b.f) AS color FROM tp a JOIN tp b ON a.template = b.template AND a.side = 1 AND b.side = 2)"""
TARGETS = ", tg AS (SELECT DISTINCT 'tpl-' || CAST(p_partkey % 4 AS VARCHAR) AS template, CAST(p_size AS DOUBLE) / 40 - 0.5 AS target FROM part)"


def natural_peaks(spark):
    return S.peak_phases(rest_fluxes(spark).filter("band in ('ztfg', 'ztfr')"), "template")


def template_lines(spark):
    side = F.when(F.col("band") == "ztfg", 1).otherwise(2)
    at = natural_peaks(spark).select("template", "band", side.alias("side"), F.col("peak_phase").alias("phase"))
    return C.color_lines(A.template_flux(spark).join(at, ["template", "phase"]), A.bandpass(spark), "template")


def targets(spark, d):
    return A.table(spark, d, "part").select(F.concat(F.lit("tpl-"), (F.col("p_partkey") % 4).cast("string")).alias("template"), (F.col("p_size").cast("double") / 40 - 0.5).alias("target")).distinct()


@query(A.with_ctes("template_flux bandpass", f"{NATURAL}{TARGETS} SELECT template, target, round(color, 5) AS color FROM cn JOIN tg USING (template)"))
def peak_color(spark, d):
    """Colour of each model at its own peaks, next to the colours asked for."""
    natural = C.peak_color(rest_fluxes(spark), "ztfg", "ztfr", "template").select("template", F.round("color", 5).alias("color"))
    return targets(spark, d).join(natural, "template").select("template", "target", "color")


DIMMED = "list_sum(list_transform(list_filter(lines, lambda x: x.side = {side}), lambda x: x.w * exp(-{dim!r}::DOUBLE * {e} * x.k)))"


def dimmed_sql(e: str) -> str:
    one, two = (DIMMED.format(side=n, dim=C.DIM, e=e) for n in (1, 2))
    return f"(-2.5::DOUBLE * log10({one} / {two}))"


def lines_sql(source: str, bands: str, keys: str, name: str = "ln") -> str:
    """name(keys, lines): the lines of the models in source(keys, side, band, wave, flux)."""
    return f""", {name}_ab AS (SELECT band, sum({AB!r} * {LIGHT_A!r} / (wave * wave) * wave * trans * 100) AS ab FROM {bands} GROUP BY band),
    {name} AS (SELECT {keys}, list({{'side': side, 'w': flux * trans * wave * 100 / ab, 'k': {dust_sql('wave')}}}) AS lines FROM {source} JOIN {bands} USING (band, wave) JOIN {name}_ab USING (band) GROUP BY {keys})"""


BISECTED = f"""{NATURAL}{TARGETS}, ts AS (SELECT t.template, side, band, wave, t.flux FROM template_flux t JOIN tp USING (template, phase)){lines_sql('ts', 'bandpass', 'template')},
    bi AS (WITH RECURSIVE r(template, target, lines, lo, hi, i) AS (SELECT template, target, lines, -5.0::DOUBLE, 5.0::DOUBLE, 0 FROM tg JOIN ln USING (template)
    UNION ALL SELECT template, target, lines, CASE WHEN c < target THEN e ELSE lo END, CASE WHEN c < target THEN hi ELSE e END, i + 1 FROM (SELECT *, {dimmed_sql('e')} AS c FROM (SELECT *, (lo + hi) / 2 AS e FROM r WHERE i < 45))) SELECT template, target, lines, (lo + hi) / 2 AS e FROM r WHERE i = 45),
    so AS (SELECT template, target, CASE WHEN abs({dimmed_sql('e')} - target) < 1e-6 THEN e END AS ebv_fit, {dimmed_sql('e')} AS c FROM bi)"""


@query(A.with_ctes("template_flux bandpass", f"{BISECTED} SELECT template, target, round(ebv_fit, 6) AS ebv_fit FROM so"))
def solve_ebv(spark, d):
    """The dust, from -5 to 5, behind which each model has the colour asked for."""
    return rounded(C.ebv_for(template_lines(spark), targets(spark, d), "template").select("template", "target", "ebv_fit"), "ebv_fit")


@query(A.with_ctes("template_flux bandpass", f"{BISECTED} SELECT template, target, round(c, 6) AS color, abs(c - target) > 0.01 AS missed FROM so WHERE ebv_fit IS NOT NULL"))
def verified_colors(spark, d):
    """Colour of each model behind its own solution, and whether it misses its target by over 0.01."""
    solved = C.ebv_for(template_lines(spark), targets(spark, d), "template").filter("ebv_fit is not null")
    return solved.select("template", "target", F.round("color", 6).alias("color"), (F.abs(F.col("color") - F.col("target")) > 0.01).alias("missed"))


#: Targets that are drawn for each model, for the cubic of its class.
N_TARGETS = 10
CLASSES = "CASE class WHEN 'SN II' THEN 'click' WHEN 'SN Ib' THEN 'view' WHEN 'SN Ic' THEN 'purchase' ELSE 'signup' END"
BAND_1, BAND_2 = (f"CASE WHEN class IN ({listed(T.RED_CLASSES)}) THEN '{red}' ELSE '{usual}' END" for red, usual in (("ztfr", T.COLOR_BANDS[0]), ("ztfi", T.COLOR_BANDS[1])))
# every warp's spectra, their flux in the two bands of its class, the peaks there
WEIGHTS = ", ww AS (SELECT wave, " + ", ".join(f"list_extract([{', '.join(map(repr, c))}]::DOUBLE[], CAST((wave - 3000) / 100 AS INTEGER) + 1) AS w{j}" for j, c in enumerate(wave_weights(WAVES).T.tolist())) + " FROM (SELECT CAST(unnest(range(3000, 9001, 100)) AS DOUBLE) AS wave))"
FACTOR = " + ".join(f"f{j} * w{j}" for j in range(5))
PEAKED = f"""{WARPS}{EMG}, vs AS (SELECT * FROM ws WHERE CAST(id AS VARCHAR) || '_' || model NOT IN ('1_tpl-1', '2_tpl-2')){A.factors_sql('vs')}{WEIGHTS},
    cb AS (SELECT id, model, class, 1 AS side, {BAND_1} AS band FROM vs UNION ALL SELECT id, model, class, 2, {BAND_2} FROM vs),
    ab AS (SELECT band, sum({AB!r} * {LIGHT_A!r} / (wave * wave) * wave * trans * 100) AS ab FROM rest_bands GROUP BY band),
    lit AS (SELECT t.template, t.phase, t.wave, b.band, t.flux * b.trans * t.wave * 100 / ab AS v FROM template_flux t JOIN rest_bands b USING (wave) JOIN ab USING (band)),
    wb AS (SELECT wf.id, wf.model, cb.class, cb.side, cb.band, wf.phase, sum(v * greatest({FACTOR}, 0)) * 1e10 AS flux FROM wf JOIN cb ON cb.id = wf.id AND cb.model = wf.model JOIN lit ON lit.template = wf.template AND lit.phase = wf.phase AND lit.band = cb.band JOIN ww ON ww.wave = lit.wave GROUP BY ALL),
    pk AS (SELECT id, model, class, side, band, arg_max(phase, {{'f': round(flux, 6), 'p': -phase}}) AS phase, arg_max(flux, {{'f': round(flux, 6), 'p': -phase}}) AS f FROM wb GROUP BY ALL),
    pc AS (SELECT a.id, a.model, a.class, -2.5::DOUBLE * log10(a.f / b.f) AS peakcol FROM pk a JOIN pk b ON a.id = b.id AND a.model = b.model AND a.side = 1 AND b.side = 2),
    pp AS (SELECT pc.*, loc, scale, k FROM pc JOIN emg ON emg.class = {CLASSES.replace('class', 'pc.class')})"""
NEWTON = f"""{{'s1': {DIMMED.format(side=1, dim=C.DIM, e='e')}, 's2': {DIMMED.format(side=2, dim=C.DIM, e='e')}, 't1': {DIMMED.format(side=1, dim=C.DIM, e='e').replace('x.w *', 'x.k * x.w *')}, 't2': {DIMMED.format(side=2, dim=C.DIM, e='e').replace('x.w *', 'x.k * x.w *')}}}"""
FITTED_CUBIC = f"""{PEAKED}, aw AS (SELECT pk.id, pk.model, side, pk.band, t.wave, t.flux * greatest({FACTOR}, 0) AS flux FROM pk JOIN wf ON wf.id = pk.id AND wf.model = pk.model AND wf.phase = pk.phase JOIN template_flux t ON t.template = wf.template AND t.phase = wf.phase JOIN ww ON ww.wave = t.wave){lines_sql('aw', 'rest_bands', 'id, model')},
    dr0 AS (SELECT pp.*, nth, {draw_sql(11, 'id', 'model', 'nth')} AS target FROM pp, (SELECT unnest(range(0, {N_TARGETS})) AS nth)),
    nt AS (WITH RECURSIVE r(id, model, nth, target, e, i) AS (SELECT id, model, nth, target, 0.0::DOUBLE, 0 FROM dr0
    UNION ALL SELECT id, model, nth, target, greatest(least(e - (-2.5::DOUBLE * log10(q.s1 / q.s2) - target) / ({2.5 / math.log(10.0) * C.DIM!r}::DOUBLE * (q.t1 / q.s1 - q.t2 / q.s2)), 5), -5), i + 1 FROM (SELECT r.*, {NEWTON} AS q FROM r JOIN ln USING (id, model) WHERE i < 12)) SELECT id, model, nth, e FROM r WHERE i = 12),
    nf AS (SELECT id, model, nth, e FROM nt JOIN ln USING (id, model) JOIN dr0 USING (id, model, nth) WHERE abs({dimmed_sql('e')} - target) < 1e-6),
    color_pairs AS (SELECT class, target - peakcol AS x, e AS y FROM dr0 JOIN nf USING (id, model, nth) WHERE isfinite(peakcol)){cubic_sql()}"""
ENRICHED = f"{FITTED_CUBIC}, en AS (SELECT pp.*, c0, c1, c2, c3 FROM pp JOIN k0 USING (class))"


def colored(spark, d, only=None):
    """Warp rows but vetoed ones (only: those of these ids and models) with the peak colour of their model, in the bands of their class, the
    phases of the peaks there, and the class's parameters. Each row is worked out beside itself; none is dealt again."""
    w = warps(spark, d).select("id", "model", "class", "sf").withColumn("pair", F.concat_ws("_", F.col("id").cast("string"), "model"))
    w = Sel.without(w, spark.createDataFrame([("1_tpl-1",), ("2_tpl-2",)], "veto string"), "pair").drop("pair")
    if only is not None:
        w = w.join(only.select("id", "model"), ["id", "model"], "left_semi")
    one, two = T.color_bands("class")
    w = w.withColumns({"template": A.template_of("model"), "band_1": one, "band_2": two})
    peaks = S.warped_peaks(w, A.factors, lines_of(spark), WAVES).withColumn("peakcol", -2.5 * F.log10(F.col("flux_1") / F.col("flux_2"))).drop("flux_1", "flux_2")
    kind = F.when(F.col("class") == "SN II", "click").when(F.col("class") == "SN Ib", "view").when(F.col("class") == "SN Ic", "purchase").otherwise("signup")
    params = C.emg_fit(A.colors(spark, d)).select(F.col("class").alias("kind"), "k", "loc", "scale")
    return peaks.withColumn("kind", kind).join(F.broadcast(params), "kind").drop("kind")


def lines_of(spark):
    rest = A.rest_bands(spark).filter("band <> 'ztfg'")  # no class takes its colour from it
    return S.band_lines(A.template_flux(spark).drop("class"), rest, WAVES)


def class_cubics(spark, rows):
    """The cubic of each class: dust that gives a target, by how far the target is from the model's own colour."""
    drawn = F.transform(F.sequence(F.lit(0), F.lit(N_TARGETS - 1)), lambda nth: C.emg_draw(F.col("k"), F.col("loc"), F.col("scale"), 11, "id", "model", nth))
    solved = C.warped_ebv(rows.withColumn("targets", drawn), A.factors, lines_of(spark), "class", "peakcol").filter("ebv_fit is not null")
    used = C.regression_rows(solved, color="peakcol").filter(~F.isnan("peakcol") & (F.abs("peakcol") < float("inf")))
    return C.cubic_fit(used.select("class", (F.col("target") - F.col("peakcol")).alias("x"), F.col("ebv_fit").alias("y")))


def enriched(spark, d, only=None):
    """Warp rows (only: those of these ids and models) with their peak colour, their class's parameters and the cubic fitted to all models of
    the class."""
    cubics = class_cubics(spark, colored(spark, d)).drop("n")
    return colored(spark, d, only).drop("sf", "template", "band_1", "band_2", "phase_1", "phase_2").join(F.broadcast(cubics), "class")


@query(A.with_ctes("fits colors template_flux rest_bands", f"{FITTED_CUBIC} SELECT class, n, round(c0, 4) AS c0, round(c1, 4) AS c1, round(c2, 4) AS c2, round(c3, 4) AS c3 FROM k0"))
def class_color_cubics(spark, d):
    """Of all models of a class and the colours drawn for them: the dust that each needs, as a cubic."""
    return rounded(class_cubics(spark, colored(spark, d)), "c0", "c1", "c2", "c3", digits=4)


@query(A.with_ctes("fits colors template_flux rest_bands", f"{PEAKED} SELECT id, model, class, round(peakcol, 5) AS peakcol, round(loc, 5) AS loc, round(k, 5) AS k, round(scale, 5) AS scale FROM pp"))
def enriched_warp_set(spark, d):
    """Warp rows with the peak colour of their own model and their class's colour parameters, without vetoed pairs."""
    return rounded(colored(spark, d).select("id", "model", "class", "peakcol", "loc", "k", "scale"), "peakcol", "loc", "k", "scale", digits=5)


POLY = "(c0 + x * (c1 + x * (c2 + x * c3)))"


@query(A.with_ctes("fits colors template_flux rest_bands", f"{ENRICHED} SELECT id, model, 'harmonize' AS mode, round({POLY}, 5) AS shift FROM (SELECT *, loc - peakcol AS x FROM en) UNION ALL SELECT id, model, 'draw', round({POLY}, 5) FROM (SELECT *, {draw_sql(5, 'id', 'model')} - peakcol AS x FROM en) UNION ALL SELECT id, model, 'served', round({POLY} - peakcol, 5) FROM (SELECT *, loc AS x FROM en)"))
def color_modes(spark, d):
    """E(B-V) shift of each row: to the class's mean, to a drawn colour, and by the formula that was served before."""
    e, out = enriched(spark, d), []
    for name, mode, formula in (("harmonize", "harmonize", "difference"), ("draw", "draw", "difference"), ("served", "harmonize", "served")):
        e = C.ebv_shift(e, mode, 5, formula).drop("target").withColumnRenamed("samplecorr_ebv", f"{name}_shift")
        out.append(F.struct(F.lit(name).alias("mode"), F.round(f"{name}_shift", 5).alias("shift")))
    return e.select("id", "model", F.inline(F.array(*out)))  # a row's modes side by side, so that its work is done once


@query(A.with_ctes("fits colors template_flux rest_bands", f"{ENRICHED}, t AS (SELECT 'raw' AS run, peakcol AS c FROM en UNION ALL SELECT 'harmonized', loc FROM en UNION ALL SELECT 'drawn', {draw_sql(5, 'id', 'model')} FROM en), h AS (SELECT run, CAST(least(floor((round(c, 6) - (-1.0)) / ((4.0 - (-1.0)) / 25)), 24) AS INTEGER) AS bin, count(*) AS n FROM t WHERE round(c, 6) BETWEEN -1.0 AND 4.0 GROUP BY 1, 2) SELECT run, bin, n, round(n / max(n) OVER (PARTITION BY run), 6) AS height FROM h"))
def color_comparison(spark, d):
    """Distribution of colours raw, harmonised and drawn."""
    e = C.ebv_shift(enriched(spark, d), "draw", 5)
    runs = F.array(*(F.struct(F.lit(run).alias("run"), F.round(c, 6).alias("c")) for run, c in (("raw", "peakcol"), ("harmonized", "loc"), ("drawn", "target"))))
    all_ = e.select(F.inline(runs))
    return rounded(C.peak_normalised(C.histogram(all_, "c", -1.0, 4.0, 25, "run"), "run"), "height")


@query("SELECT event_id AS row_id, round((1 + sqrt(3.0) * abs(r) / 4.0) * exp(-sqrt(3.0) * abs(r) / 4.0), 9) AS k FROM (SELECT event_id, value / 20 - 3 AS r FROM events)")
def matern_kernel(spark, d):
    return A.table(spark, d, "events").select(F.col("event_id").alias("row_id"), F.round(matern32(F.col("value") / 20 - 3, 4.0), 9).alias("k"))
