"""Template fits as a grid search: a join and an aggregate for all objects, templates and nodes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nightflux.functions.astro import chi2_survival, dust_ratio

from . import blocks as B
from . import hot
from . import photometry as P
from . import synphot as S
from .selection import acceptable, best_per

#: First round: nodes of the time of the peak, and of the host's E(B-V) over its bounds. Each finer round divides the steps
#: of both by PARTS, so that values of E(B-V) stay exact.
T0_NODES, EBV_NODES = 15, [float(e) for e in range(-3, 6)]
PARTS, ROUNDS, MARGIN = 4, 2, 5.0


def shifts(spark, z_values: DataFrame, ebv=None) -> DataFrame:
    """z, ebv: the different redshifts with each dust node. Models are made for each of them: round the redshifts of a large catalogue first."""
    return z_values.select("z").distinct().withColumn("ebv", F.explode(F.array(*(F.lit(float(e)) for e in (ebv or EBV_NODES)))))


def grid_fit(points: DataFrame, nodes: DataFrame, t0_nodes: int = T0_NODES, trials: DataFrame | None = None) -> DataFrame:
    """Best node of each (object_id, template): z, t0, ebv, amplitude, chisq, ndof.

    points: object_id, z, band, time, flux, fluxerr, all of bands that nodes (template, z, ebv, band, node, ...) has.
    t0 runs over even nodes from 5 days before the first to 5 days after the last point, with every ebv of nodes; or trials
    (object_id, template, t0_node, t0, ebv) lists what to try. The amplitude of a node has a closed form, so chi2 needs sums
    only. Sums come before the shuffle; a template or dust node is one more row for a point, never a loop. Nodes that
    have a column object_id are of one object's models.
    """
    span = points.groupBy("object_id").agg(F.min("time").alias("t_min"), F.max("time").alias("t_max"), F.sum(F.col("flux") * F.col("flux") / (F.col("fluxerr") * F.col("fluxerr"))).alias("sff"), F.count("*").alias("n"), F.min("z").alias("z"))
    if trials is None:
        i = F.explode(F.sequence(F.lit(0), F.lit(t0_nodes - 1)))
        t0s = span.select("object_id", "t_min", "t_max", i.alias("t0_node"))
        lo, hi = F.col("t_min") - MARGIN, F.col("t_max") + MARGIN
        t0s, keep = t0s.withColumn("t0", lo + (hi - lo) * F.col("t0_node") / (t0_nodes - 1)).drop("t_min", "t_max"), []
    else:
        t0s, keep = trials.select("object_id", "template", "t0_node", "t0", "ebv"), ["template", "ebv"]
    own = ["object_id"] if "object_id" in nodes.columns else []
    rows = points.select("object_id", "z", "band", "time", "flux", "fluxerr").join(t0s, "object_id")
    rows = rows.withColumn("phase", (F.col("time") - F.col("t0")) / (1 + F.col("z")))
    x = (F.col("phase") - S.PHASE_0) / S.PHASE_STEP
    rows = rows.withColumns({"node": F.floor(x).cast("int"), "part": x - F.floor(x)})
    model = rows.join(nodes, [*own, *keep, "z", "band", "node"])
    m = F.col("node_flux") + F.col("part") * (F.coalesce("next_flux", F.when(F.col("part") == 0, F.col("node_flux")), F.lit(0.0)) - F.col("node_flux"))
    e2 = F.col("fluxerr") * F.col("fluxerr")
    sums = model.withColumn("m", m).groupBy("object_id", "template", "t0_node", "t0", "ebv").agg(F.sum(F.col("flux") * F.col("m") / e2).alias("sfm"), F.sum(F.col("m") * F.col("m") / e2).alias("smm"))
    found = sums.filter("smm > 0").join(span, "object_id").withColumn("amplitude", F.col("sfm") / F.col("smm"))
    found = found.withColumn("chisq", F.col("sff") - F.col("amplitude") * F.col("sfm"))
    best = best_per(found.filter("amplitude > 0"), ["object_id", "template"], F.round("chisq", 4), "t0_node", "ebv")
    return best.select("object_id", "template", "z", "t0_node", "t0", "ebv", "amplitude", "chisq", (F.col("n") - 3).cast("int").alias("ndof"), "t_min", "t_max")


def trials_around(found: DataFrame, t0_share: float, ebv_step: float, parts: int = PARTS) -> DataFrame:
    """Nodes next to each fit, fewer than parts steps away in t0 (a share of the object's time) and in ebv, in the bounds of both."""
    beside = F.explode(F.sequence(F.lit(1 - parts), F.lit(parts - 1)))
    lo, hi = F.col("t_min") - MARGIN, F.col("t_max") + MARGIN
    at = found.select("object_id", "template", "z", "t_min", "t_max", F.col("t0").alias("c"), F.col("ebv").alias("e"), beside.alias("t0_node")).withColumn("k", beside)
    at = at.withColumns({"t0": F.col("c") + F.col("t0_node") * ((hi - lo) * t0_share), "ebv": F.col("e") + F.col("k") * ebv_step})
    inside = (F.col("t0") >= lo - 1e-6) & (F.col("t0") <= hi + 1e-6) & F.col("ebv").between(EBV_NODES[0], EBV_NODES[-1])
    return at.filter(inside).select("object_id", "template", "z", "t0_node", "t0", "ebv")


def refined(points: DataFrame, nodes_at, coarse: DataFrame, rounds: int = ROUNDS, t0_nodes: int = T0_NODES, keep_table=None) -> DataFrame:
    """Finer rounds around the best node of each pair: t0 and ebv each less than one step of the round before to either
    side, in steps of a PARTS-th, so chisq never gets larger. After two rounds ebv is known to 1/16 and t0 to 1/224 of the object's time.

    nodes_at(shifts) gives the nodes of the (z, ebv) rows that a round needs. keep_table(df) makes df a table between the
    rounds (the session's checkpoint by default).
    """
    keep = keep_table or (lambda df: df.checkpoint())
    found = coarse
    for r in range(1, rounds + 1):
        found = keep(found)
        trials = trials_around(found, 1.0 / ((t0_nodes - 1) * PARTS**r), (EBV_NODES[1] - EBV_NODES[0]) / PARTS**r)
        found = grid_fit(points, nodes_at(trials.select("z", "ebv").distinct()), trials=trials)
    return found


def full_fit(points: DataFrame, nodes_at, keep_table=None, rounds: int = ROUNDS, hot_rows: int = hot.ROWS) -> DataFrame:
    """The first round over the whole bounds of t0 and ebv (its chisq as coarse), then the finer ones. Objects are fitted in blocks (see blocks), but hot ones (see
    hot) by joins that deal what is tried."""
    points = points.select("object_id", "z", "band", "time", "flux", "fluxerr")
    groups = hot.hot_groups(points, ["object_id"], hot_rows)
    cold, rest = (points, None) if groups is None else hot.split(points, groups, ["object_id"])
    models = node_arrays(nodes_at(shifts(points.sparkSession, points, lattice(rounds))))
    out = B.met(cold, models, lambda p, m: fitted(p, m, rounds), FITTED)
    if rest is None:
        return out
    coarse = grid_fit(rest, nodes_at(shifts(points.sparkSession, rest)))
    if rounds:
        coarse = (keep_table or (lambda df: df.checkpoint()))(coarse)
    fine = refined(rest, nodes_at, coarse, rounds, keep_table=keep_table)
    return out.unionByName(fine.join(coarse.select("object_id", "template", F.col("chisq").alias("coarse")), ["object_id", "template"]).select(out.columns))


FITTED = T.StructType([T.StructField("object_id", T.LongType()), T.StructField("template", T.StringType()), *(T.StructField(c, T.DoubleType()) for c in ("z", "t0", "ebv", "amplitude", "chisq", "coarse", "t_min", "t_max")), *(T.StructField(c, T.IntegerType()) for c in ("t0_node", "ndof"))])


def lattice(rounds: int) -> list[float]:
    """The dust nodes of the last round; each round before has every PARTS-th of them."""
    step = (EBV_NODES[1] - EBV_NODES[0]) / PARTS**rounds
    return [EBV_NODES[0] + step * i for i in range(round((EBV_NODES[-1] - EBV_NODES[0]) / step) + 1)]


def node_arrays(nodes: DataFrame, *keys: str) -> DataFrame:
    """keys (template by default), z, ebv, band with the phase nodes as an array from from_node on."""
    n = F.array_sort(F.collect_list(F.struct("node", "node_flux")))
    return nodes.groupBy(*(keys or ("template",)), "z", "ebv", "band").agg(F.min("node").alias("from_node"), F.transform(n, lambda x: x["node_flux"]).alias("nodes"))


def first_round(points: B.Points, models: B.Models, rounds: int) -> dict:
    """The pairs (row, model) of a block that can be fitted, with the best node of the first round."""
    lo, hi = points.t_min - MARGIN, points.t_max + MARGIN
    t0 = lo[:, None] + (hi - lo)[:, None] * np.arange(T0_NODES) / (T0_NODES - 1)
    amplitude, chisq = (np.swapaxes(x, 1, 2).reshape(points.n * len(models.names), -1) for x in B.grid(points, t0, models, slice(None, None, PARTS**rounds)))
    place, rows = B.best_of(chisq), np.arange(len(chisq))
    row, (node, e) = rows // len(models.names), np.divmod(place, len(EBV_NODES))
    f = {"row": row, "model": rows % len(models.names), "t0_node": node, "t0": t0[row, node], "e": e * PARTS**rounds, "amplitude": amplitude[rows, place], "chisq": chisq[rows, place], "t_min": points.t_min[row], "t_max": points.t_max[row], "n": points.count[row]}
    return {c: v[np.isfinite(chisq[rows, place])] for c, v in f.items()}


def finer_rounds(points: B.Points, f: dict, models: B.Models, rounds: int) -> dict:
    """f, whose rows are those of points, after the rounds of refined."""
    beside = np.arange(1 - PARTS, PARTS)
    for r in range(1, rounds + 1):
        lo, hi = f["t_min"] - MARGIN, f["t_max"] + MARGIN
        t0 = f["t0"][:, None] + beside * ((hi - lo) * (1.0 / ((T0_NODES - 1) * PARTS**r)))[:, None]
        tried = (t0 >= lo[:, None] - 1e-6) & (t0 <= hi[:, None] + 1e-6)
        e = f["e"][:, None] + beside * PARTS ** (rounds - r)
        place, amplitude, chisq = B.around(points, f["model"], t0, e, tried, models)
        i, j = np.divmod(place, len(beside))
        rows = np.arange(points.n)
        f = f | {"t0_node": beside[i], "t0": t0[rows, i], "e": np.clip(e[rows, j], 0, len(models.ebv) - 1), "amplitude": amplitude, "chisq": chisq, "t_min": points.t_min, "t_max": points.t_max, "n": points.count}
    return f


def some_of(f: dict, keep) -> dict:
    return {c: v[keep] for c, v in f.items()}


def fitted(points: pa.Table, models: pa.Table, rounds: int) -> pa.Table:
    """The fits of a block, as FITTED."""
    m, out = B.Models(models, ["template"]), []
    for ids, p, _ in B.parts(points, m):
        f = first_round(p, m, rounds)
        coarse = f["chisq"]
        for begin in range(0, len(coarse), B.STEP):
            g = some_of(f, slice(begin, begin + B.STEP))
            g = finer_rounds(p.of(g["row"])[0], g, m, rounds) | {"coarse": coarse[begin : begin + B.STEP]} if rounds else g | {"coarse": g["chisq"]}
            g = some_of(g, np.isfinite(g["chisq"]))
            out.append(pa.table({"object_id": ids[g["row"]], "template": pa.array([m.names[i][0] for i in g["model"]], pa.string()), "z": np.full(len(g["row"]), p.z), "t0": g["t0"], "ebv": m.ebv[g["e"]], **{c: g[c] for c in ("amplitude", "chisq", "coarse", "t_min", "t_max")}, "t0_node": g["t0_node"].astype(np.int32), "ndof": (g["n"] - 3).astype(np.int32)}))
    return pa.concat_tables(out)


def nodes_of(fits: DataFrame, nodes_at) -> DataFrame:
    """Nodes at the redshifts and the dust of fits."""
    return nodes_at(fits.select("z", "ebv").distinct())


def fit_metrics(points: DataFrame, fits: DataFrame, nodes: DataFrame, phase_range: float = 60.0) -> DataFrame:
    """One row for each fit: the fit with its coverage, phase counts, chi2 around the peak and relative residual of the
    brightest point. Points and fits meet by object and stay there: the models of few redshifts and dusts are broadcast."""
    f = fits.select("object_id", "template", "t0", "ebv", "amplitude", "chisq", "ndof")
    p = points.join(f, "object_id").withColumn("phase", P.phase())
    few = fits.select("z", "ebv").distinct().limit(S.FEW + 1).count() <= S.FEW
    p = S.at_phase_of_few(p, node_arrays(nodes), "template", "z", "ebv", "band") if few else S.at_phase(p, nodes, "template", "z", "ebv", "band")
    p = p.withColumn("model_flux", F.col("amplitude") * F.col("model_flux"))
    start = F.col("t0") + S.PHASE_0 * (1 + F.col("z"))
    p = p.withColumns({"t_start": start, "t_end": start + phase_range, "t_peak": F.col("t0")})
    keys = ["object_id", "template"]
    peak = P.peak_point(p.filter("time between t_start and t_end"), *keys).select(*keys, ((F.col("flux") - F.col("model_flux")) / F.col("flux")).alias("peak_residual"))
    return f.join(P.coverage(p, *keys), keys).join(P.peak_chi2(p, *keys), keys, "left").join(peak, keys, "left")


def clean_points(points: DataFrame, nodes_at, keep_table=None, window=(-20.0, 100.0), pull_cut: float = 10.0, max_chidof: float = 50.0, min_bands: int = 2, pairs: DataFrame | None = None, hot_rows: int = hot.ROWS) -> tuple[DataFrame, DataFrame]:
    """Fit, drop points outside the phases, fit, drop points with a large pull, fit on what passes both. The second and third
    fit search around the one before.

    Gives one row for each (object_id, template), of pairs where given: the last fit, the cut counts, points by band,
    success; and the points that passed both cuts with phase and model_flux of the last fit. All of an object's rounds are one block's
    work (see blocks), which keep_table makes a table of (the session's checkpoint by default); hot objects (see hot) go by joins.
    """
    keep, keys = keep_table or (lambda df: df.checkpoint()), ["object_id", "template"]
    groups = hot.hot_groups(points, ["object_id"], hot_rows)
    cold, rest = (points, None) if groups is None else hot.split(points, groups, ["object_id"])
    rows = cold.select("object_id", "z", "band", "time", "flux", "fluxerr", "point_id", F.lit(None).cast("string").alias("template"))
    if pairs is not None:
        own = pairs.select(*keys).distinct().join(cold.select("object_id", "z").distinct(), "object_id")
        nothing = [F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in ("band", "time", "flux", "fluxerr", "point_id")]
        rows = rows.join(own.select("object_id").distinct(), "object_id", "left_semi").unionByName(own.select("object_id", "z", *nothing, "template"))
    models = node_arrays(nodes_at(shifts(points.sparkSession, cold, lattice(ROUNDS))))
    chosen = pairs is not None
    done = keep(B.met(rows, models, lambda p, m: cleaned(p, m, chosen, window, pull_cut), CLEANED))
    out = done.drop("passed").withColumns({"lceval": F.map_from_entries("lceval"), "chidof": F.try_divide("chisq", "ndof"), "bands_over": F.size(F.filter("lceval", lambda e: e["n"] > 5))})
    out = out.withColumn("success", (F.col("ndof") >= 1) & (F.col("bands_over") >= min_bands) & F.coalesce(F.col("chidof") <= max_chidof, F.lit(False)))
    good = done.select(*keys, "z", F.inline("passed"))
    if rest is None:
        return out, good
    also, more = cleaned_by_joins(rest, nodes_at, keep_table, window, pull_cut, max_chidof, min_bands, pairs)
    return out.unionByName(also.select(out.columns)), good.unionByName(more.select(good.columns))


_POINT = T.StructType([T.StructField("point_id", T.LongType()), T.StructField("band", T.StringType()), *(T.StructField(c, T.DoubleType()) for c in ("time", "flux", "fluxerr", "phase", "model_flux"))])
CLEANED = T.StructType([
    *(f for f in FITTED.fields if f.name != "coarse"), *(T.StructField(c, T.LongType()) for c in ("dps_init", "dps_tcut", "dps_fcut", "dps_allcut")),
    T.StructField("lceval", T.ArrayType(T.StructType([T.StructField("band", T.StringType()), T.StructField("n", T.LongType())]))), T.StructField("passed", T.ArrayType(_POINT)),
])


def model_at(points: B.Points, f: dict, models: B.Models) -> tuple[np.ndarray, np.ndarray]:
    """Phase of each point by the fit of its row, and the fitted model's flux there, 0 outside its phases (see synphot.at_phase)."""
    phase = (points.time - f["t0"][points.row]) / (1 + points.z)
    x = (phase - S.PHASE_0) / S.PHASE_STEP
    k, last = np.floor(x).astype(int), models.nodes - 2
    use = (k >= 0) & ((k < last) | ((k == last) & (x == k))) & (points.band >= 0)
    at = np.clip(points.band, 0, None) * models.nodes + np.clip(k, 0, last)
    here, after = (m[f["model"][points.row], f["e"][points.row], at] for m in (models.m, models.after))
    return phase, np.where(use, here + (x - k) * (after - here), 0.0) * f["amplitude"][points.row]


def cleaned(table: pa.Table, models: pa.Table, chosen: bool, window, pull_cut: float) -> pa.Table:
    """The rounds of clean_points for a block, as CLEANED. Rows of table with a template name the pairs, where they are chosen."""
    m, out = B.Models(models, ["template"]), [B.empty(CLEANED)]
    of_pair = np.asarray(table.column("template").is_valid())
    pair = table.filter(pa.array(of_pair))
    wanted = set(zip(pair.column("object_id").to_pylist(), pair.column("template").to_pylist(), strict=True))
    table = table.filter(pa.array(~of_pair))
    names, point_id = np.array(table.column("band").to_pylist(), object), np.asarray(table.column("point_id"))
    for ids, p, where in B.parts(table, m):
        f = first_round(p, m, ROUNDS)
        if chosen:
            f = some_of(f, np.array([(i, m.names[t][0]) in wanted for i, t in zip(ids[f["row"]].tolist(), f["model"], strict=True)], bool))
        for begin in range(0, len(f["row"]), B.STEP):
            out.append(clean_pairs(some_of(f, slice(begin, begin + B.STEP)), ids, p, m, names[where], point_id[where], window, pull_cut))
    return pa.concat_tables(out)


def clean_pairs(f: dict, ids, p: B.Points, m: B.Models, names, point_id, window, pull_cut: float) -> pa.Table:
    own, at = p.of(f["row"])
    f = finer_rounds(own, f, m, ROUNDS)

    def again(f, passed):
        g = finer_rounds(own.take(passed, own.row[passed], own.n), f, m, ROUNDS)
        return g | {"chisq": np.where(np.isfinite(f["chisq"]), g["chisq"], np.inf)}

    phase, _ = model_at(own, f, m)
    phase_ok = (phase > max(window[0], S.PHASE_0)) & (phase < min(window[1], 80.0))
    second = again(f, np.flatnonzero(phase_ok))
    _, flux = model_at(own, second, m)
    in_pull = np.abs((own.flux - flux) / own.err) < pull_cut
    passed = phase_ok & in_pull
    third = again(second, np.flatnonzero(passed))
    phase, flux = model_at(own, third, m)
    count = lambda ok: np.bincount(own.row[ok], minlength=own.n)
    counts = [own.count, count(phase_ok), count(in_pull), count(passed)]
    fine = np.isfinite(third["chisq"])
    keep, kept = np.flatnonzero(fine), np.flatnonzero(passed & fine[own.row])
    n, name = count(kept)[keep], names[at][kept]
    each = {b: np.bincount(own.row[kept[name == b]], minlength=own.n) for b in sorted(set(name.tolist()))}
    by_band = [[{"band": b, "n": int(c[i])} for b, c in each.items() if c[i]] for i in keep]
    point = pa.StructArray.from_arrays([pa.array(point_id[at][kept]), pa.array(name, pa.string()), *(pa.array(x[kept]) for x in (own.time, own.flux, own.err, phase, flux))], _POINT.names)
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), point)
    g = some_of(third, keep)
    schema = B.empty(CLEANED).schema
    columns = {
        "object_id": ids[g["row"]], "template": [m.names[i][0] for i in g["model"]], "z": np.full(len(keep), p.z), "ebv": m.ebv[g["e"]], **{c: g[c] for c in ("t0", "amplitude", "chisq", "t_min", "t_max", "t0_node")},
        "ndof": g["n"] - 3, **dict(zip(("dps_init", "dps_tcut", "dps_fcut", "dps_allcut"), (c[keep] for c in counts), strict=True)), "lceval": by_band, "passed": lists,
    }
    return pa.table([pa.array(columns[x.name], x.type) if x.name != "passed" else columns["passed"].cast(x.type) for x in schema], schema=schema)


def cleaned_by_joins(points: DataFrame, nodes_at, keep_table, window, pull_cut: float, max_chidof: float, min_bands: int, pairs: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """clean_points by joins, for objects of any size."""
    keep = keep_table or (lambda df: df.checkpoint())
    keys = ["object_id", "template"]
    last = F.lit(80.0)

    def modelled(fits, own=points):
        on = keys if "template" in own.columns else ["object_id"]
        p = own.join(fits.select(*keys, "t0", "ebv", "amplitude"), on).withColumn("phase", P.phase())
        return S.at_phase(p, nodes_of(fits, nodes_at), "template", "z", "ebv", "band").withColumn("model_flux", F.col("amplitude") * F.col("model_flux"))

    def judged(fits):
        return P.with_pulls(modelled(fits).withColumns({"min_phase": F.lit(S.PHASE_0), "max_phase": last}), window, pull_cut)

    def fit(passed, before):
        """From the fit before on, as points were only dropped. Each pair has points of its own: pairs stand for objects."""
        pair = F.struct(*keys)
        own = keep(passed.select(pair.alias("object_id"), "z", "band", "time", "flux", "fluxerr"))
        found = refined(own, nodes_at, before.withColumn("object_id", pair), keep_table=keep)
        return keep(found.withColumn("object_id", F.col("object_id.object_id")))

    coarse = grid_fit(points, nodes_at(shifts(points.sparkSession, points)))
    first = refined(points, nodes_at, coarse, keep_table=keep)
    first = keep(first if pairs is None else first.join(pairs.select(*keys).distinct(), keys, "left_semi"))
    second = fit(judged(first).filter("in_phase"), first)
    both = keep(judged(first).select(*keys, "point_id", F.col("in_phase").alias("phase_ok")).join(judged(second).drop("t0", "ebv", "amplitude", "phase", "model_flux"), [*keys, "point_id"]))
    passed = both.filter("phase_ok and in_pull")
    third = fit(passed, second)
    cuts = both.withColumn("in_phase", F.col("phase_ok"))
    counts = P.cut_counts(cuts, *keys).join(P.band_counts(cuts.filter("in_phase and in_pull"), *keys).select(*keys, "lceval", "bands_over"), keys, "left")
    out = third.join(counts, keys).withColumn("chidof", F.try_divide("chisq", "ndof"))
    out = out.withColumn("success", (F.col("ndof") >= 1) & (F.coalesce("bands_over", F.lit(0)) >= min_bands) & (F.col("chidof") <= max_chidof))
    return out, modelled(third, passed.select(*keys, "point_id", "z", "band", "time", "flux", "fluxerr"))


def clean_refit(points: DataFrame, nodes_at, **options) -> DataFrame:
    """The fits of clean_points."""
    return clean_points(points, nodes_at, **options)[0]


def refit_warped(points: DataFrame, fits: DataFrame, spectra: DataFrame, surface: DataFrame, bandpass: DataFrame, min_phase: float = S.PHASE_0, r_v: float = 3.1) -> DataFrame:
    """Fit of each pair's warped model (spectra of templates times surface: object_id, template, phase, wave, factor) to all points of its object, in t0
    and ebv around the pair's fit (the warp was made there), in steps of a quarter of the first round. Only acceptable fits
    stay; sf is the chance of a larger chisq. A pair's model is made in its object's block (see blocks), at the dust that is tried."""
    keys = ["object_id", "template"]
    cells = surface.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("phase", "wave", "factor"))).alias("cells"))  # one fixed grid
    pairs = fits.select(*keys, "z", "t0", "ebv", "t_min", "t_max").join(cells, keys)
    light = points.select("object_id", "z", "band", "time", "flux", "fluxerr").join(pairs.select("object_id").distinct(), "object_id", "left_semi")
    rows = light.unionByName(pairs, allowMissingColumns=True)
    zs = points.select("z").distinct()
    rest = F.col("wave") / (1 + F.col("z"))
    weight = F.col("trans") * F.col("wave") * S.WAVE_STEP / F.col("ab") * 10 ** (0.4 * S.ZP) / (1 + F.col("z"))
    lines = bandpass.join(S.ab_scale(bandpass), "band").crossJoin(F.broadcast(zs)).select("z", "band", rest.alias("wave"), dust_ratio(rest, r_v).alias("k"), weight.alias("flux"))
    models = spectra.select("template", "phase", "wave", "flux").crossJoin(F.broadcast(zs)).unionByName(lines, allowMissingColumns=True)
    schema = T.StructType([f for f in FITTED.fields if f.name != "coarse"])
    found = B.met(rows, models, lambda p, m: refitted(p, m, schema, r_v), schema).withColumn("minphase", F.lit(min_phase)).filter("ndof > 0")
    return acceptable(found).withColumn("sf", chi2_survival("chisq", "ndof")).drop("minphase")


class Bands:
    """Bands and phase nodes of models that are made pair by pair."""

    code = B.Models.code

    def __init__(self, bands: list, nodes: int):
        self.bands, self.nodes = np.array(bands), nodes


def refitted(table: pa.Table, models: pa.Table, schema: T.StructType, r_v: float) -> pa.Table:
    """The fits of refit_warped for a block. Rows of models with a template are spectra, others are the lines of the bands; rows of table with a template
    are pairs."""
    is_line = np.asarray(models.column("band").is_valid())
    line, spectra = models.filter(pa.array(is_line)), models.filter(pa.array(~is_line))
    bands = sorted(set(line.column("band").to_pylist()))
    template, phase, wave = (np.asarray(spectra.column(c).to_pylist()) for c in ("template", "phase", "wave"))
    phases, waves = np.unique(phase), np.unique(wave)
    plain = {t: np.zeros((len(phases), len(waves))) for t in set(template.tolist())}
    for t in plain:
        own = template == t
        plain[t][np.searchsorted(phases, phase[own]), np.searchsorted(waves, wave[own])] = np.asarray(spectra.column("flux"), float)[own]
    x = (np.asarray(line.column("wave"), float) - S.WAVE_0) / S.WAVE_STEP
    seen = (x >= 0) & (np.floor(x) < len(waves))
    x, k, weight = x[seen], np.asarray(line.column("k"), float)[seen], np.asarray(line.column("flux"), float)[seen]
    band, node = np.searchsorted(bands, line.column("band").to_pylist())[seen], np.floor(x).astype(int)
    nodes, first = len(phases) + 1, round((phases[0] - S.PHASE_0) / S.PHASE_STEP)
    shape = Bands(bands, nodes + first)

    def warp(t, cells):
        """Light of the pair's model in each line, by phase."""
        out, by = np.zeros((len(phases), len(waves))), {}
        for c in cells:
            by.setdefault(c["phase"], []).append((c["wave"], c["factor"]))
        for at, each in by.items():
            if len(each) in (4, 5) and at in phases:
                w = tuple(v[0] for v in each)
                weights[w] = weights[w] if w in weights else S.wave_weights(list(w))
                i, j = np.searchsorted(phases, at), np.searchsorted(waves, w[0])
                out[i, j : j + len(weights[w])] = plain[t][i, j : j + len(weights[w])] * (weights[w] @ np.array([v[1] for v in each]))
        out = np.maximum(out, 0.0)
        return out[:, node] + (x - node) * (out[:, np.minimum(node + 1, len(waves) - 1)] - out[:, node])

    weights: dict = {}
    of_pair = np.asarray(table.column("template").is_valid())
    pair, table = table.filter(pa.array(of_pair)), table.filter(pa.array(~of_pair))
    pid, out, beside = np.asarray(pair.column("object_id")), [B.empty(schema)], np.arange(1 - PARTS, PARTS)
    if not table.num_rows:
        return out[0]
    for ids, p, _ in B.parts(table, shape):
        own = np.flatnonzero(np.isin(pid, ids))
        for begin in range(0, len(own), B.STEP):
            at = own[begin : begin + B.STEP]
            mine, _ = p.of(np.searchsorted(ids, pid[at]))
            c, e, t_min, t_max = (np.asarray(pair.column(v).take(pa.array(at)), float) for v in ("t0", "ebv", "t_min", "t_max"))
            names, cells = (pair.column(v).take(pa.array(at)).to_pylist() for v in ("template", "cells"))
            lo, hi = t_min - MARGIN, t_max + MARGIN
            t0 = c[:, None] + beside * ((hi - lo) * (1.0 / ((T0_NODES - 1) * PARTS)))[:, None]
            dust = e[:, None] + beside * ((EBV_NODES[1] - EBV_NODES[0]) / PARTS)
            tried = ((t0 >= lo[:, None] - 1e-6) & (t0 <= hi[:, None] + 1e-6))[:, :, None] & ((dust >= EBV_NODES[0]) & (dust <= EBV_NODES[-1]))[:, None, :]
            m = np.zeros((len(at), len(beside), len(bands), shape.nodes))
            for i, (t, cell) in enumerate(zip(names, cells, strict=True)):
                model, dim = warp(t, cell), weight * 10 ** (-0.4 * dust[i][:, None] * r_v * k)
                for b in range(len(bands)):
                    m[i, :, b, first : first + len(phases)] = dim[:, band == b] @ model[:, band == b].T
            after = np.zeros_like(m)
            after[..., :-1] = m[..., 1:]
            m, after = (np.swapaxes(v.reshape(len(at), len(beside), -1), 1, 2) for v in (m, after))
            f, d, o = mine.light(t0, shape)
            amplitude, chisq = B.chisq_of(mine, f @ m, d @ (m * m) + 2 * (o @ (m * after)))
            chisq = np.where(tried, chisq, np.inf)
            place, rows = B.best_of(chisq), np.arange(len(at))
            i, j = np.divmod(place, len(beside))
            best = chisq[rows, i, j]
            g = {"object_id": pid[at], "template": np.array(names, object), "z": np.full(len(at), p.z), "t0": t0[rows, i], "ebv": dust[rows, j], "amplitude": amplitude[rows, i, j], "chisq": best, "t_min": mine.t_min, "t_max": mine.t_max, "t0_node": beside[i], "ndof": mine.count - 3}
            g = some_of(g, np.isfinite(best))
            out.append(pa.table([pa.array(g[n.name], n.type) for n in out[0].schema], schema=out[0].schema))
    return pa.concat_tables(out)
