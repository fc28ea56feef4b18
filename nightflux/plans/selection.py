"""Queries on fits: quality, ranking, probabilities."""

from __future__ import annotations

from pyspark.sql import functions as F

from nightflux.functions.astro import DISTMOD_CTE, chi2_survival, chi2_survival_even, distmod_sql, with_distance_modulus
from nightflux.operators import selection as S
from nightflux.operators import taxonomy as T
from nightflux.operators import warpset as W
from nightflux.sources import adapters as A
from nightflux.sources import files

from .classes import listed
from .registry import query, rounded

TARGET = "SN CC (a)"
TRUE = listed([t for t, c in T.CLOSE_TYPES.items() if TARGET in c])
GOOD = f""", good AS (SELECT id, model, class, z, chisq, ndof, ndet, nbr_bands, peakdet, peakchi, peak_good, peakmag, sf, 2 * (ndet - ndof) + chisq AS aic, peakdet - (ndet - ndof) AS peakndof, peakchi / (peakdet - (ndet - ndof)) AS chidof,
    peakchi / (peakdet - (ndet - ndof)) < 6 AS goodfit, class IN ({TRUE}) AS correct FROM fits WHERE success AND peakdet - (ndet - ndof) > 0)"""
ORDERED = ", ordered AS (SELECT *, CASE WHEN correct AND goodfit THEN 2 WHEN correct THEN 1 ELSE 0 END AS priority FROM good)"


def good(spark, d, together: bool = False):
    return S.good_fits(A.fits(spark, d, together), 6.0, TARGET)


@query(A.with_ctes("fits", f"{GOOD} SELECT id, model, round(aic, 9) AS aic, peakndof, round(chidof, 9) AS chidof, goodfit, correct FROM good"))
def fit_quality(spark, d):
    return rounded(good(spark, d).select("id", "model", "aic", "peakndof", "chidof", "goodfit", "correct"), "aic", "chidof", digits=9)


@query(A.with_ctes("fits", f"{GOOD} SELECT count(*) AS pairs, count_if(correct)::BIGINT AS correct, count_if(goodfit)::BIGINT AS good, count_if(correct AND goodfit)::BIGINT AS both FROM good"))
def pair_totals(spark, d):
    return S.pair_totals(good(spark, d))


@query(A.with_ctes("fits", f"{GOOD}, {DISTMOD_CTE}, best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY chidof, model) AS n FROM good) WHERE n = 1) SELECT id, model, z, nbr_bands, peakndof, round(peakmag - {distmod_sql('z')}, 4) AS absmag FROM best"))
def object_summary(spark, d):
    """Best fit of each object with its absolute magnitude."""
    best = with_distance_modulus(S.best_per(good(spark, d), ["id"], "chidof", "model"))
    return best.select("id", "model", "z", "nbr_bands", "peakndof", F.round(F.col("peakmag") - F.col("distmod"), 4).alias("absmag"))


@query(A.with_ctes("fits", f"{GOOD}, best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY chidof, model) AS n FROM good) WHERE n = 1), seeds AS (SELECT id, z FROM best WHERE z > 0.01 AND z < 0.04 AND nbr_bands >= 2 AND peakndof >= 6) SELECT s.id, s.z, g.model, round(g.chidof, 9) AS chidof FROM seeds s JOIN good g ON s.id = g.id WHERE g.correct"))
def seed_matches(spark, d):
    """Seeds by strict cuts, joined with their fits by true classes."""
    g = good(spark, d)
    seeds = S.seeds(S.best_per(g, ["id"], "chidof", "model")).select("id", "z")
    return rounded(seeds.join(g.filter("correct").select("id", "model", "chidof"), "id"), "chidof", digits=9)


def _side(i: int) -> str:
    return "CASE type " + " ".join(f"WHEN '{c}' THEN {r[i]!r}" for c, r in T.SEED_RANGES.items()) + f" ELSE {T.SEED_RANGE[i]!r} END"


@query(A.with_ctes("photometry catalog", f", n AS (SELECT object_id, count(DISTINCT band) AS nbr_bands, count(*) - 3 AS peakndof FROM photometry GROUP BY 1) SELECT object_id, type, CAST(redshift AS DOUBLE) AS z, nbr_bands, peakndof FROM catalog JOIN n USING (object_id) WHERE redshift <> '-' AND CAST(redshift AS DOUBLE) > {_side(0)} AND CAST(redshift AS DOUBLE) < {_side(1)} AND nbr_bands >= 2 AND peakndof >= 6"))
def class_seeds(spark, d):
    """Objects that may seed corrections: enough bands and points, and a redshift within the range of their own class."""
    n = A.photometry(spark, d).groupBy("object_id").agg(F.count_distinct("band").alias("nbr_bands"), (F.count("*") - 3).alias("peakndof"))
    objects = T.numeric(T.without_missing(A.catalog(spark, d), "redshift"), "redshift").select("object_id", "type", F.col("redshift").alias("z"))
    return S.seeds(objects.join(n, "object_id"), ranges=T.SEED_RANGES, column="type").select("object_id", "type", "z", "nbr_bands", "peakndof")


@query(A.with_ctes("fits", f"{GOOD}{ORDERED} SELECT id, model, priority, nth FROM (SELECT id, model, priority, coalesce(sum(CAST(sf > 0.5 AS INTEGER)) OVER (PARTITION BY id ORDER BY priority DESC, chidof, model ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, row_number() OVER (PARTITION BY id ORDER BY priority DESC, chidof, model)::INTEGER AS nth FROM ordered) WHERE before < 2"))
def early_stop(spark, d):
    """Pairs in order of priority until two are good."""
    rows = S.until_enough(S.prioritised(good(spark, d)), "id", F.col("sf") > 0.5, 2)
    w = S.Window.partitionBy("id").orderBy(*S.by_priority())
    return rows.select("id", "model", "priority", F.row_number().over(w).alias("nth"))


@query(A.with_ctes("fits", " SELECT id, model, many AS good_fit FROM (SELECT id, model, sf, count_if(sf > 0.5) OVER (PARTITION BY id) >= 3 AS many, row_number() OVER (PARTITION BY id ORDER BY sf DESC, model) AS n FROM fits) WHERE CASE WHEN many THEN sf > 0.5 ELSE n <= 3 END"))
def likely_or_best(spark, d):
    return S.likely_or_best(A.fits(spark, d), "id", "sf", 0.5).select("id", "model", "good_fit")


DRAW = "CASE WHEN sum(greatest(sf - 0.01::DOUBLE, 0)) OVER (PARTITION BY id) > 0 THEN greatest(sf - 0.01::DOUBLE, 0) / sum(greatest(sf - 0.01::DOUBLE, 0)) OVER (PARTITION BY id) ELSE 1.0::DOUBLE / count(*) OVER (PARTITION BY id) END"


@query(A.with_ctes("fits", f" SELECT id, model, round(0.01::DOUBLE + (1.0 - 0.01::DOUBLE * count(*) OVER (PARTITION BY id)) * {DRAW}, 9) AS draw_prob FROM fits"))
def draw_probability(spark, d):
    return rounded(S.draw_probability(A.fits(spark, d), "id", "sf").select("id", "model", "draw_prob"), "draw_prob", digits=9)


@query(A.with_ctes("fits", f"{GOOD}, w AS (SELECT *, exp(-(aic - min(aic) OVER (PARTITION BY id)) / 2) AS w, row_number() OVER (PARTITION BY id ORDER BY aic, model) AS nth FROM good), x AS (SELECT *, w / sum(w) OVER (PARTITION BY id) > 0.001 AS m FROM w) SELECT id, max(model) FILTER (nth = 1) AS model, count_if(m)::BIGINT AS matches, array_to_string(list_sort(list_distinct(list(class) FILTER (m))), '_') AS types, bool_and(correct) FILTER (m) AS allgood FROM x GROUP BY id"))
def akaike_weights(spark, d):
    return S.akaike(good(spark, d), "id")


@query(A.with_ctes("fits", " SELECT count(DISTINCT id) AS n_fit, count(DISTINCT id) FILTER (success AND peak_good) AS n_good, count(DISTINCT id) FILTER (success AND peak_good AND z BETWEEN 0 AND 0.07) AS n_volume FROM fits"))
def volume_counts(spark, d):
    return S.volume_counts(A.fits(spark, d))


@query(A.with_ctes("fits", " SELECT class, count(chidof) AS n, round(avg(chidof), 6) AS mean, round(stddev_samp(chidof), 6) AS sd, round(min(chidof), 9) AS lo, round(quantile_cont(chidof, 0.25), 9) AS q25, round(quantile_cont(chidof, 0.5), 9) AS q50, round(quantile_cont(chidof, 0.75), 9) AS q75, round(max(chidof), 9) AS hi FROM fits GROUP BY class"))
def describe_by_class(spark, d):
    return rounded(rounded(S.describe(A.fits(spark, d), "class", "chidof"), "mean", "sd"), "lo", "q25", "q50", "q75", "hi", digits=9)


@query(A.with_ctes("catalog", " SELECT object_id, template, type, TRY_CAST(redshift AS DOUBLE) AS z FROM catalog, (VALUES ('tpl-0'), ('tpl-1'), ('tpl-2'), ('tpl-3')) t(template) WHERE redshift <> '-'"))
def fit_matrix(spark, d):
    """Every object with every template of a registry of four."""
    templates = spark.createDataFrame([(f"tpl-{i}",) for i in range(4)], "template string")
    objects = T.numeric(T.without_missing(A.catalog(spark, d), "redshift"), "redshift")
    return objects.join(F.broadcast(templates)).select("object_id", "template", "type", F.col("redshift").alias("z"))


@query(A.with_ctes("catalog fits", f"{GOOD}, b AS (SELECT DISTINCT id AS base_id, class, model FROM good WHERE goodfit) SELECT c.object_id, count(*) AS n, min(base_id) AS first_base FROM catalog c JOIN b ON c.type = b.class WHERE base_id <> object_id GROUP BY c.object_id"))
def leave_one_out(spark, d):
    """Warp models of an object's class that were not made from it (an order is an object here): their number and least base."""
    bases = good(spark, d).filter("goodfit").select("id", "class", "model").distinct()
    objects = A.catalog(spark, d).select("object_id", F.col("type").alias("class"))
    return W.leave_one_out_counts(objects, bases)


@query(A.with_ctes("fits", " SELECT o_orderkey AS object_id, o_orderkey IN (SELECT id FROM fits WHERE class = 'SN Ia') AS own_base FROM orders WHERE o_orderkey IN (SELECT id FROM fits WHERE success) AND o_orderkey NOT IN (SELECT id FROM fits WHERE sf > 0.9)"))
def fitted_not_done(spark, d):
    """Objects with a fit (semi join), without those already processed (anti join); whether one is its own base."""
    f = A.fits(spark, d)
    o = A.table(spark, d, "orders").select(F.col("o_orderkey").alias("object_id"))
    on = F.col("object_id") == F.col("id")
    left = o.join(f.filter("success"), on, "left_semi").join(f.filter("sf > 0.9"), on, "left_anti")
    own = f.filter("class = 'SN Ia'").select(F.col("id").alias("own")).distinct()
    return left.join(own, F.col("object_id") == F.col("own"), "left").select("object_id", F.col("own").isNotNull().alias("own_base"))


@query(A.with_ctes("fits", " SELECT id, model, sf FROM fits WHERE CAST(id AS VARCHAR) NOT IN ('1', '2', '3', 'tpl-1', 'tpl-7') AND model NOT IN ('1', '2', '3', 'tpl-1', 'tpl-7') AND CAST(id AS VARCHAR) || '_' || model NOT IN ('4_tpl-2', '5_tpl-3')"))
def excluded(spark, d):
    """One list of names against objects and templates, and a veto list of pairs."""
    f = A.fits(spark, d).withColumn("name", F.col("id").cast("string"))
    names = spark.createDataFrame([("1",), ("2",), ("3",), ("tpl-1",), ("tpl-7",)], "listed string")
    vetoes = spark.createDataFrame([("4_tpl-2",), ("5_tpl-3",)], "pair string")
    kept = S.without(f, names, "name", "model").withColumn("both", F.concat_ws("_", "name", "model"))
    return S.without(kept, vetoes, "both").select("id", "model", "sf")


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 20")
def first_rows(spark, d):
    """A top-k report."""
    return A.table(spark, d, "orders").select("o_orderkey", "o_custkey").orderBy("o_orderkey").limit(20)


@query(A.with_ctes("fits", " SELECT id, model, class, success, round(chisq, 6) AS chisq, ndof FROM fits"))
def fit_records(spark, d):
    """Fits as records {model: [fit, ...]} of each object, and flat again."""
    f = A.fits(spark, d).withColumn("id", F.col("id").cast("string"))
    fields = F.struct("id", "success", "chisq", "ndof", "class")
    by = f.groupBy("id", "model").agg(F.collect_list(fields).alias("fits"))
    record = F.to_json(F.create_map("model", "fits"))
    flat = files.flat_records(by.select(record.alias("record")), "id string, success boolean, chisq double, ndof int, class string")
    return rounded(flat.select(F.col("id").cast("long").alias("id"), "model", "class", "success", "chisq", "ndof"), "chisq")


@query(A.with_ctes("fits", " SELECT f.id, f.model, round(f.sf, 6) AS sf, l.n AS n_rows FROM fits f JOIN (SELECT CAST(l_orderkey AS VARCHAR) || '_tpl-' || CAST(l_suppkey AS VARCHAR) AS k, count(*) AS n FROM lineitem GROUP BY 1) l ON l.k = CAST(f.id AS VARCHAR) || '_' || f.model"))
def warp_data_lookup(spark, d):
    """Warp data of a fit, by object and model."""
    li = A.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id"), F.concat(F.lit("tpl-"), F.col("l_suppkey").cast("string")).alias("model")).agg(F.count("*").alias("n_rows"))
    return rounded(A.fits(spark, d).join(li, ["id", "model"]).select("id", "model", "sf", "n_rows"), "sf")


@query(A.with_ctes("fits", " SELECT class, count(*) AS n, count(DISTINCT model) AS models FROM (SELECT class, model FROM fits WHERE sf > 0.5 UNION ALL SELECT class, model FROM fits WHERE chidof < 3) GROUP BY class"))
def combined_fits(spark, d):
    """Fit lists of two runs, one after the other."""
    f = A.fits(spark, d)
    both = f.filter("sf > 0.5").select("class", "model").unionByName(f.filter("chidof < 3").select("class", "model"))
    return both.groupBy("class").agg(F.count("*").alias("n"), F.count_distinct("model").alias("models"))


@query(A.with_ctes("fits", " SELECT id, arg_max(model, {'s': sf, 'm': model}) AS model, max(sf) AS sf FROM fits GROUP BY id"))
def peak_template(spark, d):
    """The template of highest survival of each object."""
    return A.fits(spark, d).groupBy("id").agg(F.max_by("model", F.struct("sf", "model")).alias("model"), F.max("sf").alias("sf"))


EVEN = "exp(-h) * list_sum(list_transform(range(0, CAST(dof / 2 AS BIGINT)), lambda i: pow(h, i) / gamma(i + 1)))"


@query(A.with_ctes("fits", f" SELECT id, model, round({EVEN}, 6) AS sf_even FROM (SELECT id, model, chisq / 20 / 2 AS h, 2 * (1 + id % 6) AS dof FROM fits)"))
def survival_even(spark, d):
    f = A.fits(spark, d).select("id", "model", (F.col("chisq") / 20).alias("c"), (2 * (1 + F.col("id") % 6)).alias("dof"))
    return f.select("id", "model", F.round(chi2_survival_even(F.col("c"), F.col("dof")), 6).alias("sf_even"))


# one less the integral of the density up to chi2, by Simpson's rule on 3000 steps; there are over 2 degrees of freedom
LEFT = "1 - h / 3 * exp(-a * ln(2.0) - lgamma(a)) * list_sum(list_transform(range(1, 3001), lambda i: CASE WHEN i = 3000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp((a - 1) * ln(i * h) - i * h / 2)))"


@query(A.with_ctes("fits", f" SELECT id, model, round({LEFT}, 6) AS sf FROM (SELECT id, model, chisq / 3000 AS h, ndof / 2.0::DOUBLE AS a FROM fits)"))
def survival(spark, d):
    """Any number of degrees of freedom, odd ones too."""
    f = A.fits(spark, d)
    return f.select("id", "model", F.round(chi2_survival("chisq", "ndof"), 6).alias("sf"))


@query(A.with_ctes("fits", " SELECT id, model, class, round(chidof, 12) AS prechi, sf AS postsf, round(exp(-chisq / 100), 9) AS likelihood FROM fits WHERE success"))
def before_after(spark, d):
    return A.fits(spark, d).filter("success").select("id", "model", "class", F.round("chidof", 12).alias("prechi"), F.col("sf").alias("postsf"), F.round(F.exp(-F.col("chisq") / 100), 9).alias("likelihood"))


METRICS = "(SELECT id, model, (id * 7 % 9)::INTEGER AS premod, (id % 3)::INTEGER AS postmod, z * 10 - 3.5 AS predt, sf - 0.5 AS postdt, chidof / 2 AS peak_residual, ndof AS t0diff, sf * 5 AS presum, sf * 6 AS postsum, peakdet - 1 AS earlydet, peakdet - 2 AS postdet, nbr_bands AS latedet FROM fits)"


@query(A.with_ctes("fits", f" SELECT id, model, NOT (t0diff > 15 OR presum < 3 OR postsum < 3 OR earlydet < 2 OR postdet < 2 OR latedet < 2) AS peak_good FROM {METRICS} WHERE premod <= 1 AND postmod <= 1 AND predt >= -3 AND postdt <= 3 AND peak_residual BETWEEN 0.5 AND 1.5"))
def accepted_pairs(spark, d):
    """Coverage and residual cuts, then the flag of a well-sampled peak."""
    m = A.fits(spark, d).select("id", "model", (F.col("id") * 7 % 9).alias("premod"), (F.col("id") % 3).alias("postmod"), (F.col("z") * 10 - 3.5).alias("predt"), (F.col("sf") - 0.5).alias("postdt"), (F.col("chidof") / 2).alias("peak_residual"), F.col("ndof").alias("t0diff"), (F.col("sf") * 5).alias("presum"), (F.col("sf") * 6).alias("postsum"), (F.col("peakdet") - 1).alias("earlydet"), (F.col("peakdet") - 2).alias("postdet"), F.col("nbr_bands").alias("latedet"))
    return S.covered(m).select("id", "model", S.peak_good().alias("peak_good"))


@query("SELECT o_orderkey AS id FROM (SELECT o_orderkey, o_orderkey % 50 AS t0, o_custkey % 20 AS t_min, o_custkey % 20 + 40 AS t_max, -20 AS minphase FROM orders) WHERE t0 BETWEEN t_min AND t_max AND t_min - t0 >= minphase - 3 AND t_min - t0 <= 5")
def acceptable_fits(spark, d):
    o = A.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 50).alias("t0"), (F.col("o_custkey") % 20).alias("t_min"), (F.col("o_custkey") % 20 + 40).alias("t_max"), F.lit(-20).alias("minphase"))
    return S.acceptable(o).select("id")
