"""Queries on warp sets: assembly, sizes, samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from nightflux.functions.astro import uniform_sql
from nightflux.operators import selection as S
from nightflux.operators import warpset as W
from nightflux.sources import adapters as A

from .registry import query, rounded
from .selection import GOOD, ORDERED, good

EXCESS = "greatest(sf - 0.01::DOUBLE, 0)"
DRAWN = f"0.01::DOUBLE + (1.0 - 0.01::DOUBLE * count(*) OVER g) * CASE WHEN sum({EXCESS}) OVER g > 0 THEN {EXCESS} / sum({EXCESS}) OVER g ELSE 1.0::DOUBLE / count(*) OVER g END"


def warp_sql(source: str, name: str = "ws") -> str:
    return f""", {name}_s AS (SELECT *, coalesce(sum(CAST(sf > 0.5 AS INTEGER)) OVER (PARTITION BY id ORDER BY priority DESC, chidof, model ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM {source}),
    {name} AS (SELECT id, model, class, z, sf, peakmag, CASE WHEN sf > 0.5 AND priority = 2 THEN 'gold' WHEN sf > 0.5 AND priority = 1 THEN 'silver' ELSE 'bronze' END AS quality, {DRAWN} AS draw_prob FROM {name}_s WHERE before < 5 WINDOW g AS (PARTITION BY id))"""


KEPT = "(SELECT * FROM ordered WHERE goodfit AND sf >= 0.01 AND NOT contains(model, 'salt'))"
ALL = "(SELECT * FROM ordered WHERE sf >= 0.01 AND NOT contains(model, 'salt'))"
WARPS = f"{GOOD}{ORDERED}{warp_sql(KEPT)}"
LOOSE = f"{GOOD}{ORDERED}{warp_sql(ALL)}"


def warps(spark, d, prefilter: bool = True):
    return W.warp_set(good(spark, d, together=True), prefilter=prefilter)


@query(A.with_ctes("fits", f"{WARPS} SELECT id, model, quality, round(draw_prob, 9) AS draw_prob FROM ws"))
def warp_set(spark, d):
    return rounded(warps(spark, d).select("id", "model", "quality", "draw_prob"), "draw_prob", digits=9)


@query(A.with_ctes("fits", f"{LOOSE} SELECT id, model, quality, round(draw_prob, 9) AS draw_prob FROM ws"))
def warp_set_with_silver(spark, d):
    """Without the cut on first fits, so that silver can occur."""
    return rounded(warps(spark, d, False).select("id", "model", "quality", "draw_prob"), "draw_prob", digits=9)


@query(A.with_ctes("fits", f"{GOOD}, t AS (SELECT *, count_if(sf > 0.01) OVER (PARTITION BY id) >= 3 AS many, row_number() OVER (PARTITION BY id ORDER BY sf DESC, model) AS n FROM good WHERE correct AND nbr_bands >= 2 AND peakdet >= 6), k AS (SELECT * FROM t WHERE CASE WHEN many THEN sf > 0.01 ELSE n <= 3 END) SELECT id, model, many AS good_fit, round({DRAWN}, 9) AS draw_prob FROM k WINDOW g AS (PARTITION BY id)"))
def warp_set_simple(spark, d):
    return rounded(W.warp_set_simple(good(spark, d)).select("id", "model", "good_fit", "draw_prob"), "draw_prob", digits=9)


@query(A.with_ctes("fits", f"{WARPS}, n AS (SELECT id, count(*)::INTEGER AS n FROM ws GROUP BY 1) SELECT id, n, (SELECT count(*) FROM ws w WHERE w.id = n.id AND quality = 'gold')::INTEGER AS gold FROM n"))
def warp_records(spark, d):
    """One row for each object with its models nested, as it is stored; its numbers of models."""
    nested = warps(spark, d).groupBy("id").agg(F.collect_list(F.struct("model", "quality", "draw_prob")).alias("models"))
    return nested.select("id", F.size("models").alias("n"), F.size(F.filter("models", lambda m: m.quality == "gold")).alias("gold"))


@query(A.with_ctes("fits", f"{LOOSE} SELECT count(*) FILTER (quality = 'gold') AS gold_models, count(DISTINCT id) FILTER (quality = 'gold') AS gold_objects, count(*) FILTER (quality IN ('gold', 'silver')) AS silver_models, count(DISTINCT id) FILTER (quality IN ('gold', 'silver')) AS silver_objects, count(*) AS bronze_models, count(DISTINCT id) AS bronze_objects, CAST(sum(CASE quality WHEN 'gold' THEN 3 WHEN 'silver' THEN 2 ELSE 1 END) AS BIGINT) AS score FROM ws"))
def warp_set_sizes(spark, d):
    return S.quality_sizes(warps(spark, d, False))


@query(A.with_ctes("fits", f"{LOOSE} SELECT id, CAST(sum(CASE quality WHEN 'gold' THEN 3 WHEN 'silver' THEN 2 ELSE 1 END) AS BIGINT) AS score FROM ws GROUP BY id"))
def warp_scores(spark, d):
    """Score of each object by the quality of its warps."""
    return S.quality_scores(warps(spark, d, False))


@query(A.with_ctes("fits", f"{LOOSE} SELECT id, model, quality FROM ws WHERE quality IN ('gold', 'silver') AND model NOT IN ('tpl-1', 'tpl-2')"))
def quality_filter(spark, d):
    w = S.min_quality(warps(spark, d, False), "Silver").filter(~F.col("model").isin("tpl-1", "tpl-2"))
    return w.select("id", "model", "quality")


SEED = 7
def sample_sql(draws: int) -> str:
    return f"""{WARPS}, o AS (SELECT DISTINCT id, CAST('0x' || substr(md5(CAST(id AS VARCHAR)), 1, 8) AS BIGINT) % 256 AS block FROM ws), k AS (SELECT id, row_number() OVER (ORDER BY block, id) - 1 AS rank, count(*) OVER () AS total FROM o),
    dr AS (SELECT draw, CAST(floor({uniform_sql(SEED, 'draw')} * (SELECT max(total) FROM k)) AS BIGINT) AS rank FROM (SELECT unnest(range(0, {draws}))::INTEGER AS draw)), b AS (SELECT draw, id FROM dr JOIN k USING (rank)),
    q AS (SELECT *, draw_prob / sum(draw_prob) OVER (PARTITION BY draw, id) AS p FROM b JOIN ws USING (id)), h AS (SELECT *, sum(p) OVER (PARTITION BY draw, id ORDER BY model) AS hi, lead(model) OVER (PARTITION BY draw, id ORDER BY model) IS NULL AS last FROM q),
    u AS (SELECT *, {uniform_sql(SEED + 1, 'draw', 'id', 'nth')} AS u FROM (SELECT *, unnest([0, 1])::INTEGER AS nth FROM h))"""


SAMPLE = sample_sql(200)


@query(A.with_ctes("fits", f"{SAMPLE} SELECT draw, id, nth, model FROM u WHERE u >= hi - p AND (u < hi OR last)"))
def served_sample(spark, d):
    """200 draws of objects with replacement, two templates for each by their probability."""
    return W.serve(warps(spark, d), 200, 2, SEED).select("draw", "id", "nth", "model")


@query(A.with_ctes("fits", f"{WARPS} SELECT id, model, (row_number() OVER (PARTITION BY id ORDER BY model) - 1)::INTEGER AS nth FROM ws WHERE model NOT IN ('tpl-3')"))
def served_all(spark, d):
    return W.serve(warps(spark, d), "all", "all", exclude=["tpl-3"]).select("id", "model", "nth")


RANKED = f"{GOOD}, r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY chidof, model) AS nth FROM good WHERE chidof < 100 AND peakndof >= 3), best AS (SELECT * FROM r WHERE nth = 1)"


@query(A.with_ctes("fits", f"{RANKED} SELECT id, model, round(chidof, 9) AS rankchi FROM best"))
def ranked_models(spark, d):
    """The best model of each object by chi2 per degree of freedom, among well-sampled ones."""
    r = W.ranked_models(good(spark, d), per="id", chidof=("chidof", "peakchisqdof"), peakdof="peakndof")
    return rounded(r.select("id", "model", "rankchi"), "rankchi", digits=9)


@query(A.with_ctes("fits", f"{RANKED} SELECT model, count(*) AS n FROM best GROUP BY model"))
def template_usage(spark, d):
    return W.usage(W.ranked_models(good(spark, d), per="id", peakdof="peakndof"), "model")


@query("SELECT l_orderkey AS id, count(*) AS n, count(DISTINCT l_extendedprice) < count(*) AS constant FROM lineitem GROUP BY 1")
def constant_models(spark, d):
    """Whether a model repeats fluxes, which a real one doesn't."""
    li = A.table(spark, d, "lineitem")
    return li.groupBy(F.col("l_orderkey").alias("id")).agg(F.count("*").alias("n"), (F.count_distinct("l_extendedprice") < F.count("*")).alias("constant"))
