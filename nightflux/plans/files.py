"""Queries that write the given rows to files and read them back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from nightflux.operators import selection as S
from nightflux.sources import adapters as A
from nightflux.sources import files

from .registry import query, rounded, shared_folder


def path(spark, name: str) -> str:
    return f"{shared_folder(spark)}/nightflux/{name}-{uuid.uuid4().hex}"


@query(A.with_ctes("catalog", " SELECT object_id, type, redshift, round(peakmag, 6) AS peakmag, round(A_V, 6) AS A_V FROM catalog"))
def catalog_file(spark, d):
    """A catalogue with header, redshifts as text."""
    to = path(spark, "catalog")
    A.catalog(spark, d).write.option("header", True).csv(to)
    return rounded(files.read_catalog(spark, to, files.CATALOG.replace("object_id string", "object_id long")), "peakmag", "A_V")


@query("SELECT 'tpl-' || CAST(s_suppkey AS VARCHAR) AS \"Name\", 'nation ' || CAST(s_nationkey AS VARCHAR) AS \"Type\" FROM supplier WHERE s_suppkey % 5 <> 0 AND s_suppkey % 7 <> 0")
def registry_file(spark, d):
    """A registry separated by semicolons, in which some templates are off (#) and some are of the kind that is never used."""
    to, k = path(spark, "registry"), F.col("s_suppkey")
    name = F.concat(F.when(k % 5 == 0, "#").otherwise(""), F.lit("tpl-"), k.cast("string"), F.when(k % 7 == 0, "-salt2").otherwise(""))
    A.table(spark, d, "supplier").select(name.alias("Name"), F.concat(F.lit("nation "), F.col("s_nationkey").cast("string")).alias("Type")).write.option("header", True).option("sep", ";").csv(to)
    return files.read_registry(spark, to)


@query(A.with_ctes("fits", " SELECT model, id, class, success, round(z, 6) AS z, round(chisq, 6) AS chisq, ndof FROM fits"))
def fit_record_file(spark, d):
    """Fit records, nested by model."""
    to = path(spark, "fits")
    files.write_fit_records(A.fits(spark, d).select("model", "id", "class", "success", "z", "chisq", "ndof"), to)
    return rounded(files.read_fit_records(spark, to, "id long, class string, success boolean, z double, chisq double, ndof int", lines=True), "z", "chisq")


@query(A.with_ctes("fits", " SELECT id, model, 'SN Ia' AS class_key, 3 AS version, round(sf, 6) AS sf FROM fits WHERE class = 'SN Ia'"))
def warp_set_file(spark, d):
    """A warp set by class, of which one class is read."""
    to = path(spark, "warps")
    files.write_warp_set(A.fits(spark, d).select("id", "model", "class", "sf"), to)
    return rounded(files.read_warp_set(spark, to, "SN Ia").select("id", "model", "class_key", "version", "sf"), "sf")


@query(A.with_ctes("fits", " SELECT id, model, round(chisq, 6) AS chisq, ndof FROM fits WHERE success"))
def match_file(spark, d):
    """Template matches with header."""
    to = path(spark, "matches")
    files.write_matches(A.fits(spark, d).filter("success").select("id", "model", "chisq", "ndof"), to)
    return rounded(files.read_matches(spark, to, "id long, model string, chisq double, ndof int"), "chisq")


@query(A.with_ctes("fits", " SELECT class, count(*) AS n FROM fits GROUP BY class"))
def appended_log(spark, d):
    """A log to which rows are added twice."""
    to, fits = path(spark, "log"), A.fits(spark, d).select("id", "class")
    for half in (0, 1):
        files.append_rows(fits.filter(F.col("id") % 2 == half), to)
    return spark.read.parquet(to).groupBy("class").agg(F.count("*").alias("n"))


@query(A.with_ctes("fits", " SELECT 'SN Ia' AS class, 0.0::DOUBLE AS z_min, 0.07::DOUBLE AS z_max, count(DISTINCT id) AS n_fit, count(DISTINCT id) FILTER (success AND peak_good) AS n_good, count(DISTINCT id) FILTER (success AND peak_good AND z BETWEEN 0 AND 0.07) AS n_volume FROM fits WHERE class = 'SN Ia'"))
def audit_log(spark, d):
    """The audit row of a run over one class (its time is left out)."""
    to = path(spark, "audit")
    files.append_rows(files.audit_rows(S.volume_counts(A.fits(spark, d).filter("class = 'SN Ia'")), "SN Ia", (0.0, 0.07)), to)
    return spark.read.parquet(to).drop("at")


@query(A.with_ctes("fits", " SELECT id, model, round(chisq, 6) AS chisq, round(sf, 6) AS sf, round(peakchi, 6) AS peakchi FROM fits"))
def pruned_records(spark, d):
    """Records without some columns and some nested fields."""
    nested = A.fits(spark, d).select("id", "model", "z", F.struct("chisq", "ndof", "sf").alias("fit"), F.struct("peakchi", "peakdet").alias("peak"))
    out = files.pruned(nested, ["z"], {"fit": ["ndof"], "peak": ["peakdet"]})
    return rounded(out.select("id", "model", "fit.*", "peak.*"), "chisq", "sf", "peakchi")
