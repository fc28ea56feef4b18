"""Queries on the class hierarchy."""

from __future__ import annotations

from pyspark.sql import functions as F

from nightflux.operators import taxonomy as T
from nightflux.sources import adapters as A

from .registry import query


def case(column: str, pairs: dict) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in pairs.items()) + f" ELSE {column} END"


def hierarchy(levels) -> str:
    """Common table expressions l0 to l3 on catalog."""
    out, source, column = "", "catalog", "type"
    for i, (level, pairs) in enumerate(levels):
        out += f", l{i} AS (SELECT *, {case(column, pairs)} AS type_{level} FROM {source})"
        source, column = f"l{i}", f"type_{level}"
    return out


LEVELS, OLD = hierarchy(T.LEVELS), hierarchy(T.LEGACY_LEVELS)
listed = lambda xs: ", ".join(f"'{x}'" for x in xs)


def bounds(ranges: dict, default: tuple, column: str, i: int) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{c}' THEN {r[i]!r}::DOUBLE" for c, r in ranges.items()) + f" ELSE {default[i]!r}::DOUBLE END"


@query(A.with_ctes("catalog", f"{LEVELS} SELECT object_id, type, type_n, type_e, type_w, type_a, TRY_CAST(redshift AS DOUBLE) AS z FROM l3"))
def class_hierarchy(spark, d):
    return T.numeric(T.add_classes(A.catalog(spark, d)), "redshift").select("object_id", "type", "type_n", "type_e", "type_w", "type_a", F.col("redshift").alias("z"))


@query(A.with_ctes("catalog", f"{OLD} SELECT object_id, type, type_n, type_e, type_w, type_a FROM l3"))
def class_hierarchy_legacy(spark, d):
    return T.add_classes(A.catalog(spark, d), levels=T.LEGACY_LEVELS).select("object_id", "type", "type_n", "type_e", "type_w", "type_a")


@query(f"SELECT o_orderkey AS object_id, o_orderpriority AS type FROM orders WHERE o_orderpriority IN ({listed(T.KNOWN_CLASSES)}, '1-URGENT') AND o_orderpriority NOT IN ({listed(T.NOT_SUPERNOVAE)}) AND o_orderkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def class_purge(spark, d):
    """Known classes, no other kinds of object, no rejected ids."""
    rejected = A.table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select("c_custkey")
    o = A.table(spark, d, "orders").select(F.col("o_orderkey").alias("object_id"), F.col("o_orderpriority").alias("type"))
    known = o.filter(F.col("type").isin(*T.KNOWN_CLASSES, "1-URGENT") & ~F.col("type").isin(T.NOT_SUPERNOVAE))
    return known.join(rejected, F.col("object_id") == F.col("c_custkey"), "left_anti")


@query(A.with_ctes("catalog", f"{LEVELS}, k AS (SELECT * FROM l3 WHERE type IN ({listed(T.KNOWN_CLASSES)})) SELECT level, class, count(*) AS n FROM (SELECT unnest(['type', 'type_n', 'type_e', 'type_w', 'type_a']) AS level, unnest([type, type_n, type_e, type_w, type_a]) AS class FROM k) GROUP BY level, class"))
def class_counts(spark, d):
    return T.class_counts(T.add_classes(A.catalog(spark, d), purge=True))


@query(A.with_ctes("catalog", f"{LEVELS} SELECT DISTINCT type_n AS narrow FROM l3 WHERE type_w = 'SN Ib/c (w)'"))
def target_narrow_classes(spark, d):
    return T.narrow_classes(T.add_classes(A.catalog(spark, d)), "w", "SN Ib/c (w)")


@query(A.with_ctes("catalog", " SELECT type, redshift FROM catalog WHERE type <> '-' AND redshift <> '-' AND TRY_CAST(redshift AS DOUBLE) > 0.05"))
def sentinel_filter(spark, d):
    rows = T.without_missing(A.catalog(spark, d), "type", "redshift")
    return rows.filter(F.expr("try_cast(redshift as double)") > 0.05).select("type", "redshift")


@query(A.with_ctes("fits", f" SELECT id, model, class, z FROM fits WHERE z BETWEEN {bounds(T.Z_RANGES, T.Z_RANGE, 'class', 0)} AND {bounds(T.Z_RANGES, T.Z_RANGE, 'class', 1)}"))
def redshift_range(spark, d):
    return T.in_range(A.fits(spark, d), "class", "z").select("id", "model", "class", "z")


@query(A.with_ctes("fits", f" SELECT id, model, class IN ({listed([t for t, c in T.CLOSE_TYPES.items() if 'SN Ib/c (w)' in c])}) AS correct FROM fits"))
def truth_class(spark, d):
    return A.fits(spark, d).select("id", "model", T.true_class("class", "SN Ib/c (w)").alias("correct"))


@query(A.with_ctes("catalog", f" SELECT object_id, CASE WHEN type IN ({listed(T.RED_CLASSES)}) THEN 'ztfr' ELSE 'bessellb' END AS color1, CASE WHEN type IN ({listed(T.RED_CLASSES)}) THEN 'ztfi' ELSE 'bessellv' END AS color2, replace(type, '/', '') AS class_key FROM catalog"))
def color_band_choice(spark, d):
    one, two = T.color_bands("type")
    return A.catalog(spark, d).select("object_id", one.alias("color1"), two.alias("color2"), T.storage_key("type").alias("class_key"))
