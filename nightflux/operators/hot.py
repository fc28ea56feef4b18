"""Groups that hold so many rows that no task should have one whole: which they are, and exact medians of them.

There are at most SHARE of them by their definition, so what is known of them by group is small enough to broadcast and to steer
from the driver; their rows are never dealt by group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A group is hot if it has over ROWS rows and over one of SHARE of all.
ROWS, SHARE = 500_000, 1000
#: Bins of a pass over the values, and the values that are sorted in the end.
BINS, FEW = 1024, 10_000


def hot_groups(df: DataFrame, keys, rows: int = ROWS) -> DataFrame | None:
    """keys of the hot groups, SHARE rows at most; None where there are none."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("__rows"))
    total, most = counts.agg(F.sum("__rows"), F.max("__rows")).first()
    least = max(rows, (total or 0) // SHARE)
    return counts.filter(F.col("__rows") > least).select(*keys) if (most or 0) > least else None


def split(df: DataFrame, groups: DataFrame, keys) -> tuple[DataFrame, DataFrame]:
    """The rows of other groups, and those of groups."""
    return df.join(F.broadcast(groups), list(keys), "left_anti"), df.join(F.broadcast(groups), list(keys), "left_semi")


def medians(df: DataFrame, keys, value: str) -> DataFrame:
    """keys, median: the exact median of value (without nulls) for each of a few groups of any size.

    The middle ranks are closed in on by counts: each pass counts a group's values in even bins between the bounds that are left,
    and goes on in the bin that holds the rank, between the least and largest value there. A pass is one aggregate of bins; rows
    are not shuffled. Once few values are left, or all are equal, they are sorted.
    """
    spark, keys = df.sparkSession, list(keys)
    v = F.col(value)
    x = df.filter(v.isNotNull()).select(*keys, v.alias("__v"))
    key_schema = [df.schema[k] for k in keys]
    every = x.groupBy(*keys).agg(F.count("*").alias("n"), F.min("__v").alias("lo"), F.max("__v").alias("hi")).collect()  # a row a group
    open_ = [(*(r[k] for k in keys), side, rank, r["lo"], r["hi"], r["n"]) for r in every for side, rank in ((0, (r["n"] - 1) // 2), (1, r["n"] // 2))]
    done: list[tuple] = []
    nk = len(keys)

    def frame(rows):
        from pyspark.sql import types as T

        fields = [*key_schema, T.StructField("side", T.IntegerType()), T.StructField("rank", T.LongType()), T.StructField("lo", T.DoubleType()), T.StructField("hi", T.DoubleType())]
        return F.broadcast(spark.createDataFrame([r[: nk + 4] for r in rows], T.StructType(fields)))

    while open_:
        done += [(*r[: nk + 1], r[nk + 2]) for r in open_ if r[nk + 2] == r[nk + 3]]
        open_ = [r for r in open_ if r[nk + 2] < r[nk + 3]]
        last = [r for r in open_ if r[nk + 4] <= FEW]
        if last:
            left = x.join(frame(last), keys).filter(F.col("__v").between(F.col("lo"), F.col("hi")))
            ranked = left.groupBy(*keys, "side", "rank").agg(F.array_sort(F.collect_list("__v")).alias("s"))  # FEW values at most
            done += [(*r[: nk + 1], r["m"]) for r in ranked.select(*keys, "side", F.get("s", F.col("rank").cast("int")).alias("m")).collect()]
            open_ = [r for r in open_ if r[nk + 4] > FEW]
        if open_:
            wide = F.least(F.floor((F.col("__v") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / BINS)), F.lit(BINS - 1))
            bins = x.join(frame(open_), keys).filter(F.col("__v").between(F.col("lo"), F.col("hi"))).groupBy(*keys, "side", "rank", wide.alias("bin"))
            bins = bins.agg(F.count("*").alias("n"), F.min("__v").alias("a"), F.max("__v").alias("b"))
            upto = bins.withColumn("upto", F.sum("n").over(Window.partitionBy(*keys, "side").orderBy("bin")))  # BINS rows a group
            hit = upto.filter("upto > rank and upto - n <= rank").collect()
            open_ = [(*(r[k] for k in keys), r["side"], r["rank"] - (r["upto"] - r["n"]), r["a"], r["b"], r["n"]) for r in hit]
    by: dict = {}
    for r in done:
        by.setdefault(tuple(r[:nk]), {})[r[nk]] = r[nk + 1]
    from pyspark.sql import types as T

    rows = [(*k, 0.5 * m[0] + 0.5 * m[1]) for k, m in by.items()]
    return spark.createDataFrame(rows, T.StructType([*key_schema, T.StructField("median", T.DoubleType())]))
