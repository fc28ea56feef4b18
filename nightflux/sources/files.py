"""Files: catalogues, registries, fit records and warp sets, in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CATALOG = "object_id string, type string, redshift string, peakmag double, A_V double"
FIT = "id string, success boolean, z double, t0 double, amplitude double, hostebv double, chisq double, ndof int, chidof double, peakchi double, peakdet int, ndet int, nbr_bands int, peak_good boolean, peakmag double, class string"


def read_catalog(spark: SparkSession, path: str, schema: str = CATALOG) -> DataFrame:
    """Catalogue with header; redshifts stay text, as missing ones are '-'."""
    return spark.read.schema(schema).option("header", True).csv(path)


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """Templates (Name;Type); names that begin with # are off, those with salt are never used."""
    df = spark.read.schema("Name string, Type string").option("header", True).option("sep", ";").csv(path)
    return df.filter(~F.col("Name").startswith("#") & ~F.col("Name").contains("salt"))


def read_fit_records(spark: SparkSession, path: str, fields: str = FIT, lines: bool = False) -> DataFrame:
    """Records {model: [fit, ...]} as one row for each fit, with model. lines: a record ends with its line, as
    write_fit_records writes them, so that large files are split; else a record is a whole file."""
    raw = spark.read.text(path, wholetext=not lines)
    return flat_records(raw.select(F.col("value").alias("record")), fields)


def flat_records(df: DataFrame, fields: str = FIT) -> DataFrame:
    by_model = F.from_json("record", f"map<string, array<struct<{', '.join(f.strip().replace(' ', ':', 1) for f in fields.split(','))}>>>")
    return df.select(F.explode(by_model).alias("model", "fits")).select("model", F.inline("fits"))


def write_fit_records(fits: DataFrame, path: str, mode: str = "error") -> None:
    """Records {model: [fit]}, one a line for each row of fits, so that no model's fits are gathered in one place. Types are
    Spark's own, so nothing needs converting."""
    fit = F.struct(*(c for c in fits.columns if c != "model"))
    fits.select(F.to_json(F.create_map("model", F.array(fit))).alias("record")).write.mode(mode).text(path)


def write_warp_set(warps: DataFrame, path: str, version: int = 3, mode: str = "error") -> None:
    """Parquet by class key (the class without /) and version."""
    keyed = warps.withColumns({"class_key": F.regexp_replace("class", "/", ""), "version": F.lit(version)})
    keyed.write.mode(mode).partitionBy("class_key", "version").parquet(path)


def read_warp_set(spark: SparkSession, path: str, cls: str, version: int = 3) -> DataFrame:
    """Rows of a class, from its partition alone; an error where there are none."""
    out = spark.read.parquet(path).filter((F.col("class_key") == cls.replace("/", "")) & (F.col("version") == version))
    if out.isEmpty():
        raise FileNotFoundError(f"no warp set of class {cls}")
    return out


def append_rows(df: DataFrame, path: str) -> None:
    """Colour fits and run audits are logs: rows are only added."""
    df.write.mode("append").parquet(path)


def audit_rows(counts: DataFrame, cls: str, z_range: tuple[float, float]) -> DataFrame:
    """Volume counts of a run as a row of its audit log: class, redshift range, counts and time."""
    what = [F.lit(cls).alias("class"), F.lit(float(z_range[0])).alias("z_min"), F.lit(float(z_range[1])).alias("z_max")]
    return counts.select(*what, *counts.columns, F.current_timestamp().alias("at"))


def write_matches(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def read_matches(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def pruned(df: DataFrame, columns: list[str], nested: dict[str, list[str]] | None = None) -> DataFrame:
    """df without the columns, and without the named fields of struct columns."""
    out = df.drop(*columns)
    for c, fields in (nested or {}).items():
        out = out.withColumn(c, F.col(c).dropFields(*fields))
    return out
