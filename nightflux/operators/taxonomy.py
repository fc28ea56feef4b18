"""Class hierarchy of objects and the rules that depend on a class."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The classes and maps that results must agree with.
KNOWN_CLASSES = ["SN IIn-pec", "SN II", "SN IIb", "SN Ia-CSM", "SN Ic-pec", "SN Ia-SC", "SN Iax", "SN Ia-pec", "SN IIP", "SN Icn", "SN Ib", "SN Ia", "SN Ia-91bg", "SN Ib-pec", "SN II-pec", "SLSN-I", "SN Ic-BL", "SN IIn", "SN Ic", "SN IIL", "SN Ib/c", "SLSN-II", "SN Ia-91T", "SN Ibn"]
NARROW = {"SN II-pec": "SN II", "SN Ib-pec": "SN Ib", "SN Icn": "SN Ic", "SN IIL": "SN II", "SN IIn-pec": "SN IIn", "SN Ic-pec": "SN Ic"}
EXTENDED = {
    "SN Ia-91bg": "SN Ia-91bg (e)", "SN IIn": "SN IIn (e)", "SN IIb": "SN Ib/c (e)", "SN Ia-CSM": "SN Ia-pec (e)", "SN Ibn": "SN Ibn (e)", "SN Ia-SC": "SN Ia-pec (e)", "SN Ib": "SN Ib/c (e)", "SLSN-II": "SLSN (e)", "SN Iax": "SN Ia-pec (e)",
    "SN Ia-91T": "SN Ia-91T (e)", "SLSN-I": "SLSN (e)", "SN Ic": "SN Ib/c (e)", "SN Ia-pec": "SN Ia-pec (e)", "SN IIP": "SN II (e)", "SN Ic-BL": "SN Ib/c (e)", "SN Ia": "SN Ia (e)", "SN II": "SN II (e)", "SN Ib/c": "SN Ib/c (e)",
}
WIDE = {
    "SN II (e)": "SN II (w)", "SN Ib (e)": "SN Ib/c (w)", "SN Ibn (e)": "SN Ib/c (w)", "SN Ia-91T (e)": "SN Ia (w)", "SLSN (e)": "SLSN (w)", "SN IIn (e)": "SLSN (w)", "SN Ia-pec (e)": "SN Ia-pec (w)", "SN Ia-91bg (e)": "SN Ia-91bg (w)",
    "SN Ic (e)": "SN Ib/c (w)", "SN Ia (e)": "SN Ia (w)", "SN Ib/c (e)": "SN Ib/c (w)",
}
ALL = {"SN Ia (w)": "SN Ia (a)", "SLSN (w)": "SN CC (a)", "SN Ib/c (w)": "SN CC (a)", "SN Ia-pec (w)": "SN Ia (a)", "SN II (w)": "SN CC (a)", "SN Ia-91bg (w)": "SN Ia (a)"}
LEVELS = [("n", NARROW), ("e", EXTENDED), ("w", WIDE), ("a", ALL)]
#: An older hierarchy: IIb goes with II, Iax is a branch of its own.
LEGACY_LEVELS = [("n", NARROW | {"SN IIb": "SN II"}), ("e", EXTENDED | {"SN Iax": "SN Iax (e)"}), ("w", WIDE | {"SN Iax (e)": "SN Iax (w)"}), ("a", ALL | {"SN Iax (w)": "SN Ia (a)"})]
#: Which classes a template's type may stand for.
CLOSE_TYPES = {
    "PopIII": ["SLSN (w)", "SLSN (e)", "SLSN-II", "SLSN-I"],
    "SN II": ["SN II", "SN II (e)", "SN II (w)", "SN CC (a)"],
    "SN II-pec": ["SN II (w)", "SN CC (a)", "SN II (e)"],
    "SN IIL": ["SN II", "SN II (e)", "SN II (w)", "SN CC (a)"],
    "SN IIL/P": ["SN II", "SN II (e)", "SN II (w)", "SN CC (a)"],
    "SN IIP": ["SN IIP", "SN II (e)", "SN II (w)", "SN CC (a)"],
    "SN IIb": ["SN Ib/c (e)", "SN Ib/c (w)", "SN CC (a)"],
    "SN IIn": ["SN IIn", "SLSN (w)", "SLSN (e)", "SLSN-II", "SLSN-I", "SN CC (a)"],
    "SN Ia": ["SN Ia", "Ia-pec", "Ia-CSM", "Ia-SC", "SN Ia-SC", "Ia-91T", "SN Ia-pec", "SN Ia-91bg (e)", "SN Ia (e)", "SN Ia-91T (e)", "SN Ia-CSM", "SN Ia-91bg", "SN Ia-91T", "SN Iax", "SN Ia (w)", "SN Ia (a)", "SN Ia-91T (w)", "SN Ia-91bg (w)", "SN Ia-pec (w)"],
    "SN Ib": ["SN Ib", "SN Ibn", "SN Ib (e)", "SN IIb", "SN Ib/c", "SN Ib/c (w)", "SN CC (a)"],
    "SN Ib/c": ["SN Ib/c (w)", "SN CC (a)", "SN Ib/c (e)", "SN Ib/c"],
    "SN Ic": ["SN Ic", "SN Ic (e)", "SN Ic-BL", "SN Ib/c (w)", "SN CC (a)", "SN Ib/c"],
    "SN Ic-BL": ["SN Ic (e)", "SN Ic-BL", "SN Ib/c", "SN Ib/c (w)", "SN CC (a)"],
}


def mapped(column: Column | str, pairs: dict[str, str]) -> Column:
    """column with its values replaced; others, and null, pass through."""
    col = F.col(column) if isinstance(column, str) else column
    lookup = F.create_map(*(F.lit(x) for kv in pairs.items() for x in kv))
    return F.coalesce(F.element_at(lookup, col), col)


def add_classes(df: DataFrame, column: str = "type", purge: bool = False, levels=None) -> DataFrame:
    """Adds <column>_n, _e, _w and _a, each mapped from the one before. KeyError if column is missing."""
    if column not in df.columns:
        raise KeyError(f"no column {column}")
    if purge:
        df = df.filter(F.col(column).isin(KNOWN_CLASSES))
    before = column
    for level, pairs in levels or LEVELS:
        df = df.withColumn(f"{column}_{level}", mapped(before, pairs))
        before = f"{column}_{level}"
    return df


def numeric(df: DataFrame, *columns: str) -> DataFrame:
    """Text columns as numbers; '-' and other text that is none become null."""
    return df.withColumns({c: F.expr(f"try_cast(`{c}` as double)") for c in columns})


def without_missing(df: DataFrame, *columns: str, sentinel: str = "-") -> DataFrame:
    for c in columns:
        df = df.filter(F.col(c) != sentinel)
    return df


def class_counts(df: DataFrame, column: str = "type") -> DataFrame:
    """level, class, n: counts at all levels in one pass (grouping sets)."""
    names = [f"{column}_{x}" for x in "neaw"] + [column]
    level = F.coalesce(*(F.when(F.col(f"g_{n}") == 0, F.lit(n)) for n in names))
    grouped = df.groupingSets([[F.col(n)] for n in names], *names).agg(F.count("*").alias("n"), *(F.grouping(n).alias(f"g_{n}") for n in names))
    return grouped.select(level.alias("level"), F.coalesce(*(F.when(F.col(f"g_{n}") == 0, F.col(n)) for n in names)).alias("class"), "n")


def true_class(column: str, target: str, close=None) -> Column:
    """Whether a template of this class may stand for the target class."""
    return F.col(column).isin([t for t, classes in (close or CLOSE_TYPES).items() if target in classes])


def true_for(template_type: str, target: str, close=None) -> Column:
    """true_class for a target that differs by row: whether a template of the class in one column may stand for the class in the other."""
    lookup = F.create_map(*(x for t, classes in (close or CLOSE_TYPES).items() for x in (F.lit(t), F.array(*map(F.lit, classes)))))
    return F.coalesce(F.array_contains(F.element_at(lookup, F.col(template_type)), F.col(target)), F.lit(False))


# Redshift ranges by class (inclusive for fits, strict for seeds), colour bands, classes and objects left out.
Z_RANGE = (0.0, 0.07)
Z_RANGES = {"SLSN-II": (0.0, 0.3), "SLSN-I": (0.0, 0.3), "SN Ia-91bg": (0.01, 0.055), "SN Ia-91T": (0.01, 0.10), "SN Ia-CSM": (0.01, 0.10), "SN IIn": (0.0, 0.10), "SN Ia-SC": (0.01, 0.10), "SN Ia-pec": (0.01, 0.055), "SN Iax": (0.0, 0.055)}
SEED_RANGE = (0.01, 0.04)
SEED_RANGES = {"SLSN-II": (0.07, 0.17), "SN Ia-91bg": (0.01, 0.055), "SN Ia-91T": (0.03, 0.08), "SN Ia-pec": (0.01, 0.055), "SN Iax": (0.01, 0.055)}
COLOR_BANDS = ("bessellb", "bessellv")
RED_CLASSES = ["SN Ia-91T", "SN Ia-pec", "SLSN-I", "SLSN-II", "SN Ia-SC", "SLSN (e)", "SLSN (w)", "SN Ia (w)", "SN Ia-pec (w)", "SN Ia (a)", "SN CC (a)"]
NOT_SUPERNOVAE = ["AGN", "Ca-rich", "ILRT", "LBV", "LRN", "Other", "TDE", "nova", "other", "SN Ca-rich-Ca"]


def in_range(df: DataFrame, column: str, z: str, default=None, ranges=None, strict: bool = False) -> DataFrame:
    """Rows whose redshift is in the range of their class."""
    default, ranges = default or Z_RANGE, ranges if ranges is not None else Z_RANGES
    side = lambda i: F.coalesce(F.element_at(F.create_map(*(F.lit(x) for c, r in ranges.items() for x in (c, r[i]))), F.col(column)), F.lit(default[i])) if ranges else F.lit(default[i])
    lo, hi = side(0), side(1)
    return df.filter((F.col(z) > lo) & (F.col(z) < hi) if strict else F.col(z).between(lo, hi))


def color_bands(column: str) -> tuple[Column, Column]:
    red = F.col(column).isin(RED_CLASSES)
    return F.when(red, "ztfr").otherwise(COLOR_BANDS[0]), F.when(red, "ztfi").otherwise(COLOR_BANDS[1])


def storage_key(column: str) -> Column:
    return F.regexp_replace(column, "/", "")


def narrow_classes(df: DataFrame, level: str, target: str, column: str = "type") -> DataFrame:
    """The narrow classes below a target class."""
    return df.filter(F.col(f"{column}_{level}") == target).select(F.col(f"{column}_n").alias("narrow")).distinct()
