"""Predicates and projections on file names, headers and metadata maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Metadata key that each kind of raster carries: fixed values of the formats.
KINDS = {"interferogram": "PHASE_UNITS", "coherence": "COHERENCE", "baseline": "BASELINE_T", "lookup": "LOOKUP", "incidence": "INCIDENCE", "dem": "DEM"}


def kind_of(metadata: Column) -> Column:
    """What a raster is, by the first of KINDS whose key its metadata has."""
    found = F
    for kind, key in KINDS.items():
        found = found.when(F.map_contains_key(metadata, key), kind)
    return found.otherwise(F.lit("unknown"))


def prune(metadata: Column, keys: list[str]) -> Column:
    """Only the wanted keys of a metadata map."""
    return F.map_filter(metadata, lambda k, _: k.isin(*keys))


def correction_status(ifgs: DataFrame, tag: str) -> bool:
    """Whether a correction is done on all interferograms (True) or on none
    (False); some with and some without it are an error."""
    has = F.map_contains_key("metadata", F.lit(tag))
    every, some = ifgs.agg(F.bool_and(has), F.bool_or(has)).first()
    if some and not every:
        raise ValueError(f"only some interferograms have {tag}")
    return bool(every)


def epochs_in(name: Column) -> Column:
    """Dates in a file name: all runs of eight digits or, if there are none,
    of six."""
    eight = F.regexp_extract_all(name, F.lit(r"(\d{8})"), F.lit(1))
    return F.when(F.size(eight) > 0, eight).otherwise(F.regexp_extract_all(name, F.lit(r"(\d{6})"), F.lit(1)))


def to_date(text: Column) -> Column:
    """yyyymmdd or yymmdd, where years 50 to 99 are of the last century."""
    six = F.when(F.substring(text, 1, 2).cast("int") >= 50, F.concat(F.lit("19"), text)).otherwise(F.concat(F.lit("20"), text))
    return F.to_date(F.when(F.length(text) == 6, six).otherwise(text), "yyyyMMdd")


def output_name(name: Column, suffix: str) -> Column:
    """The file a product of an input goes to: its stem, dots as underscores,
    and a suffix."""
    stem, kind = F.regexp_extract(name, r"([^/]+?)(\.[^./]*)?$", 1), F.regexp_extract(name, r"\.([^./]+)$", 1)
    return F.concat(stem, F.when(kind != "", F.concat(F.lit("_"), kind)).otherwise(""), F.lit(suffix))


def manifest(files: DataFrame, folder: str) -> DataFrame:
    """The four paths of each input: raw, converted, sampled and temporary."""
    at = lambda tail: F.concat(F.lit(f"{folder.rstrip('/')}/"), output_name(F.col("path"), tail))
    return files.select("path", at(".tif").alias("converted"), at("_ifg.tif").alias("sampled"), at("_tmp.tif").alias("tmp_sampled"))


def missing(wanted: DataFrame, listing: DataFrame) -> DataFrame:
    """Listed paths that don't exist."""
    return wanted.join(listing, "path", "left_anti")


def few_epochs(files: DataFrame, n: int) -> DataFrame:
    """Paths with fewer than n dates in their names."""
    return files.filter(F.size(epochs_in(F.col("path"))) < n)
