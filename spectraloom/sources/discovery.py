"""Finding inputs, on any file system that Spark reads: small manifests made on the driver, before any data is read."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from spectraloom.sources.names import match_stem, natural, run_parts


class Entry(NamedTuple):
    """One file or folder."""

    name: str
    path: str
    is_folder: bool


def visible(folder: str, *patterns: str) -> list[Entry]:
    """Files and folders that match any pattern, in natural order; hidden ones and ``._*`` doubles are left out."""
    spark = SparkSession.active()
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    found = {s.getPath().toString(): s for pattern in patterns for s in files.globStatus(path(path(folder), pattern)) or []}
    entries = [Entry(s.getPath().getName(), at, s.isDirectory()) for at, s in found.items() if not s.getPath().getName().startswith(".")]
    return sorted(entries, key=lambda entry: natural(entry.path))


def only_one(folder: str, *patterns: str) -> Entry:
    """The single match; none or several are an error."""
    found = visible(folder, *patterns)
    if len(found) != 1:
        raise ValueError(f"{folder} has {len(found)} of {', '.join(patterns)}; one is needed")
    return found[0]


def numbered_runs(spark: SparkSession, root: str) -> DataFrame:
    """(name, condition, replicate, path) of folders such as Soil_3."""
    parts = [(entry.name, *run_parts(entry.name), entry.path) for entry in visible(root, "*") if entry.is_folder and run_parts(entry.name)]
    return spark.createDataFrame(parts, "name string, condition string, replicate int, path string")


def size_series(root: str, suffix: str) -> list[tuple[str, str]]:
    """(size label, folder) of a database series; a baseline must be among them."""
    found = [(entry.name.removesuffix(suffix).rstrip("_"), entry.path) for entry in visible(root, f"*{suffix}") if entry.is_folder]
    if not any(label.lower() == "baseline" for label, _ in found):
        raise ValueError(f"{root} has no baseline")
    return found


def pair_samples(spark: SparkSession, stems: Sequence[str], formulas: Sequence[str]) -> DataFrame:
    """(sample, formula): each sample with its formula; a formula that serves two samples is an error."""
    pairs = [(stem, match_stem(stem, formulas)) for stem in stems]
    used = [f for _, f in pairs if f]
    if len(used) != len(set(used)):
        raise ValueError("a formula belongs to more than one sample")
    return spark.createDataFrame(pairs, "sample string, formula string")
