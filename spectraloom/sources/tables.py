"""Tab-separated tables, partition folders, reports and formula files: reading and writing."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spectraloom.functions.scalars import core_peptide, has_decoy, null_tokens, number

#: Names under which a column may come, the wanted one first (fixed values).
ALIASES = {
    "ScanNum": ("ScanNum", "Scan", "scan", "scan_num", "ScanNumber"),
    "Peptide": ("Peptide", "peptide", "PeptideSequence", "Sequence"),
    "Protein": ("Protein", "protein", "ProteinName", "Proteins"),
    "SpecEValue": ("SpecEValue", "MSGFDB_SpecEValue", "MSGFPlus_SpecEValue"),
}
#: Columns of a prepared scan table (fixed values).
SIC_COLUMNS = ("ScanNum", "PrecursorMZ", "DelM_PPM", "Peptide", "Protein", "MSGFScore", "SpecEValue", "EValue", "QValue", "PepQValue", "ElutionTime", "ParentIonIntensity", "PeakArea", "StatMomentsArea")
_TEXT = {"Peptide", "Protein"}


def read_tsv(spark: SparkSession, path: str | Sequence[str], na_tokens: bool = True, infer: bool = False, columns: Sequence[str] | None = None) -> DataFrame:
    """A table with header. Columns are text unless ``infer``; with ``na_tokens`` the usual texts for null become null; of ``columns`` those that are there are read."""
    df = spark.read.option("sep", "\t").option("header", True).option("inferSchema", infer).option("quote", "").csv(path)
    if columns is not None:
        df = df.select(*[F.col(f"`{c}`") for c in columns if c in df.columns])
    return df.select(*[null_tokens(F.col(f"`{c}`")).alias(c) if na_tokens and t == "string" else F.col(f"`{c}`") for c, t in df.dtypes])


def with_aliases(df: DataFrame, wanted: Sequence[str], required: bool = True) -> DataFrame:
    """Renames the first column that answers to each wanted name."""
    for name in wanted:
        found = next((c for c in ALIASES.get(name, (name,)) if c in df.columns), None)
        if found is None and required:
            raise ValueError(f"no column for {name}; the table has {', '.join(df.columns)}")
        if found and found != name:
            df = df.withColumnRenamed(found, name)
    return df


def require(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def typed(df: DataFrame, text: set[str] = frozenset(_TEXT)) -> DataFrame:
    """ScanNum as bigint, text columns as they are, all others as doubles."""
    return df.select(*[F.col(c) if c in text else number(c).cast("bigint").alias(c) if c == "ScanNum" else number(c).alias(c) for c in df.columns])


def read_sic(spark: SparkSession, path: str) -> DataFrame:
    """Scan table with the prepared columns (absent ones null), its file and derived columns."""
    raw = with_aliases(read_tsv(spark, path), ["ScanNum", "Peptide", "Protein"])
    raw = with_aliases(raw, ["SpecEValue"], required=False)
    have = [F.col(c) if c in raw.columns else F.lit(None).cast("string").alias(c) for c in SIC_COLUMNS]
    return _derived(typed(raw.select(*have)), "SIC")


def read_syn(spark: SparkSession, path: str) -> DataFrame:
    raw = with_aliases(read_tsv(spark, path), ["ScanNum", "Peptide", "Protein"])
    raw = with_aliases(raw, ["SpecEValue"], required=False)
    keep = [c for c in (*SIC_COLUMNS, "MSMSScore") if c in raw.columns]
    return _derived(typed(raw.select(*keep)), "SYN")


def _derived(df: DataFrame, layer: str) -> DataFrame:
    return df.withColumns({"CorePeptide": core_peptide("Peptide"), "IsDecoy": has_decoy("Protein"), "SourceLayer": F.lit(layer)})


def partition_columns(path: Column) -> dict[str, Column]:
    """RunFolder, PartitionType, PartitionID, Group and pair members from a path with a folder ``*_group_i`` or ``*_pair_i_j``."""
    folder = F.regexp_extract(path, r"([^/]*_(?:group_\d+|pair_\d+_\d+))(?:/|$)", 1)
    pair = folder.rlike(r"_pair_\d+_\d+$")
    part = lambda pattern, k: F.regexp_extract(folder, pattern, k).try_cast("int")
    return {
        "RunFolder": F.nullif(folder, F.lit("")),
        "PartitionType": F.when(folder == "", None).when(pair, "pair").otherwise("group"),
        "PartitionID": F.nullif(F.regexp_extract(folder, r"_((?:group_\d+)|(?:pair_\d+_\d+))$", 1), F.lit("")),
        "Group": part(r"_group_(\d+)$", 1),
        "PairGroupA": part(r"_pair_(\d+)_(\d+)$", 1),
        "PairGroupB": part(r"_pair_(\d+)_(\d+)$", 2),
    }


def read_partitions(spark: SparkSession, pattern: str) -> DataFrame:
    """All tables of a glob as one scan, tagged with the partition their folder names and their file."""
    raw = spark.read.option("sep", "\t").option("header", True).option("quote", "").csv(pattern)
    path = F.col("_metadata.file_path")
    tagged = raw.withColumns({**partition_columns(path), "SourceFile": F.regexp_extract(path, r"([^/]*)$", 1)})
    return tagged.filter(~F.startswith("SourceFile", F.lit("._")))


def read_metrics(spark: SparkSession, path: str, names: Mapping[str, Sequence[str]]) -> dict[str, int]:
    """Whole numbers from a Metric/Value report, each under the first of its names that is there."""
    rows = read_tsv(spark, path)
    # A report has some dozen rows; what is far longer is none.
    rows = rows.toDF(*[c.lower() for c in rows.columns]).limit(10_001).collect()
    if len(rows) > 10_000:
        raise ValueError(f"{path} is too long for a report")
    found: dict[str, str] = {}
    for row in rows:
        if row["metric"] in found:
            raise ValueError(f"{row['metric']} stands twice in {path}")
        found[row["metric"]] = row["value"]
    out = {}
    for name, aliases in names.items():
        text = next((found[a] for a in (name, *aliases) if a in found), None)
        if text is None or float(text) != int(float(text)):
            raise ValueError(f"{path} has no whole number for {name}")
        out[name] = int(float(text))
    return out


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.trim(column).alias(column)).filter(F.col(column) != "").distinct()


def write_tsv(df: DataFrame, path: str, one_file: bool = False, mode: str = "errorifexists") -> None:
    """Arrays come out as text joined by ``;``. ``one_file`` is for reports."""
    flat = df.select(*[F.array_join(c, ";").alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes])
    (flat.coalesce(1) if one_file else flat).write.mode(mode).option("sep", "\t").option("header", True).option("quote", "").option("emptyValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def write_manifest(spark: SparkSession, path: str, outputs: Mapping[str, str], mode: str = "errorifexists") -> None:
    """(Output, Path): what a run wrote and where, one line each, and as readable text beside it."""
    rows = spark.createDataFrame(list(outputs.items()) or [("", "")], "Output string, Path string").filter("Output <> ''")
    write_tsv(rows, path, one_file=True, mode=mode)
    rows.select(F.concat("Output", F.lit(": "), "Path").alias("value")).coalesce(1).write.mode(mode).text(f"{path}_guide")


def write_partitioned(df: DataFrame, path: str, by: Sequence[str], mode: str = "errorifexists") -> None:
    """One folder per bin, so that a reader of one bin reads that one only."""
    df.repartition(*by).write.mode(mode).partitionBy(*by).parquet(path)


def write_formula(curve: DataFrame, path: str, condition: str, version: str = "1", mode: str = "errorifexists") -> None:
    """A condition's curve as one JSON document of parallel arrays."""
    documents = _formulas(curve.withColumn("grp", F.lit(condition)), version)
    documents.select("value").coalesce(1).write.mode(mode).text(path)


def write_formulas(curve: DataFrame, path: str, version: str = "1", mode: str = "errorifexists") -> None:
    """The curves of all conditions (grp), each a document in its own folder ``condition=name``."""
    _formulas(curve, version).repartition("condition").write.mode(mode).partitionBy("condition").text(path)


def _formulas(curve: DataFrame, version: str) -> DataFrame:
    order = F.array_sort(F.collect_list(F.struct("fdr_anchor", "raw_corrected", "corrected", "role")))
    packed = curve.groupBy(F.col("grp").alias("condition")).agg(order.alias("a"))
    each = lambda name, value: F.transform("a", value).alias(name)
    document = F.struct(
        F.col("condition").alias("condition_name"), F.lit(version).alias("formula_version"), F.lit("isotonic").alias("monotonic_method"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_utc"),
        each("fdr_anchor", lambda r: r["fdr_anchor"]), each("corrected_fdr_anchor", lambda r: r["corrected"]), each("raw_corrected_fdr_anchor", lambda r: r["raw_corrected"]), each("delta_anchor", lambda r: r["corrected"] - r["fdr_anchor"]), each("anchor_role", lambda r: r["role"]),
    )
    return packed.select("condition", F.to_json(document).alias("value"))


def read_formula(spark: SparkSession, path: str) -> DataFrame:
    """(grp, fdr_anchor, corrected) of one checked formula: anchors rise strictly from 0 to 1, values are in [0, 1] and do not fall."""
    found = [json.loads(r["value"]) for r in spark.read.text(path).limit(2).collect()]
    if len(found) != 1:
        raise ValueError(f"{path} must hold one formula")
    x, y = found[0]["fdr_anchor"], found[0]["corrected_fdr_anchor"]
    checks = {
        "as many values as anchors": len(x) == len(y), "two anchors or more": len(x) >= 2, "numbers only": all(isinstance(v, (int, float)) and v == v for v in x + y), "first anchor 0": x[:1] == [0.0], "last anchor 1": x[-1:] == [1.0],
        "rising anchors": all(a < b for a, b in zip(x, x[1:])), "values in [0, 1]": all(0 <= v <= 1 for v in y), "values that do not fall": all(a <= b + 1e-12 for a, b in zip(y, y[1:])),
    }
    broken = [name for name, good in checks.items() if not good]
    if broken:
        raise ValueError(f"{path} lacks {', '.join(broken)}")
    return spark.createDataFrame([(found[0].get("condition_name"), float(a), float(b)) for a, b in zip(x, y)], "grp string, fdr_anchor double, corrected double")


def read_formulas(spark: SparkSession, path: str) -> DataFrame:
    """(grp, fdr_anchor, corrected) of every formula that ``write_formulas`` wrote."""
    document = "condition_name string, fdr_anchor array<double>, corrected_fdr_anchor array<double>"
    packed = spark.read.text(path).select(F.from_json("value", document).alias("d")).select("d.*")
    pairs = F.arrays_zip(F.col("fdr_anchor").alias("x"), F.col("corrected_fdr_anchor").alias("y"))
    return packed.select(F.col("condition_name").alias("grp"), F.explode(pairs).alias("p")).select("grp", F.col("p.x").alias("fdr_anchor"), F.col("p.y").alias("corrected"))
