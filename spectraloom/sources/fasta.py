"""Sequence files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spectraloom.functions.scalars import cluster_of, header_id, is_canonical, normal_peptide


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(file, id, header, seq): one row per record, blank lines and line breaks removed, empty sequences kept.

    Records are split where a line begins with ``>``, so large files are read
    in parallel. Text before a file's first header is no record.
    """
    raw = spark.read.option("lineSep", "\n>").text(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("place"), F.regexp_replace("value", "\r", "").alias("text"))
    # One row per file: only its first record still has its mark.
    first = raw.groupBy("file").agg(F.min("place").alias("first"))
    joint = raw.join(first, "file").filter((F.col("place") != F.col("first")) | F.startswith("text", F.lit(">")))
    text = F.when(F.col("place") == F.col("first"), F.substr("text", F.lit(2))).otherwise(F.col("text"))
    parts = joint.select("file", "place", F.split(text, "\n", 2).alias("p"))
    header = F.trim(F.col("p")[0])
    return parts.select("file", F.col("place"), header_id(header).alias("id"), header.alias("header"), F.regexp_replace(F.coalesce(F.get("p", F.lit(1)), F.lit("")), r"\s+", "").alias("seq"))


def read_peptides(spark: SparkSession, path: str, shortest: int = 1, longest: int | None = None, ignore_il: bool = False, headerless: bool = False) -> DataFrame:
    """(Peptide): distinct upper-case sequences of fitting length, letters only; ``headerless`` files have one peptide per line."""
    seq = spark.read.text(path).select(F.col("value").alias("seq")).filter(~F.startswith("seq", F.lit(">"))) if headerless else read_fasta(spark, path).select("seq")
    peptides = seq.select(normal_peptide("seq", ignore_il).alias("Peptide")).filter(F.col("Peptide").rlike("^[A-Z]+$") & (F.length("Peptide") >= shortest))
    return (peptides if longest is None else peptides.filter(F.length("Peptide") <= longest)).distinct()


def sequences_by_id(records: DataFrame) -> DataFrame:
    """(id, seq): the sequences of one id joined in the order of the file."""
    return records.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("file", "place", "seq"))), lambda r: r["seq"]), "").alias("seq"))


def lookup_keys(records: DataFrame) -> DataFrame:
    """(key, seq): every record by its first token and by its whole header; the first record of a key counts."""
    keyed = records.select(F.explode(F.array_distinct(F.array("id", "header"))).alias("key"), "seq", "file", "place")
    return keyed.groupBy("key").agg(F.min(F.struct("file", "place", "seq"))["seq"].alias("seq"))


def protein_info(records: DataFrame) -> DataFrame:
    """(id, cluster, tail): of several records of one id the last counts."""
    tail = F.regexp_replace("header", r"^\S+\s*", "")
    last = records.groupBy("id").agg(F.max(F.struct("file", "place", "header"))["header"].alias("header"))
    return last.select("id", cluster_of("header").alias("cluster"), tail.alias("tail"))


def count_entries(spark: SparkSession, path: str) -> int:
    return spark.read.text(path).filter(F.startswith("value", F.lit(">"))).count()


def canonical_only(records: DataFrame) -> DataFrame:
    return records.filter(is_canonical("seq") & (F.col("seq") != ""))


def read_clusters(spark: SparkSession, path: str) -> DataFrame:
    """(seq_id, cluster) from a cluster listing; clusters are numbered from 0001 in the order of the file."""
    raw = spark.read.option("lineSep", "\n>Cluster").text(path).select(F.monotonically_increasing_id().alias("place"), F.regexp_replace("value", "^>Cluster", "").alias("text"))
    numbered = raw.withColumn("number", F.regexp_extract("text", r"^\s*(\d+)", 1).cast("int") + 1)
    members = numbered.select("number", F.explode(F.regexp_extract_all("text", F.lit(r">(\S+?)\.\.\."), 1)).alias("seq_id"))
    return members.select("seq_id", F.lpad(F.col("number").cast("string"), 4, "0").alias("cluster"))


def fasta_text(records: DataFrame, header: str, seq: str, width: int = 80, keep: list[str] = []) -> DataFrame:  # noqa: B006
    """(keep, value): records as text, sequences wrapped."""
    wrapped = F.regexp_replace(F.regexp_replace(seq, f"(.{{{width}}})", "$1\n"), "\n$", "")
    return records.select(*keep, F.concat(F.lit(">"), header, F.lit("\n"), wrapped).alias("value"))


def write_fasta(records: DataFrame, path: str, header: str = "header", seq: str = "seq", mode: str = "errorifexists") -> None:
    fasta_text(records, header, seq).write.mode(mode).text(path)


def write_fasta_bins(records: DataFrame, path: str, by: list[str], header: str = "header", seq: str = "seq", mode: str = "errorifexists") -> None:
    """One folder of FASTA files per bin."""
    wrapped = fasta_text(records, header, seq, keep=by)
    wrapped.repartition(*by).write.mode(mode).partitionBy(*by).text(path)


def numbered_headers(peptides: DataFrame, prefix: str) -> DataFrame:
    """(header, seq) with headers prefix1, prefix2, ... in order of the peptides."""
    from spectraloom.operators.ordered import running

    one = peptides.select("Peptide", F.lit(1).alias("__one"))
    counted = running(one, [], ["Peptide"], {"n": F.col("__one")}, one.count() > 4_000_000)
    return counted.select(F.concat(F.lit(prefix), F.col("n").cast("string")).alias("header"), F.col("Peptide").alias("seq"))


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rank", F.row_number().over(window)).filter("__rank = 1").drop("__rank")
