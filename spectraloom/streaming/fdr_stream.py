"""FDR of scan tables as they arrive.

FDR is a matter of one file, so each file of a micro-batch is scored on its
own; what was written for a batch is replaced if the batch is run again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StringType, StructField, StructType

from spectraloom.operators.fdr import best_per_scan, monotone_fdr
from spectraloom.sources.tables import SIC_COLUMNS, typed

_SCHEMA = StructType([StructField("Scan" if c == "ScanNum" else "MSGFDB_SpecEValue" if c == "SpecEValue" else c, StringType()) for c in SIC_COLUMNS])


def scored(batch: DataFrame) -> DataFrame:
    best = best_per_scan(batch, ["SourceFile", "ScanNum"], "ParentIonIntensity", ["SpecEValue", "Peptide", "Protein"])
    return monotone_fdr(best, ["SourceFile"], "SpecEValue", ["ScanNum", "Peptide", "Protein"])


def start(spark: SparkSession, folder: str, out: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Scores every new table in ``folder`` and writes it to ``out``/batch=N."""
    raw = spark.readStream.schema(_SCHEMA).option("sep", "\t").option("header", True).csv(folder)
    renamed = raw.withColumnsRenamed({"Scan": "ScanNum", "MSGFDB_SpecEValue": "SpecEValue"})
    rows = typed(renamed.withColumn("SourceFile", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]*)$", 1)), {"Peptide", "Protein", "SourceFile"})

    def write(batch: DataFrame, number: int) -> None:
        scored(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
