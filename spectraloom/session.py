"""Session defaults and shared scratch space."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "spectraloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators expect (UTC, AQE, ANSI)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; where that is unset, a temporary one on a local master only."""
    context = spark.sparkContext
    known = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not known and not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not known:
        known = "file://" + tempfile.mkdtemp(prefix="spark-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", known) if spark.conf.isModifiable("spark.checkpoint.dir") else None
    if not context.getCheckpointDir():
        context.setCheckpointDir(known)
    return known


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and read it back.

    Cuts the lineage and survives the loss of any executor; unlike a cached
    frame it needs no executor memory. What is written stays until
    ``drop_stages``: results that are read later may need it.
    """
    spark = df.sparkSession
    path = f"{_stages(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _stages(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/stages-{spark.sparkContext.applicationId}"


def drop_stages(spark: SparkSession) -> None:
    """Deletes all that ``materialize`` wrote in this application; call it when no result that rests on it is read any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_stages(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The test table ``name`` in ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fits(df: DataFrame, max_rows: int) -> bool:
    """Whether ``df`` has at most ``max_rows`` rows, reading no more than it must."""
    return df.limit(max_rows + 1).count() <= max_rows
