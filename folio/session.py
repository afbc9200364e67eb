"""Session defaults and table access shared by every query."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

TUNING = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(app: str = "folio", cores: str = "*", **conf: str) -> SparkSession:
    """A local session with the engine's defaults; on a cluster the submitter's master wins."""
    builder = SparkSession.builder.appName(app)
    if "SPARK_MASTER" not in os.environ and "spark.master" not in conf:
        builder = builder.master(f"local[{cores}]")
    for key, value in {**TUNING, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Makes this package importable in the Python workers, wherever the driver was started."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        _shipped.add(context.applicationId)
        home = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp(prefix="folio-")) / "folio.zip"
        with zipfile.ZipFile(target, "w") as z:
            for f in sorted(home.rglob("*.py")):
                z.write(f, f.relative_to(home.parent))
        context.addPyFile(str(target))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data folder."""
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, with its lineage cut.

    The folder is the one the cluster names in ``spark.checkpoint.dir``; only where none is set (tests on one
    machine) a temporary folder is used.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="folio-checkpoint-")
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)
