"""Session set-up that every job needs."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: dict[str, str] = {}


def ship_package(spark: SparkSession) -> None:
    """Give the Python workers this package, once per application, where they don't have it on their path already."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="strandflow-")) / "strandflow.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, path.relative_to(root.parent))
    context.addPyFile(str(archive))
    _shipped[context.applicationId] = str(archive)


def settled(df: DataFrame) -> DataFrame:
    """df checkpointed in the folder that spark.checkpoint.dir names (in the warehouse where it is unset): rows that later jobs
    read alike, with a cut lineage that outlives lost executors."""
    _checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """As settled, by a Parquet table in the same folder. For loops: a checkpoint keeps what the optimizer inferred about its
    columns, which grows with every round of joins, and a table doesn't."""
    path = f"{_checkpoint_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _checkpoint_folder(spark: SparkSession) -> str:
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_shared")
    return context.getCheckpointDir()
