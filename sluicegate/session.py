"""Session settings that the engine's results rely on, and defaults that suit any size."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: UTC for calendar functions; adaptive plans with skew handling; Python workers fed in small batches; state that outgrows memory.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20),
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def build_session(app: str = "sluicegate", master: str | None = None, **extra: str) -> SparkSession:
    """A session with SETTINGS; `master` None leaves it to spark-submit. Keys in `extra` use __ for dots."""
    builder = SparkSession.builder.appName(app).config(map=SETTINGS)
    if master:
        cores = master[6:-1] if master.startswith("local[") else ""
        n = int(cores) if cores.isdigit() else os.cpu_count() or 8
        builder = builder.master(master).config("spark.sql.shuffle.partitions", str(n)).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir`.

    Where that is unset on one machine (tests), a temporary folder stands in, the same one for the
    whole session; on a cluster each executor would write to a disk of its own, so that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("sluicegate.scratch.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="sluicegate-")
        spark.conf.set("sluicegate.scratch.dir", found)
    return found.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Rows that several jobs read: written as Parquet into the scratch folder and read back, so no executor's memory holds them."""
    path = f"{scratch_dir(df.sparkSession)}/sluicegate-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Give the executors this package once a context, so that workers import it (and keep module caches) anywhere."""
    context = spark.sparkContext
    if getattr(context, "_sluicegate_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="sluicegate-")) / f"{root.name}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    context.addPyFile(str(archive))
    context._sluicegate_shipped = True
