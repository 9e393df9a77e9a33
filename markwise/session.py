"""Session settings and durable intermediate tables."""

from __future__ import annotations

import os
import tempfile
import time
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

#: Whether the shuffle files behind a table go once it is written.
LET_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Seconds between two collections of the driver's garbage.
COLLECT_S = 10.0


def build_session(app: str = "markwise", cores: str = "*", **extra: str) -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    settings = {
        "spark.checkpoint.dir": os.path.join(tempfile.gettempdir(), f"markwise-{uuid.uuid4().hex}"),
        "spark.markwise.textSplits": cores if cores.isdigit() else "0",
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.driver.memory": "16g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    }
    settings.update(extra)
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship_code(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once per application.

    Workers that do not start in this repository's folder find it nowhere else.
    """
    context = spark.sparkContext
    if getattr(context, "_markwise_shipped", False):
        return
    package = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="markwise-code-"), "markwise.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(package):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(package)))
    context.addPyFile(archive)
    context._markwise_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor sees, as the cluster names it in
    ``spark.checkpoint.dir``; a folder in the warehouse where it names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    return os.path.join(spark.conf.get("spark.sql.warehouse.dir"), "_scratch")


def fresh_path(spark: SparkSession, name: str) -> str:
    return os.path.join(shared_folder(spark), "markwise", f"{name}-{uuid.uuid4().hex}")


def collect_garbage(spark: SparkSession) -> None:
    """Has the driver's JVM collect its garbage, every few seconds at most.

    A job of many steps leaves plans, broadcasts and shuffles of those that ended. Left to
    itself the heap grows to its limit on them, and a small driver's memory is full.
    """
    context, now = spark.sparkContext, time.monotonic()
    if now - getattr(context, "_markwise_collected", -COLLECT_S) >= COLLECT_S:
        context._jvm.System.gc()
        context._markwise_collected = now


def written(df: DataFrame, name: str = "step") -> DataFrame:
    """Cut lineage: write ``df`` to the shared folder and read it back.

    The table survives lost executors, is computed once however often it is
    used, and its file size is what Catalyst's broadcast check goes by. The
    shuffles behind it go once it is written: their files from the disks, and
    what the driver keeps of them from its memory. So does the driver's garbage.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    before = spark.conf.get(LET_GO)
    spark.conf.set(LET_GO, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(LET_GO, before)
    collect_garbage(spark)
    return spark.read.schema(df.schema).parquet(path)
