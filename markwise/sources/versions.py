"""A store whose tables change together: data first, the manifest last.

``<root>/data/<table>/version=…/arch=…/lesson=…`` holds rows, and
``<root>/manifest/version=…`` names the lessons that a version publishes, in one
file that appears when all its data is there. A reader resolves the manifest
first and keeps what it found (``pinned``): models, configs, vectors and truths
of a lesson then all come from one version, whatever is published meanwhile, and
data without a manifest is never seen.
"""

from __future__ import annotations

import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from markwise.operators.lookup import stale_lessons
from markwise.session import written

KEYS = ["arch", "lesson"]
MANIFEST = "arch string, lesson string, removed boolean, version string"


def new_version() -> str:
    """Later versions sort behind earlier ones; two writers never get the same."""
    return f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"


def write_data(tables: dict[str, DataFrame], root: str, version: str) -> None:
    """The first half of a publish. Nobody sees it before ``write_manifest``."""
    for name, rows in tables.items():
        salt = F.pmod(F.xxhash64(F.to_json(F.struct(*[c for c in rows.columns if c not in KEYS]))), F.lit(4))
        path = f"{root}/data/{name}/version={version}"
        rows.repartition(*KEYS, salt).write.partitionBy(*KEYS).parquet(path)


def write_manifest(lessons: DataFrame, root: str, version: str, removed: bool = False) -> None:
    """The second half: from now on these (arch, lesson) are what ``version`` holds of them."""
    rows = lessons.select(*KEYS).distinct().withColumn("removed", F.lit(removed))
    rows.coalesce(1).write.parquet(f"{root}/manifest/version={version}")


def publish(tables: dict[str, DataFrame], root: str) -> str:
    """Writes all tables (arch, lesson, …) of some lessons as one version.

    What an earlier version held of these lessons is replaced as a whole, tables
    that are not given included. Other lessons stay.
    """
    version = new_version()
    write_data(tables, root, version)
    lessons = None
    for rows in tables.values():
        own = rows.select(*KEYS)
        lessons = own if lessons is None else lessons.unionByName(own)
    write_manifest(lessons, root, version)
    return version


def remove(lessons: DataFrame, root: str) -> str:
    """Takes (arch, lesson) out of the store, as a version of its own."""
    version = new_version()
    write_manifest(lessons, root, version, removed=True)
    return version


def current(spark: SparkSession, root: str) -> DataFrame:
    """(arch, lesson, version, trained_at): the newest version of each lesson, and
    when its manifest was written. Removed lessons are not in it."""
    try:
        files = spark.read.schema(MANIFEST).parquet(f"{root}/manifest")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "arch string, lesson string, version string, trained_at timestamp")
    newest = files.select(*KEYS, "version", "removed", F.col("_metadata.file_modification_time").alias("trained_at"))
    latest = newest.groupBy(*KEYS).agg(F.max(F.struct("version", "removed", "trained_at")).alias("l"))
    return latest.filter("NOT l.removed").select(*KEYS, "l.version", "l.trained_at")


def pinned(spark: SparkSession, root: str) -> DataFrame:
    """``current``, kept as it is now."""
    return written(current(spark, root), "pinned")


def load(pin: DataFrame, root: str, table: str, schema: str) -> DataFrame:
    """The rows (arch, lesson, …) of one table, of the pinned versions only."""
    spark = pin.sparkSession
    rows = spark.read.schema(f"{schema}, version string, arch string, lesson string").parquet(f"{root}/data/{table}")
    return rows.join(pin.select(*KEYS, "version"), [*KEYS, "version"], "left_semi").drop("version")


class FreshTables:
    """What a running stream scores with: pinned for a micro-batch, renewed when stale.

    A call returns the tables of one set of versions. They are stale once a
    lesson they hold was published or edited later, or the store has lessons that
    they lack or lacks lessons that they hold. ``edited`` gives (lesson, updated_at).
    """

    def __init__(self, spark: SparkSession, root: str, make, edited=None):
        self.spark, self.root, self.make, self.edited = spark, root, make, edited
        self.pin: DataFrame | None = None
        self.tables = None
        self.renewed = 0

    def _cached(self, pin: DataFrame) -> DataFrame:
        rows = pin.groupBy("lesson").agg(F.max("trained_at").alias("trained_at"))
        if self.edited is None:
            return rows.withColumn("updated_at", F.lit(None).cast("timestamp"))
        seen = self.edited().groupBy("lesson").agg(F.max("updated_at").alias("updated_at"))
        return written(rows.join(seen, "lesson", "left"), "cached")

    def stale(self) -> bool:
        if self.pin is None:
            return True
        now = current(self.spark, self.root)
        edits = self.edited() if self.edited else self.spark.createDataFrame([], "lesson string, updated_at timestamp")
        if not stale_lessons(self.cached, now.select("lesson", "trained_at"), edits).isEmpty():
            return True
        one, other = now.select(*KEYS, "version"), self.pin.select(*KEYS, "version")
        return not one.exceptAll(other).unionByName(other.exceptAll(one)).isEmpty()

    def __call__(self):
        if self.stale():
            self.pin = pinned(self.spark, self.root)
            self.cached = self._cached(self.pin)
            self.tables = self.make(self.pin)
            self.renewed += 1
        return self.tables
