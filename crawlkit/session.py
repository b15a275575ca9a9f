"""Session settings and the shared scratch folder."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from functools import cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, name: str = "crawlkit") -> SparkSession:
    """A single-machine session for tests and benchmarks."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        # Long column expressions: noting the call site of every part takes longer than building them.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    return prepare(spark)


#: Most bytes of a batch that goes to a Python worker, or one row: 10,000 long texts would fill it.
BATCH_BYTES = 4 << 20
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the zone (zone-free timestamps are UTC here), bound Arrow batches by bytes, ship the package to executors.

    A bound on the batches that the session already has is kept.
    """
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    if spark.conf.get(_BATCH_BYTES, None) is None:
        spark.conf.set(_BATCH_BYTES, str(BATCH_BYTES))
    context = spark.sparkContext
    if not any(f.rsplit("/", 1)[-1] == "crawlkit.zip" for f in context.listFiles):
        package = Path(__file__).resolve().parent
        archive = Path(tempfile.mkdtemp(prefix="crawlkit-")) / "crawlkit"
        context.addPyFile(shutil.make_archive(str(archive), "zip", package.parent, package.name))
    return spark


@cache
def _local_scratch() -> str:
    return tempfile.mkdtemp(prefix="crawlkit-")


def scratch(spark: SparkSession, label: str) -> str:
    """A new path under the folder named by ``spark.checkpoint.dir``.

    Tables written there outlive lost executors, which is how loops cut lineage here.
    Only a local session without that setting gets a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        root = _local_scratch()
    return f"{root.rstrip('/')}/crawlkit/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the scratch folder and read it back.

    For a costly input, such as parsed pages, that a plan would otherwise compute twice.
    """
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def forget(df: DataFrame) -> None:
    """Delete a table made by ``materialize`` once all that reads it is done."""
    spark = df.sparkSession
    for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
        target = spark._jvm.org.apache.hadoop.fs.Path(folder)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
