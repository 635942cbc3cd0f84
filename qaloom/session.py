"""Session settings the jobs rely on, and the shared folder for lineage cuts."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession

# Settings that change results (time zone, repeated JSON keys) or the handling
# of skewed joins. All are runtime settings, so an existing session can take them.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session that already exists."""
    for name, value in RUNTIME_SETTINGS.items():
        spark.conf.set(name, value)
    return spark


def local_session(cores: str = "*", partitions: int = 8, app: str = "qaloom") -> SparkSession:
    """A single-machine session for tests and benchmarks."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


@cache
def _test_folder() -> str:
    return tempfile.mkdtemp(prefix="qaloom-")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, named by ``spark.checkpoint.dir``.

    A cluster must name one; a session on a single machine that names none gets a temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not re.match(r"local(\[|$)", spark.conf.get("spark.master", "")):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return _test_folder()


def cut(df: DataFrame) -> DataFrame:
    """A frame whose rows are written to the shared folder, so they are computed once.

    The table outlives the loss of an executor, and its size is known to the
    optimizer of what follows.
    """
    spark = df.sparkSession
    path = f"{_cuts(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _cuts(spark: SparkSession) -> str:
    """The folder of this application's intermediate tables."""
    return f"{shared_dir(spark)}/qaloom/cuts-{spark.sparkContext.applicationId}"


def clear_cuts(spark: SparkSession) -> None:
    """Delete the intermediate tables of this application, once no frame that reads one is needed."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_cuts(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

