"""Sessions, tables and durable intermediate results."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

#: Settings that results rely on (UTC) and that large plans need (adaptive plans, skew handling).
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = 8, memory: str = "8g", **more: str) -> SparkSession:
    """A single-machine session for tests and benchmarks; on a cluster use the session given."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("biblake").config("spark.driver.memory", memory)
    for key, value in (DEFAULTS | {"spark.sql.shuffle.partitions": str(cores)} | more).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A Parquet table of the corpus; columns and filters reach its scan."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` of the session, or one of our own where that is unset."""
    named = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not named:
        already = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not already.isDefined() and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        # in local mode, as in tests, all executors are this machine
        named = already.get() if already.isDefined() else f"file://{tempfile.mkdtemp(prefix='biblake-')}"
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session may be gone already
        pass


def materialize(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage: what several branches or rounds read is computed once, and a lost executor costs only its own
    tasks. The files are removed when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/biblake/{uuid.uuid4().hex}"
    writer = df.write.mode("error")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, keys: Sequence[str], per_core: int = 2) -> DataFrame:
    """Enough partitions for costly Python stages: a scan of few files would leave most cores idle.

    Only a plan of fewer than ``per_core`` partitions per core is repartitioned, by ``keys``, so that retried tasks
    get the same rows.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= per_core * cores:
        return df
    return df.repartition(2 * per_core * cores, *keys)
