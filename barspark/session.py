"""Session factory and the shared place for checkpoints."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "barspark", cores: int | None = None, shuffle: int | None = None) -> SparkSession:
    """A local session for tests and the bench; a cluster session keeps its own settings."""
    n = cores or os.cpu_count() or 1
    spark = (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle or n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "128k")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("BARSPARK_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_local_dir: str | None = None


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a local session that names none gets one folder of its own."""
    global _local_dir
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", None
    )
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _local_dir is None:
        _local_dir = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _local_dir


def scratch_path(spark: SparkSession) -> str:
    """A fresh folder in the shared checkpoint location."""
    path = f"{checkpoint_dir(spark)}/barspark-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


_written: dict[str, list[str]] = {}
_kept: dict[str, dict[tuple[str, ...], tuple[str, str]]] = {}


def kept_tables(spark: SparkSession) -> dict[tuple[str, ...], tuple[str, str]]:
    """Name and folder of the tables that this application has written for its queries to share, by what is in them."""
    return _kept.setdefault(spark.sparkContext.applicationId, {})


def cleanup(spark: SparkSession) -> int:
    """Delete the scratch folders this application has written; call it when their results are no longer read."""
    for name, _ in _kept.pop(spark.sparkContext.applicationId, {}).values():
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    paths = _written.pop(spark.sparkContext.applicationId, [])
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        path = hadoop.Path(p)
        path.getFileSystem(conf).delete(path, True)
    return len(paths)


def stored(df: DataFrame) -> DataFrame:
    """The frame as a written table in the shared folder: for inputs that several passes read, and to cut lineage."""
    path = scratch_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package: add it to the application as a zip, once, unless a local session's workers
    find it by PYTHONPATH or the working folder anyway."""
    sc = spark.sparkContext
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    known = os.environ.get("PYTHONPATH", "").split(os.pathsep) if sc.master.startswith("local") else []
    if sc.master.startswith("local["):
        known.append(os.getcwd())
    if sc.applicationId in _shipped or root in map(os.path.abspath, filter(None, known)):
        return
    _shipped.add(sc.applicationId)
    base = os.path.join(tempfile.mkdtemp(prefix="spark-"), "barspark")
    sc.addPyFile(shutil.make_archive(base, "zip", root, "barspark"))
