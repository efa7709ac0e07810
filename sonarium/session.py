"""Session settings and the shared folder for checkpoints."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: The state store that list, map and timer state need.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def build_session(app: str = "sonarium", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators were tuned for.

    On a cluster leave ``master`` unset and size ``spark.sql.shuffle.partitions`` to a few times the core count;
    adaptive execution then merges small partitions and splits skewed ones.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the cluster's shared checkpoint folder.

    The folder comes from ``spark.checkpoint.dir``. Only in a local session that names none is a temporary one made, which goes when
    the process ends. :func:`clear_shared` deletes what was written once the results have been read.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        base = tempfile.mkdtemp(prefix="spark-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _MADE.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


#: Folders named by :func:`shared_dir`, by application.
_MADE: dict[str, list[str]] = {}


def clear_shared(spark: SparkSession) -> int:
    """Delete the folders this application made through :func:`shared_dir`; results not read yet can then not be read any more."""
    paths = _MADE.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    return len(paths)


def settle(df: DataFrame) -> DataFrame:
    """Write an intermediate result that several later passes read to the shared checkpoint folder.

    It is computed once, its lineage ends there, and losing executors does not lose it.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark, "settled"))
    return df.checkpoint(eager=True)
