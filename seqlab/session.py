"""Session helpers: where shared tables go, and how a scan is spread over the cluster."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "seqlab", cores: str = "*", **conf: str) -> SparkSession:
    """A local session for tests and the bench; on a cluster the submitted one is used."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        # Tables here are single files, which one task would scan alone.
        .config("seqlab.scan.partitions", str(os.cpu_count()) if cores == "*" else cores)
        # Streaming state on local disk instead of the heap.
        .config(
            "spark.sql.streaming.stateStore.providerClass",
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        )
        # Joins whose partitions turn out small enough are hashed instead of sorted.
        .config("spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold", "64m")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it in ``spark.checkpoint.dir``.

    Only a local session without the setting gets a folder of its own.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        base = sc.getCheckpointDir()
    if base is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the executors")
        base = tempfile.mkdtemp(prefix="seqlab-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(base)
    return base


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder for one written table."""
    return f"{shared_dir(spark).rstrip('/')}/seqlab/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage and survives
    lost executors. Used between rounds and for tables that several jobs read."""
    path = work_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._written_path = path
    return back


def discard(df: DataFrame | None) -> None:
    """Delete a table made by :func:`written` that nothing reads any more, such as the state of
    the round before. Frames that are not such a table are left alone."""
    path = getattr(df, "_written_path", None)
    if path is None:
        return
    jvm = df.sparkSession._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    conf = df.sparkSession._jsparkSession.sessionState().newHadoopConf()
    place.getFileSystem(conf).delete(place, True)


def cut_scan(df: DataFrame, *keys: str) -> DataFrame:
    """A scan in ``seqlab.scan.partitions`` parts, or as it comes where that is not set.

    For small tables in one file, which a scan cannot cut; local sessions set it.
    """
    parts = df.sparkSession.conf.get("seqlab.scan.partitions", None)
    return df if parts is None or df.isStreaming else df.repartition(int(parts), *keys)
