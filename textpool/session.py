"""Session helpers: a tuned local session for tests/bench and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "textpool") -> SparkSession:
    """Session for tests and the benchmark. On a cluster, use the cluster's own session."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # driver-side only: skip per-call stack capture for error call sites while building plans
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", "8g")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Read from the session. When it is unset, a run on one machine (master
    ``local``) gets a private folder; on a cluster that is an error, because
    executors do not see each other's disks.
    """
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if conf_dir:
        root = conf_dir
    else:
        root = spark.sparkContext.getCheckpointDir()
        if not root:
            if not spark.sparkContext.master.split("[")[0] == "local":
                raise RuntimeError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
            root = tempfile.mkdtemp(prefix="textpool-ckpt-")
            try:
                spark.conf.set("spark.checkpoint.dir", root)
            except Exception:  # a core conf: not settable at runtime; setCheckpointDir below suffices
                pass
    try:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(root)
    except Exception:  # pragma: no cover - connect sessions have no SparkContext
        pass
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared checkpoint folder."""
    root = checkpoint_root(spark).rstrip("/")
    return f"{root}/textpool/{name}-{uuid.uuid4().hex[:12]}"


def materialise(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and survives lost executors."""
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def is_local_path(path: str) -> bool:
    return "://" not in path or path.startswith("file:")


def ensure_parent(path: str) -> None:
    if is_local_path(path):
        os.makedirs(os.path.dirname(path.replace("file:", "")) or ".", exist_ok=True)
