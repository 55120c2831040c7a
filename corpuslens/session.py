"""Session construction and cluster-safe checkpoint handling."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

# Settings every job relies on: AQE (coalesce + skew join), UTC wall clock, Arrow batches
# for the few Python stages, and no web UI.
BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "corpuslens", extra: dict | None = None) -> SparkSession:
    """A session with the settings above. Master and shuffle partitions stay as submitted unless given."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(BASE_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", os.environ.get("CORPUSLENS_DRIVER_MEMORY", "16g"))
    if extra:
        conf.update(extra)
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def _is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder the cluster names in ``spark.checkpoint.dir``.

    On a cluster the setting must be present (a machine-local folder would not survive
    executor loss). Only in local mode, when nothing is configured, a scratch folder under
    the system temp directory is created, as tests do.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return configured
    if not _is_local(spark):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    path = tempfile.mkdtemp(prefix="corpuslens-ckpt-")
    sc.setCheckpointDir(path)
    return path


def reliable_checkpoint(df):
    """Cut lineage with a reliable checkpoint in ``spark.checkpoint.dir``.

    The plan is persisted first so writing the checkpoint files reads the cached partitions
    instead of recomputing the whole plan a second time; the cache is released afterwards
    (the checkpoint files, on shared storage, are what survives executor loss).
    """
    ensure_checkpoint_dir(df.sparkSession)
    cached = df.persist()
    out = cached.checkpoint(eager=True)
    cached.unpersist()
    return out


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers once per application, so that jobs run
    wherever the driver was started. The driver serves the archive; no shared folder is needed."""
    sc = spark.sparkContext
    if getattr(sc, "_corpuslens_shipped", False):
        return
    root = Path(__file__).resolve().parent
    tmp = tempfile.mkdtemp(prefix="corpuslens-pkg-")  # must stay: the driver serves the file from here
    atexit.register(shutil.rmtree, tmp, ignore_errors=True)
    shutil.copytree(root, os.path.join(tmp, "zip", root.name), ignore=shutil.ignore_patterns("__pycache__"))
    sc.addPyFile(shutil.make_archive(os.path.join(tmp, "corpuslens"), "zip", os.path.join(tmp, "zip")))
    sc._corpuslens_shipped = True
