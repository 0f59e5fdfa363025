"""Session set-up and the shared folder for checkpoints and intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

SHARED = "spark.checkpoint.dir"


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, **settings: str) -> SparkSession:
    """A session for tests and benchmarks; on a cluster the caller brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("relaygauge")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
    )
    for name, setting in settings.items():
        builder = builder.config(name.replace("__", "."), setting)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below the cluster's ``spark.checkpoint.dir``.

    Without that setting only a session on one machine gets a folder, and sets it; executors
    elsewhere would not see it.
    """
    base = spark.conf.get(SHARED, None)
    if not base:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"{SHARED} names no folder that all executors share")
        base = tempfile.mkdtemp(prefix="relaygauge-")
        spark.conf.set(SHARED, base)
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
