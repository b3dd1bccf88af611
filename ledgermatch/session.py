"""Session settings and the shared working folder.

Library code never builds its own session: it takes the caller's. ``local_session``
is for tests and the bench only. Intermediate tables (ingest round trips, versioned
merges, gold tables) go below ``spark.checkpoint.dir`` -- on a cluster that is the
shared folder the cluster names; only when it is unset (tests, local runs) a fresh
scratch folder is created and registered.
"""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

# Settings that matter at scale: AQE re-plans joins from exact runtime sizes
# (size-checked broadcast with sort-merge fallback), splits skewed join
# partitions and coalesces small shuffle partitions.
SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "64MB",
    "spark.sql.session.timeZone": "UTC",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "ledgermatch") -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in SCALE_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    work_root(spark)
    return spark


def work_root(spark: SparkSession) -> str:
    """The shared folder for written intermediate tables.

    Read from ``spark.checkpoint.dir`` (or the context's checkpoint dir). A local
    session that names none, as in tests, gets a fresh folder; a cluster must name one.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("Name a folder that all executors share in spark.checkpoint.dir.")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="ledgermatch-"))
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unique folder name below the shared work root (never reused)."""
    return f"{work_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, wherever the driver found it.

    The archive lies in the shared folder, so no task depends on a folder of the driver's.
    """
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for folder, _, files in os.walk(package):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(package)))
    target = f"{scratch_path(spark, os.path.basename(package))}.zip"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
    stream = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path)
    stream.write(packed.getvalue())
    stream.close()
    spark.sparkContext.addPyFile(target)
    _SHIPPED.add(app)
