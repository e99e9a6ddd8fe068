"""Spark session and checkpoint-directory helpers."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def local_session(cores: int | str = 8, shuffle_partitions: int | None = None,
                  app: str = "pickwise", driver_memory: str = "16g") -> SparkSession:
    """A local session for tests and benchmarks (UI off, AQE on, UTC)."""
    parts = shuffle_partitions or (int(cores) if str(cores).isdigit() else 8)
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", driver_memory)
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint folder (``spark.checkpoint.dir``).

    On a cluster this must be a shared folder named by the cluster config.
    Only a local-mode session without one gets a fresh scratch folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return configured
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set; iterative operators need a shared folder")
    folder = tempfile.mkdtemp(prefix="pickwise-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(folder)
    return folder


def package_zip(target: str) -> str:
    """This package's source as a zip at ``target``. Every folder needs its ``__init__.py``: Python finds no
    package without one in a zip."""
    root = os.path.dirname(os.path.abspath(__file__))
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(root)))
    return target


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package's source to the executors once per application.

    Python workers import the functions of ``mapInPandas`` and the like by name; a
    cluster whose nodes do not have the repository on their path needs the zip."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    target = package_zip(os.path.join(tempfile.mkdtemp(prefix="pickwise-zip-"), "pickwise_src.zip"))
    sc.addPyFile(target)
    _SHIPPED.add(sc.applicationId)


def cluster_settings(input_bytes: int, executors: int, cores_per_executor: int,
                     target_partition_bytes: int = 256 << 20) -> dict[str, str]:
    """Spark settings for a large run, sized from the input volume.

    Shuffle partitions ~ input / 256 MB (at least 2x the task slots), scans split at the
    same size, AQE coalescing toward that size and AQE skew splitting of any partition
    5x the median (a problem holding a third of all rows is split by the skew join and
    pre-aggregated by partial aggregation).  ``spark.checkpoint.dir`` is not touched:
    it must name the cluster's shared folder."""
    slots = max(1, executors * cores_per_executor)
    parts = max(2 * slots, int(input_bytes // target_partition_bytes) + 1)
    size = str(target_partition_bytes)
    return {
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.files.maxPartitionBytes": size,
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": size,
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": size,
        "spark.sql.autoBroadcastJoinThreshold": str(64 << 20),
    }


def apply_settings(spark: SparkSession, settings: dict[str, str]) -> SparkSession:
    for k, v in settings.items():
        spark.conf.set(k, v)
    return spark
