"""Session settings and the shared folder for written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every job wants: runtime re-planning, skew splitting on both plain
# and rewritten join plans, and one fixed time zone for all timestamps.
RECOMMENDED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app_name: str = "ferrywork", master: str | None = None, **conf) -> SparkSession:
    """Session with :data:`RECOMMENDED_CONF`; ``conf`` entries win over it."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**RECOMMENDED_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def sized_conf(input_bytes: int) -> dict[str, str]:
    """Partition settings for a job that reads about ``input_bytes``.

    Shuffles start with partitions of about 200 MB, which AQE may join or split
    at run time; very large scans get larger splits so that the number of tasks
    stays manageable.
    """
    partitions = max(200, -(-input_bytes // (200 * 1024**2)))
    split = 128 if input_bytes < 10 * 1024**4 else 512
    return {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.files.maxPartitionBytes": f"{split}m",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "200m",
    }


_test_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder for written tables that every executor can reach.

    The cluster names it in ``spark.checkpoint.dir``.  Only where that is unset
    and the session is local (tests) a temporary folder is made, once per
    application.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    if context.applicationId not in _test_dirs:
        _test_dirs[context.applicationId] = tempfile.mkdtemp(prefix="ferrywork-")
    return _test_dirs[context.applicationId]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh, unused path below :func:`shared_dir`."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
