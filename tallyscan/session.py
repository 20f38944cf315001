"""Session settings this package is tuned for, and where scratch tables go."""

from __future__ import annotations

import tempfile
from functools import lru_cache

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def local_session(cores: int | str = "*", app: str = "tallyscan", memory: str = "8g") -> SparkSession:
    """A local session for tests and the bench."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    builder = builder.config("spark.driver.memory", memory).config("spark.ui.enabled", "false")
    builder = builder.config("spark.sql.shuffle.partitions", "8")
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_root(spark: SparkSession, root: str | None = None) -> str:
    """The folder for scratch tables: ``root``, else the shared one the cluster names, else (local mode) a temporary one."""
    shared = root or spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    return _local_root(context.applicationId)


@lru_cache(maxsize=8)
def _local_root(application: str) -> str:
    return tempfile.mkdtemp(prefix=f"tallyscan-{application}-")
