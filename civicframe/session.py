"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

#: Settings that hold from a laptop to a large cluster.  AQE starts from many
#: shuffle partitions and merges the small ones, so one setting serves both.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a skewed join partition even when that costs one more shuffle.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.files.maxPartitionBytes": "128m",
}


def build_session(app_name: str = "civicframe", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


#: The folder of each application, made once and removed when its driver ends.
_OWN: dict[str, str] = {}


def _own_folder(spark: SparkSession) -> str:
    context = spark.sparkContext
    if context.applicationId not in _OWN:
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            root = tempfile.mkdtemp(prefix="civicframe-")
        folder = os.path.join(root, f"civicframe-{context.applicationId}-{uuid.uuid4().hex[:8]}")
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(context._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        _OWN[context.applicationId] = folder
    return _OWN[context.applicationId]


def scratch_dir(spark: SparkSession) -> str:
    """The name of a new folder under the session's shared checkpoint folder.

    The cluster names that folder in ``spark.checkpoint.dir``.  Only a local master may
    fall back to a temporary folder of this machine.  What an application writes here is removed when it ends.
    """
    return os.path.join(_own_folder(spark), f"civicframe-{uuid.uuid4().hex}")


def drop_folder(spark: SparkSession, folder: str) -> None:
    """Remove a written table that no later step reads."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut_lineage(df):
    """Checkpoint ``df`` in the shared folder, so lost executors cost a re-read."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(scratch_dir(spark))
    return df.checkpoint(eager=True)
