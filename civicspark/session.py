"""Session defaults and lineage cutting shared by all operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings every plan here is written against; none of them changes a result.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, app: str = "civicspark", **conf: str) -> SparkSession:
    """A session with DEFAULTS; conf keys use ``__`` for dots."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in {**DEFAULTS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Where that is unset, a temporary folder stands in if the master is local (one machine) and is removed at exit; on a cluster
    its executors would write to disks of their own, so that is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        local = tempfile.mkdtemp(prefix="civicspark-")
        atexit.register(shutil.rmtree, local, ignore_errors=True)
        path = "file://" + local
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


_CUTS = "cut-"


def clear_cuts(spark: SparkSession) -> int:
    """Remove what `cut` has written in this session; for the end of a job, when no plan that reads it will run any more."""
    jvm, base = spark.sparkContext._jvm, shared_dir(spark)
    root = jvm.org.apache.hadoop.fs.Path(base)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    mine = [p for p in fs.listStatus(root) if p.getPath().getName().startswith(f"{_CUTS}{spark.sparkContext.applicationId}-")] if fs.exists(root) else []
    for p in mine:
        fs.delete(p.getPath(), True)
    return len(mine)


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, so a lost executor costs no recomputation.

    Parquet rather than an RDD checkpoint: it is compressed, and later readers still prune columns.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{_CUTS}{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
