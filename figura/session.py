"""Session settings and shared-storage helpers.

Everything here is plain Spark configuration. The only rule with teeth is
where intermediate files go: jobs that must cut lineage or stage a file
(format round trips, derived XML corpora) write under the cluster's shared
``spark.checkpoint.dir``. A local folder is created only when the session has
none configured, which is the case in tests and on a laptop.
"""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Settings that shape the physical plan. AQE re-plans joins and coalesces
# shuffle partitions at runtime; skew-join splitting handles hot keys.
PLAN_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str | None = None, shuffle_partitions: int = 8,
                  app_name: str = "figura") -> SparkSession:
    """Create (or reuse) a session with the plan settings above.

    ``master`` defaults to ``local[*]`` only when no master is configured,
    so the same call works under spark-submit on a cluster.
    """
    from pyspark import SparkConf

    builder = SparkSession.builder.appName(app_name)
    builder = builder.master(master or SparkConf().get("spark.master", "local[*]"))
    builder = (builder
               .config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false")
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions)))
    for k, v in PLAN_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)


def prepare(spark: SparkSession) -> SparkSession:
    """Make a session ready for this package: a checkpoint folder and, once
    per session, the package itself on every executor."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send the package to the Python workers (a zip of its sources), so that
    they can import it from any working folder and on any machine."""
    sc = spark.sparkContext
    if getattr(sc, "_figura_shipped", False):
        return
    root = Path(__file__).resolve().parent
    out = Path(tempfile.mkdtemp(prefix="figura-pkg-")) / "figura.zip"
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"{root.name}/{p.relative_to(root)}")
    sc.addPyFile(str(out))
    sc._figura_shipped = True


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's shared checkpoint folder, creating a local one
    only when none is configured and the master is this machine; on a cluster
    a missing setting is an error."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
    elif not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    else:
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="figura-ckpt-"))
    return sc.getCheckpointDir()


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Rows that a plan may broadcast on the word of a parameter.
BROADCAST_ROWS = 100_000


def few(df: DataFrame, rows: int) -> DataFrame:
    """``df``, of ``rows`` rows at most, marked for a broadcast if that is few
    enough; else the planner decides by measured size."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def spread(df: DataFrame, n: int | None) -> DataFrame:
    """``df`` over ``n`` tasks if it arrives in fewer splits, else as it is
    (no shuffle): for work that costs far more than its bytes."""
    return df.repartition(n) if n and df.rdd.getNumPartitions() < n else df


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: computed once,
    outlives lost executors, and leaves a short plan to what follows."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
