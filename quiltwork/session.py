"""Session helpers: a default session for tests and shared-folder staging."""

from __future__ import annotations

import atexit
import hashlib
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.executorEnv.OMP_NUM_THREADS": "1",
}


def build_session(app: str = "quiltwork", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators expect; conf overrides them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session.

    Where the setting is missing (tests, a laptop) a temporary folder is made and set, once per session; on a cluster,
    whose executors would not see that folder, a missing setting is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    context = spark.sparkContext
    if context.getCheckpointDir():
        return context.getCheckpointDir()
    if not (context.master == "local" or context.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="quiltwork-")
    atexit.register(shutil.rmtree, folder, True)
    context.setCheckpointDir(f"file://{folder}")
    return context.getCheckpointDir()


def hadoop(spark: SparkSession, path: str):
    """(file system, path) of a path of any scheme."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: the lineage is cut, later uses
    read a compact columnar copy, and the loss of an executor costs nothing. The table is deleted by release(), and
    at the latest when the session ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/staged/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    system, where = hadoop(spark, path)
    system.deleteOnExit(where)
    table = spark.read.schema(df.schema).parquet(path)
    table._quiltwork_path = path
    return table


def release(*tables: DataFrame) -> None:
    """Delete staged tables that no later plan reads; other DataFrames are left alone."""
    for table in tables:
        path = getattr(table, "_quiltwork_path", None)
        if path:
            system, where = hadoop(table.sparkSession, path)
            system.delete(where, True)
            system.cancelDeleteOnExit(where)
            table._quiltwork_path = None


def input_partitions(df: DataFrame) -> int:
    """Number of partitions of df, from planning alone. Adaptive execution knows the partitions behind an exchange only once its
    stages have run; for such a plan the configured number of shuffle partitions stands in."""
    if _has_exchange(df):
        return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.rdd.getNumPartitions()


def _has_exchange(df: DataFrame) -> bool:
    return "Exchange" in df._jdf.queryExecution().executedPlan().toString()


def spread(df: DataFrame) -> DataFrame:
    """df over at least as many partitions as there are cores: a scan of fewer (a small table in one file) is dealt out
    before costly work on each row, any other plan is left as it is. It changes where rows are worked on, not what comes out."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if _has_exchange(df) or df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores)


def ship(spark: SparkSession) -> None:
    """Send the package to the Python workers, once a context, so that they can import it wherever they run."""
    context = spark.sparkContext
    if getattr(context, "_quiltwork_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    paths = sorted(os.path.join(folder, name) for folder, _, names in os.walk(root) for name in names if name.endswith(".py"))
    digest = hashlib.md5()
    for path in paths:
        with open(path, "rb") as f:
            digest.update(path.encode() + f.read())
    folder = tempfile.mkdtemp(prefix="quiltwork-code-")  # the driver serves the archive from here
    atexit.register(shutil.rmtree, folder, True)
    archive = os.path.join(folder, f"quiltwork-{digest.hexdigest()}.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for path in paths:
            z.write(path, os.path.join("quiltwork", os.path.relpath(path, root)))
    context.addPyFile(archive)
    context._quiltwork_shipped = True
