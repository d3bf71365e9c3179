"""Session defaults shared by the entry points, the bench and the tests."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str, master: str | None = None, shuffle_partitions: int | None = None,
                  extra: dict[str, str] | None = None) -> SparkSession:
    """Create (or reuse) a session with the defaults the operators expect."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **(extra or {})}.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for stored stages.

    A cluster names it in ``spark.checkpoint.dir``. Only a local master, where driver and tasks
    share one disk, gets a temporary folder of its own; elsewhere the setting must be there.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if path is None:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors share (master is {master})")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidepanel-ckpt-"))
        path = spark.sparkContext.getCheckpointDir()
    return path.rstrip("/")


def stage_folder(spark: SparkSession) -> str:
    """Folder of this application's stored stages."""
    return f"{checkpoint_dir(spark)}/stages-{spark.sparkContext.applicationId}"


def dealt(df, *by):
    """Rows dealt by keys over as many tasks as the session has shuffle partitions.

    A count that is given is kept. Without one the adaptive planner makes little more tasks than
    there are cores, and leaves out the exchange where rows already lie by some of the keys, so a
    task's rows grow with the input.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


#: Whether an execution deletes its shuffle files when it ends.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_deleted(spark: SparkSession):
    """Writes in this block delete their shuffle files as they end, in place of when the driver's
    garbage is next collected. What is written is read from its folder, so nobody reads them again."""
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)


def cut_lineage(df):
    """Run ``df`` once, write it to the shared folder and go on from the stored table.

    Several passes then read one narrow table with statistics instead of repeating a deep
    plan, and a lost executor costs at most a re-read. The stage stays until ``clear_stages``.
    """
    spark = df.sparkSession
    path = f"{stage_folder(spark)}/{uuid.uuid4().hex}"
    with shuffles_deleted(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_stages(spark: SparkSession) -> None:
    """Delete this application's stored stages; results that still read them must be written before."""
    path = spark._jvm.org.apache.hadoop.fs.Path(stage_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
