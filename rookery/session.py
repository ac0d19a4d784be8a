"""Session factory, and the shared folder in which lineage is cut."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def build_session(app: str = "rookery", master: str | None = None, conf: dict[str, str] | None = None) -> SparkSession:
    """A session with adaptive execution, Arrow transfer and UTC time; `conf` overrides."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
        "spark.ui.enabled": "false",
    } | (conf or {})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the session's spark.checkpoint.dir.

    Only a local session may do without; it gets a temporary folder of its machine. On a cluster
    such a folder would be another one on every machine, so there the setting is required.
    """
    folder = spark.conf.get(CHECKPOINT_CONF, None)
    if folder:
        return folder
    set_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
    if set_dir.isDefined():
        return set_dir.get()
    if spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="rookery-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def _delete(jvm, conf, path: str) -> None:
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(conf).delete(hpath, True)


def materialise(df: DataFrame) -> DataFrame:
    """Writes df once as parquet into the shared folder and reads it back: lineage ends
    there, several readers prune columns, and a lost executor costs only a re-read.
    The folder goes when the JVM ends, or with drop()."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/rookery-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hpath)
    back = spark.read.schema(df.schema).parquet(path)
    back._rookery_path = path
    return back


def drop(df: DataFrame) -> None:
    """Deletes the folder of a materialised table that nothing reads any more."""
    path = getattr(df, "_rookery_path", None)
    if path:
        _delete(df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration(), path)


def together(spark: SparkSession, *works: Callable[[], object]) -> list:
    """What each of works returns. They run at the same time, each in a thread with this one's local
    properties, so that the jobs of one fill the slots that the others' leave; the first to fail is raised
    once all have ended."""
    shared_dir(spark)  # found or made before two ask for it
    inherits = inheritable_thread_target(spark)
    if inherits is spark:  # Python's threads have none of the JVM's own here
        return [work() for work in works]
    with ThreadPoolExecutor(len(works)) as pool:
        begun = [pool.submit(inherits(work)) for work in works]
    return [x.result() for x in begun]
