"""The shared folder every executor sees, and tables written there to cut lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_folders: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir.  Only on a local master, as in tests, is a temporary one made where it is
    unset; on a cluster, executors would not see that."""
    found = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="veriloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in this application's own folder, which goes when the driver ends."""
    own = f"{shared_dir(spark)}/veriloom-{spark.sparkContext.applicationId}"
    if own not in _folders:
        _folders.add(own)
        atexit.register(_forget, spark, own)
    return f"{own}/{name}-{uuid.uuid4().hex}"


def _forget(spark: SparkSession, path: str) -> None:
    try:
        drop_path(spark, path)
    except Exception:  # noqa: BLE001  the JVM has ended before; what is left is in a folder named by the application
        pass


def free_name(df: DataFrame, name: str) -> str:
    """A column name that `df` does not have, in whatever case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def materialize(df: DataFrame, name: str, made: list[str] | None = None) -> DataFrame:
    """Write `df` as a table in the shared folder and read it back: later stages survive lost executors.

    Its shuffle files go as soon as it is written.  `made` gets the table's path, for drop_tables.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    before = spark.conf.get(FREE_SHUFFLES)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(FREE_SHUFFLES, before)
    if made is not None:
        made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_tables(spark: SparkSession, made: list[str]) -> None:
    """Delete tables that nothing reads any more."""
    for path in made:
        drop_path(spark, path)
    made.clear()


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
