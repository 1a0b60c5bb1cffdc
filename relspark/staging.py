"""Tables in the cluster's shared folder that cut a plan's lineage, and column names that clash with none."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

from pyspark.sql import DataFrame, SparkSession

BATCH_KEY, DEFAULT_BATCH, BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "4m"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_own: list[str] = []
_made: list[list[DataFrame]] = []
_folders: set[str] = set()


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of BATCH bytes at most, unless the session says otherwise: a batch of long texts has to fit in a worker many times over."""
    if spark.conf.get(BATCH_KEY) == DEFAULT_BATCH:
        spark.conf.set(BATCH_KEY, BATCH)


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Unset, a temporary one on a local master; elsewhere executors would not share it: a ValueError."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _own:
            _own.append(f"file://{tempfile.mkdtemp(prefix='relspark-')}")
            atexit.register(shutil.rmtree, _own[0].removeprefix("file://"), ignore_errors=True)
        folder = _own[0]
    return folder.rstrip("/")


def _removed(jvm, conf, folder: str) -> None:
    with suppress(Exception):  # at the driver's end, when the JVM may be gone
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def own_folder(spark: SparkSession) -> str:
    """This application's part of the shared folder, which goes when the driver ends."""
    folder = f"{shared_dir(spark)}/relspark/{spark.sparkContext.applicationId}"
    if folder not in _folders:
        _folders.add(folder)
        atexit.register(_removed, spark._jvm, spark.sparkContext._jsc.hadoopConfiguration(), folder)
    return folder


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts the lineage, survives lost executors.

    Nothing reads the shuffle files of such a write again, so they are removed as soon as it has ended.
    """
    spark = df.sparkSession
    path, was = f"{own_folder(spark)}/{name}-{uuid.uuid4().hex}", spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if was is None else spark.conf.set(CLEANUP, was)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged = path
    for made in _made:
        made.append(out)
    return out


@contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """The tables staged inside are removed at the end, but for those taken out of the list; what reads them has to be staged by then."""
    made: list[DataFrame] = []
    _made.append(made)
    try:
        yield made
    finally:
        _made.remove(made)
        dropped(*made)


def dropped(*tables: DataFrame) -> None:
    """Remove staged tables that no plan reads any more."""
    for df in tables:
        jvm, sc = df.sparkSession._jvm, df.sparkSession.sparkContext
        path = jvm.org.apache.hadoop.fs.Path(df._staged)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def dealt(df: DataFrame) -> DataFrame:
    """A table of fewer files than cores that is too small to be split into a part for each core, dealt over all; others as they are."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    part = int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes")))
    small = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < cores * part
    return df.repartition(cores) if small and len(df.inputFiles()) < cores else df
