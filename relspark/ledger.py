"""A table that grows by parts, each of which is committed whole or not at all.

A part's rows are written to a folder of their own; a manifest, a numbered file that names all parts so far, makes them the table's. It
is written aside and renamed to its number, which fails where that number is taken, so of two runs that append at once one commits and
the other is told so. What a run wrote before it was stopped is in no manifest and is never read.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .staging import fresh

PARTS, COMMITS = "parts", "commits"


class Conflict(RuntimeError):
    """Another run committed first."""


def _context(spark: SparkSession):
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    return jvm, lambda p: jvm.org.apache.hadoop.fs.Path(p).getFileSystem(conf)


def manifest(spark: SparkSession, path: str) -> tuple[int, dict[str, str]]:
    """The last commit's number (0: none) and its parts, name -> folder."""
    jvm, fs_of = _context(spark)
    folder = jvm.org.apache.hadoop.fs.Path(f"{path}/{COMMITS}")
    fs = fs_of(f"{path}/{COMMITS}")
    names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
    last = max((int(n) for n in names if n.isdigit()), default=0)
    if not last:
        return 0, {}
    return last, json.loads(spark.read.text(f"{path}/{COMMITS}/{last:09d}", wholetext=True).first()[0])


def _commit(spark: SparkSession, path: str, number: int, parts: dict[str, str]) -> None:
    jvm, fs_of = _context(spark)
    at = lambda name: jvm.org.apache.hadoop.fs.Path(f"{path}/{COMMITS}/{name}")
    aside, final = at(f"_aside-{uuid.uuid4().hex}"), at(f"{number:09d}")
    out = fs_of(f"{path}/{COMMITS}").create(aside)
    out.write(bytearray(json.dumps(parts, sort_keys=True).encode()))
    out.close()
    conf, context = spark.sparkContext._jsc.hadoopConfiguration(), jvm.org.apache.hadoop.fs.FileContext
    files = context.getFileContext(aside.toUri(), conf) if aside.toUri().getScheme() else context.getFileContext(conf)
    options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)  # none: a taken name is an error
    try:
        files.rename(aside, final, options)
    except Exception as e:
        if "already exists" in str(e).lower() or "FileAlreadyExists" in str(e):
            raise Conflict(f"{path}: commit {number} was made by another run") from e
        raise


def read(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """All committed rows."""
    _, parts = manifest(spark, path)
    folders = [f"{path}/{PARTS}/{f}" for f in parts.values()]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def append_once(df: DataFrame, path: str, key: str, part: str | None = None) -> DataFrame:
    """Appends the rows of df whose key the table does not hold yet, each key once, and gives the whole table: a stopped run goes on there.

    Of several rows of one key that with the least hash of its columns is taken; columns are of kinds that can be compared (no maps). A null key is a key like any other. part: a name for what
    is appended (default: one of its own). A Conflict is raised if another run committed meanwhile; nothing is appended then.
    """
    spark, last = df.sparkSession, manifest(df.sparkSession, path)
    if part in last[1]:
        return read(spark, path, df.schema)
    order = F.struct(F.xxhash64(*df.columns).alias("hash"), F.struct(*df.columns).alias("row"))
    rows = df.groupBy(F.col(key).alias("key")).agg(F.min(order).alias("least")).select("least.row.*")
    if last[1]:
        held = read(spark, path, df.schema).select(F.col(key).alias(fresh(df, "held"))).distinct()
        rows = rows.join(held, F.col(key).eqNullSafe(F.col(held.columns[0])), "left_anti")
    folder = uuid.uuid4().hex
    rows.select(*df.columns).write.parquet(f"{path}/{PARTS}/{folder}")
    _commit(spark, path, last[0] + 1, last[1] | {part or folder: folder})
    return read(spark, path, df.schema)


def suite(spark: SparkSession, path: str, parts: dict[str, Callable[[], DataFrame]], key: str) -> DataFrame:
    """Runs the parts of a suite that no commit names yet, one after another, and gives all parts' rows merged, each key once.

    A run that is stopped in the middle is started again with the same parts: those committed are not run, the one it was stopped in is
    run from its beginning. A key that an earlier part holds is not taken from a later one.
    """
    merged: DataFrame | None = None
    for name, made in parts.items():
        if name not in manifest(spark, path)[1]:
            merged = append_once(made(), path, key, name)
    if merged is not None:
        return read(spark, path, merged.schema)
    _, done = manifest(spark, path)
    return spark.read.parquet(*[f"{path}/{PARTS}/{f}" for f in done.values()])


def status(spark: SparkSession, path: str, parts: list[str]) -> dict[str, bool]:
    """Which of the parts are committed."""
    done = manifest(spark, path)[1]
    return {p: p in done for p in parts}
