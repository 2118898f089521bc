"""Stores that are read, edited and replaced: whole versions behind a manifest.

A version is a folder of parquet files that nobody changes.  The manifest holds one
small file per version, named by its number, and making that file is the commit: the
file system lets one writer make it.  Who edits says which version was read; if
another version has been committed meanwhile, the commit is refused and nothing of
it is seen.
"""

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, types as T


class Conflict(Exception):
    """Another version was committed since the one that was read."""


def _files(spark: SparkSession, path: str):
    """The file system of a path, and a function that makes paths on it."""
    jvm = spark._jvm
    make = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    return make(path).getFileSystem(spark._jsc.hadoopConfiguration()), make


def latest_version(spark: SparkSession, path: str) -> int:
    """Number of the newest version, 0 if there is none."""
    files, make = _files(spark, path)
    folder = make(f"{path}/manifest")
    if not files.exists(folder):
        return 0
    return max((int(f.getPath().getName()) for f in files.listStatus(folder) if f.getPath().getName().isdigit()), default=0)


def read_version(spark: SparkSession, path: str, schema: T.StructType, version: int | None = None) -> tuple[int, DataFrame]:
    """A version's number and rows, the newest by default; 0 and no rows where nothing was committed."""
    version = latest_version(spark, path) if version is None else version
    if not version:
        return 0, spark.createDataFrame([], schema)
    files, make = _files(spark, path)
    stream = files.open(make(f"{path}/manifest/{version}"))
    try:
        name = stream.readUTF()
    finally:
        stream.close()
    return version, spark.read.schema(schema).parquet(f"{path}/data/{name}")


def commit_version(df: DataFrame, path: str, based_on: int) -> int:
    """Store rows as the version after ``based_on``; ``Conflict`` if that number is taken.

    The rows may come from the version they replace.
    """
    spark, name = df.sparkSession, uuid.uuid4().hex
    files, make = _files(spark, path)
    if latest_version(spark, path) != based_on:
        raise Conflict(f"version {based_on} is not the newest of {path}")
    df.write.parquet(f"{path}/data/{name}")
    try:
        stream = files.create(make(f"{path}/manifest/{based_on + 1}"), False)
    except Exception as error:  # the file system tells in its own words that the file is there
        if latest_version(spark, path) <= based_on:
            raise
        raise Conflict(f"version {based_on} is not the newest of {path}") from error
    try:
        stream.writeUTF(name)
    finally:
        stream.close()
    return based_on + 1


def edit_store(spark: SparkSession, path: str, schema: T.StructType, change: Callable[[DataFrame], DataFrame], tries: int = 5) -> int:
    """Read the newest version, change it and commit; on a conflict the change is made anew on the newer one."""
    for turn in range(tries):
        version, rows = read_version(spark, path, schema)
        try:
            return commit_version(change(rows), path, version)
        except Conflict:
            if turn == tries - 1:
                raise
    raise ValueError("at least one try")


def drop_folder(spark: SparkSession, path: str) -> bool:
    """Take a folder of superseded files away; whether it was there."""
    files, make = _files(spark, path)
    return files.delete(make(path), True)
