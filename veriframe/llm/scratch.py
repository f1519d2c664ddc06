"""Written intermediate tables, and how they go when nothing reads them any more."""

from __future__ import annotations

import urllib.parse
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from veriframe.session import shared_folder

_collecting: list[list[str]] = []


@contextmanager
def collected(paths: list[str]):
    """Within this block `kept` adds the folders it makes to `paths`."""
    _collecting.append(paths)
    try:
        yield
    finally:
        _collecting.remove(paths)


def kept(df: DataFrame, name: str) -> DataFrame:
    """The frame as a table in the shared folder."""
    path = shared_folder(df.sparkSession, name)
    for paths in _collecting:
        paths.append(path)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)  # else a job reads it from the files
    table._scratch_path = path
    return table


def drop(*tables: DataFrame) -> None:
    """Delete tables of `kept` whose successors are written; no plan may read them after this."""
    for table in tables:
        _delete(table.sparkSession, table._scratch_path)


def release(docs: DataFrame, paths: list[str]) -> None:
    """Delete the folders in `paths`, but for those that `docs` still reads, and forget them."""
    read = {_plain(f) for f in docs.inputFiles()}
    for path in [p for p in paths if not any(f.startswith(f"{_plain(p)}/") for f in read)]:
        _delete(docs.sparkSession, path)
        paths.remove(path)


def _plain(uri: str) -> str:
    return urllib.parse.unquote(urllib.parse.urlparse(uri).path)


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
