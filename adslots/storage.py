"""Tables stored on the way: where they go, and how they go away again."""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; a temporary one only where the setting is unset and all is local."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


#: Folders written by `cut`, by the scopes that are open in this thread, the innermost last.
_scopes: contextvars.ContextVar[tuple[list[str], ...]] = contextvars.ContextVar("scopes", default=())


def scratch_path(spark: SparkSession, name: str, outer: bool = False) -> str:
    """A folder of its own in the shared one, which goes with the innermost scope; with `outer`, with the one around."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    scopes = _scopes.get()
    if len(scopes) > outer:
        scopes[-1 - outer].append(path)
    return path


def cut(df: DataFrame, outer: bool = False) -> DataFrame:
    """`df` written as Parquet to the shared folder and read again: lineage ends there, on replicated
    storage, so a lost executor costs no recomputation and reruns of what follows read the same rows. With `outer` it
    outlives the innermost scope."""
    spark = df.sparkSession
    path = scratch_path(spark, "cut", outer)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def _remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes at its end what `cut` has written inside it. Whoever reads a query's result does so inside."""
    mine: list[str] = []
    before = _scopes.set((*_scopes.get(), mine))
    try:
        yield
    finally:
        _scopes.reset(before)
        for path in mine:
            _remove(spark, path)


def drop_cut(df: DataFrame) -> None:
    """Removes what `cut` wrote for `df` once nothing reads it any more, as loops do with the round before."""
    _remove(df.sparkSession, df._cut_path)
