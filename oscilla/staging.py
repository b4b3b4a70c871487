"""Tables written to the shared folder: they cut lineage and outlive executors.

The folder is the session's spark.checkpoint.dir; a local session without that
setting gets a temporary one. Tables written within a ``scratch`` block are removed
when it ends, all but those it keeps; the others when the application ends.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_own_root: dict[str, str] = {}
_written: ContextVar[list[str] | None] = ContextVar("written", default=None)


def shared_dir(spark: SparkSession) -> str:
    """This application's folder below spark.checkpoint.dir; local sessions without that setting get a temporary one."""
    app = spark.sparkContext.applicationId
    if app not in _own_root:
        root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            root = f"file://{tempfile.mkdtemp(prefix='oscilla-')}"
        _own_root[app] = f"{root.rstrip('/')}/{app}"
        atexit.register(_drop, spark, _own_root[app])
    return _own_root[app]


def _drop(spark: SparkSession, path: str) -> None:
    try:
        delete(spark, path)
    except Exception:  # the session may have ended before the interpreter does
        return


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


class Staged:
    """A written table; df reads it."""

    def __init__(self, df: DataFrame, name: str):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/{name}-{uuid.uuid4().hex[:12]}"
        df.write.option("compression", "zstd").parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)
        if (written := _written.get()) is not None:
            written.append(self.path)

    def drop(self) -> None:
        delete(self.spark, self.path)


def staged(df: DataFrame, name: str) -> DataFrame:
    return Staged(df, name).df


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[Staged]]:
    """Gives a list; at the block's end the tables written in it are removed, all but those put into the list.

    What is kept belongs to the enclosing block, if there is one.
    """
    outer, kept = _written.get(), []
    own: list[str] = []
    token = _written.set(own)
    try:
        yield kept
    finally:
        _written.reset(token)
        keep = {x.path for x in kept}
        for path in own:
            if path not in keep:
                _drop(spark, path)
        if outer is not None:
            outer.extend(keep)
