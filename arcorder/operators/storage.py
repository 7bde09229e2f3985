"""Written intermediate tables: they cut long lineages and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
#: Tables written inside the innermost scratch() of this thread.
_tracked: ContextVar[list[DataFrame] | None] = ContextVar("tracked", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; where it names none, a fresh one, but only on one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        folder = _own.get(app) or _own.setdefault(app, tempfile.mkdtemp(prefix="arcorder-"))
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._folder = path
    if (tracked := _tracked.get()) is not None:
        tracked.append(out)
    return out


class Scratch:
    """Names the tables that outlive a scratch() block."""

    def __init__(self) -> None:
        self.kept: list[DataFrame] = []

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """df written to a table that stays when the block ends."""
        out = written(df, name)
        self.kept.append(out)
        return out


@contextmanager
def scratch() -> Iterator[Scratch]:
    """Deletes the tables that written() makes inside the block when it ends, but those kept; blocks may nest.

    What leaves the block has to be kept, as everything else reads tables that are gone.
    """
    outer = _tracked.get()
    tables: list[DataFrame] = []
    token, work = _tracked.set(tables), Scratch()
    try:
        yield work
    finally:
        _tracked.reset(token)
        folders = {t._folder for t in work.kept}
        with suppress(Exception):  # a session that is gone takes its tables' folder with it
            discard(*[t for t in tables if t._folder not in folders])
        if outer is not None:
            outer += work.kept


def discard(*tables: DataFrame) -> None:
    """Delete tables from written() that nothing reads any more."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table._folder)
        path.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
