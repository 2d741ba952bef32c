"""Session construction and the durable (lineage-cutting) stage helper."""

from __future__ import annotations

import atexit
import contextlib
import contextvars
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_OWN_DIRS: list[str] = []
_SCOPE: contextvars.ContextVar[Stages | None] = contextvars.ContextVar("stages", default=None)


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A single-JVM session for tests and benchmarks; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("loomql")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", conf.pop("driver_memory", "8g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach: ``spark.checkpoint.dir``.

    Only where the session names none and runs in one local process (tests, ``bench.py``) an own folder is made,
    and removed again at exit; on a cluster the setting is required.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors can reach")
    if not _OWN_DIRS:
        _OWN_DIRS.append(tempfile.mkdtemp(prefix="loomql-"))
        atexit.register(shutil.rmtree, _OWN_DIRS[0], True)
    return "file://" + _OWN_DIRS[0]


class Stages:
    """The tables ``durable`` wrote within a ``stages()`` block."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths, self.kept = spark, [], []

    def keep(self, *dfs: DataFrame) -> None:
        """Leave these tables to the block around this one: something returned still reads them."""
        read = [f for df in dfs for f in df.inputFiles()]
        self.kept += [p for p in self.paths if any(p.rsplit("/", 1)[1] in f for f in read)]

    def drop(self) -> None:
        jvm = self.spark._jvm
        for p in self.paths:
            if p not in self.kept:
                path = jvm.org.apache.hadoop.fs.Path(p)
                path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


@contextlib.contextmanager
def stages(spark: SparkSession) -> Iterator[Stages]:
    """Deletes, at its end, the tables written by ``durable`` within it, but for those kept.

    Around a query and the writing of its result it leaves nothing behind; operators use it around their rounds.
    """
    scope = Stages(spark)
    outer = _SCOPE.get()
    token = _SCOPE.set(scope)
    try:
        yield scope
    finally:
        _SCOPE.reset(token)
        scope.drop()
        if outer is not None:
            outer.paths += scope.kept


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Within it, the shuffle files of a query go as soon as it has run, not when the driver happens to collect its garbage.

    For queries that are run once, as ``durable`` does; one that is run again would make its shuffles again.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def durable(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage with files that survive the loss of any executor, and gives
    the planner exact sizes. Use it where a result is read more than once, or where
    a value (an assigned number, a random choice) must not change on recomputation.
    A ``stages()`` block deletes the table at its end; without one it stays in the folder.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loomql-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if (scope := _SCOPE.get()) is not None:
        scope.paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


def durable_by(df: DataFrame, column: str, name: str = "parts") -> str:
    """Write ``df`` as a table with one folder ``column=value`` for each value, and return its path."""
    path = f"{shared_dir(df.sparkSession)}/loomql-{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(column).parquet(path)
    if (scope := _SCOPE.get()) is not None:
        scope.paths.append(path)
    return path
