"""Tables that the engine keeps between queries, in the folder that driver and executors share."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar
from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession


def root(spark: SparkSession) -> str:
    """The shared folder: the checkpoint folder if the session names one, else the warehouse of a local session; a cluster must name it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = spark.conf.get("spark.sql.warehouse.dir")
    return f"{found.rstrip('/')}/foliospark"


#: Rows of an Arrow batch of texts.
BATCH_ROWS = 256


def small_batches() -> None:
    """Arrow batches of this session hold few rows: texts are long, and workers hold a batch in several forms at once."""
    conf, name = SparkSession.active().conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))


#: Rows after which writers of Parquet look at their buffers: one, or a few where rows have been short. Else it is 100 to 10,000, of which
#: each may be a megabyte.
CHECKED_ROWS = {"parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "16"}


def long_rows() -> None:
    """Tables that this session writes may have long rows among short ones: a page or group of rows ends soon after it is full."""
    conf = SparkSession.active().conf
    for name, rows in CHECKED_ROWS.items():
        if not 0 < int(conf.get(name, "0")) <= int(rows):
            conf.set(name, rows)


def status(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    store, at = status(spark, path)
    return store.exists(at)


def delete(spark: SparkSession, path: str) -> None:
    store, at = status(spark, path)
    store.delete(at, True)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Folders right below ``path`` in the order of their names; none where there is no such folder."""
    store, at = status(spark, path)
    if not store.exists(at):
        return []
    return sorted(f.getPath().toString() for f in store.listStatus(at) if f.isDirectory())


def version(spark: SparkSession, path: str) -> str:
    """Changes when the file at ``path``, or any file below that folder, does: names, times and lengths of all."""
    store, at = status(spark, path)
    found, files = sha256(), []
    listed = store.listFiles(at, True)
    while listed.hasNext():
        f = listed.next()
        files.append(f"{f.getPath()}:{f.getModificationTime()}:{f.getLen()}")
    for line in sorted(files):
        found.update(line.encode() + b"\n")
    return found.hexdigest()


def kept(spark: SparkSession, name: str, inputs: list[str], build: Callable[[], DataFrame], by: tuple[str, ...] = ()) -> str:
    """Path of the table ``name`` over ``inputs``, in folders by ``by``; it is built where it is not there for their present state.

    Each build has a folder of its own and counts when its ``_SUCCESS`` file is there, so one that was
    cut off is made again, and two sessions that build at once do not meet.
    """
    key = sha256("\n".join(f"{p}={version(spark, p)}" for p in inputs).encode()).hexdigest()[:24]
    path = f"{root(spark)}/{name}-{key}"

    def built() -> list[str]:
        return [f for f in folders(spark, path) if exists(spark, f"{f}/_SUCCESS")]

    if not built():
        build().write.partitionBy(*by).parquet(f"{path}/build-{uuid.uuid4().hex}")
    return built()[0]


#: Paths of the tables that queries have written for themselves, and those of the innermost ``passing`` of this thread.
WRITTEN: list[str] = []
_PASSING: ContextVar[list[str] | None] = ContextVar("passing", default=None)


@contextlib.contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Tables that this thread writes for itself inside are deleted at the end; what is taken from them must be taken before."""
    mine: list[str] = []
    token = _PASSING.set(mine)
    try:
        yield
    finally:
        _PASSING.reset(token)
        for path in mine:
            delete(spark, path)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table of its own, for what is read more than once: it is computed here, and read from there."""
    spark = df.sparkSession
    path = f"{root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    mine = _PASSING.get()
    (WRITTEN if mine is None else mine).append(path)
    return spark.read.schema(df.schema).parquet(path)


def clean(spark: SparkSession) -> None:
    """Delete the tables that queries have written for themselves; their results must have been taken before."""
    while WRITTEN:
        delete(spark, WRITTEN.pop())
