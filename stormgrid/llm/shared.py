"""Tables written half-way, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import gc
import tempfile
import uuid
from collections.abc import Iterator

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

#: Paths written and not yet deleted, with the table that has its files there, if any, and who owns them.
_written: dict[str, tuple[str | None, str | None]] = {}
_owner: list[str | None] = [None]
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; where it is unset (tests), a temporary folder of this process."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = "file://" + tempfile.mkdtemp(prefix="stormgrid-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def _delete(spark: SparkSession, paths: list[str]) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for at in paths:
        table, _ = _written.pop(at)
        if table:
            spark.sql(f"DROP TABLE IF EXISTS {table}")
        path = jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(conf).delete(path, True)


def _clean(spark: SparkSession) -> None:
    try:
        _delete(spark, list(_written))
    except Exception:  # noqa: BLE001  the session may be gone when the process ends
        pass


def _new(spark: SparkSession, at: str, table: str | None = None) -> None:
    if not _written:
        atexit.register(_clean, spark)
    _written[at] = (table, _owner[0])


def _roots(df: DataFrame) -> str:
    """Folders that df reads, as one text."""
    leaves, out = df._jdf.queryExecution().analyzed().collectLeaves(), []
    for i in range(leaves.size()):
        try:
            out.append(leaves.apply(i).relation().location().rootPaths().mkString(" "))
        except Py4JError:  # no file table
            continue
    return " ".join(out)


@contextlib.contextmanager
def owned(docs: DataFrame, owner: str) -> Iterator[None]:
    """What is written inside belongs to owner. First, what belongs to it from before goes, unless docs reads it: results
    of its earlier steps must have been written by then."""
    roots = _roots(docs)
    _delete(docs.sparkSession, [at for at, (_, who) in _written.items() if who == owner and at.split("/")[-1] not in roots])
    _owner.append(_owner[0])
    _owner[0] = owner
    try:
        yield
    finally:
        _owner[0] = _owner.pop()


def settled(spark: SparkSession, *done: DataFrame) -> None:
    """The tables of `done` are read no more and go. So do shuffle files of finished queries that were not written by
    `materialise` or `bucketed`: Spark deletes them once the driver's JVM has collected their plans."""
    for df in done:
        roots = _roots(df)
        _delete(spark, [at for at in _written if at.split("/")[-1] in roots])
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@contextlib.contextmanager
def _shuffles_go(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a query that ends inside are deleted as it ends: its result is in files, which nothing computes anew."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: lineage ends at files that outlive executors."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    _new(spark, at)
    with _shuffles_go(spark):
        df.write.option("compression", "zstd").parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def bucketed(df: DataFrame, name: str, by: str, buckets: int) -> DataFrame:
    """As materialise, but as a table that joins on `by` needn't shuffle again."""
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex[:12]}"
    at = f"{shared_dir(spark)}/{table}"
    _new(spark, at, table)
    with _shuffles_go(spark):
        df.write.option("compression", "zstd").option("path", at).bucketBy(buckets, by).saveAsTable(table)
    return spark.table(table)


def project(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that columns a caller added cannot clash with an operator's own."""
    return df.select(*[df[n] for n in names])


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared folder; deleted when the process ends."""
    at = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    _new(spark, at)
    return at
