"""Shared pieces of the training-data operators: table access, scratch tables and keys."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch sent to Python; texts may be long, so batches stay small.
BATCH_ROWS = 256

#: The bytes that separate words: space and \t \n \v \f \r.
WORD_BREAK = r"[\x20\x09-\x0D]+"

_scratch: list[tuple[object, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Never more than ``BATCH_ROWS`` rows to a batch; a smaller setting stays, so the order of calls does not matter."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def rebatched(batches, rows: int = BATCH_ROWS):
    """The same rows in batches of at most ``rows``, whatever the session's setting is when the plan runs."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


@contextmanager
def batch_rows(spark: SparkSession, rows: int):
    """Batches of another size for what runs inside; the session's setting is as before after it."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (spark.checkpoint.dir).

    Only where the session names none and runs in one process (tests) a local folder is made and set.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = spark.conf.get("leafmill.scratch", None)
    if not own:
        own = "file://" + tempfile.mkdtemp(prefix="leafmill-")
        spark.conf.set("leafmill.scratch", own)
        spark.sparkContext.setCheckpointDir(own)
    return own


def materialize(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    return df.sparkSession.read.schema(df.schema).parquet(write_scratch(df, name, **options))


def write_scratch(df: DataFrame, name: str, **options: str) -> str:
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/leafmill-{uuid.uuid4().hex[:12]}-{name}"
    df.write.options(**options).parquet(path)
    _scratch.append((spark, path))
    return path


@atexit.register
def _drop_scratch() -> None:
    for spark, path in _scratch:
        try:
            jvm = spark._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session may be gone already; the others are tried all the same
            continue


def crc_mod(column: Column, mod: int) -> Column:
    """crc32 of the id as decimal text, modulo ``mod``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % mod


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def row_key(*names: str) -> Column:
    """A never-null 64-bit key of a document: its id together with its text."""
    return F.xxhash64(*[F.col(n) for n in names])


def with_local_order(df: DataFrame, *order: str, ties: tuple[str, ...] = ()) -> DataFrame:
    """Rows range-partitioned by ``order`` and sorted by it and then ``ties``, with their partition and place in it.

    A sample of the values of ``order`` goes to the driver, so these are numbers or short; ``ties`` may
    be whole texts. The places come from monotonically_increasing_id, so no task sees more than its own range.
    """
    mid = F.monotonically_increasing_id()
    ranged = df.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order, *ties)
    return ranged.withColumns(
        {"__part": F.shiftright(mid, 33).cast("int"), "__idx": mid.bitwiseAND(F.lit((1 << 33) - 1))}
    )
