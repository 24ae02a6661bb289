"""What the operators share: reading a table's columns, and cutting lineage."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of a table; other columns are never read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def _shared(spark: SparkSession) -> str:
    """The checkpoint folder: spark.checkpoint.dir.

    Where that is unset and all runs in one machine's JVM, as in tests, a temporary folder is made; on a
    cluster a folder that is unset is an error.
    """
    if spark.sparkContext.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return spark.sparkContext.getCheckpointDir()


@contextmanager
def tidied(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of queries that run in here go as they end; else they stay until the driver's garbage is collected."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def cut(df: DataFrame) -> DataFrame:
    """df, written once to the shared checkpoint folder, so that what follows always sees the same rows."""
    _shared(df.sparkSession)
    with tidied(df.sparkSession):
        return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """df as a Parquet table of its own in the shared checkpoint folder: later steps read the columns they need."""
    folder = f"{_shared(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


_held: dict[str, Callable[[], None]] = {}


def claim(owner: str, clear: Callable[[], None] | None = None) -> None:
    """Called when an operator's step starts in a Python worker: what other operators remember there goes.

    clear: how to drop what this operator remembers between tasks.
    """
    for name in [n for n in _held if n != owner]:
        _held.pop(name)()
    if clear:
        _held[owner] = clear


def bucket_of(doc_id, n: int):
    """crc32 of doc_id as text, modulo n."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def fresh(df: DataFrame, name: str) -> str:
    """name, or name with underscores after it, such that df has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
