"""Tables on storage that the driver and all executors share."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a lookup table (a few numbers each) up to which it is broadcast; tasks to which a key's rows are dealt beyond that.
LOOKUP, SALTS = 1_000_000, 16
#: Whether a query's shuffle files go when it ends.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Paths that staged() has written since finished() began.
_MADE: ContextVar[list[str] | None] = ContextVar("made", default=None)


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir.  Where it is unset, a new local folder in local mode, and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="palisand-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/palisand/{name}-{uuid.uuid4().hex}"


def shared_files(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one for writers that need plain files.  ValueError unless that is mounted as files."""
    path = new_folder(spark, name)
    if not path.startswith(("file:", "/")):
        raise ValueError(f"{path} is not mounted as files")
    path = "/" + path.removeprefix("file:").lstrip("/")
    os.makedirs(path)
    return path


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """What is written inside leaves no shuffle files behind."""
    before = spark.conf.get(FREED, None)
    spark.conf.set(FREED, "true")
    try:
        yield
    finally:
        spark.conf.set(FREED, before) if before else spark.conf.unset(FREED)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df below the shared folder and read it back: what follows neither
    repeats its work nor depends on executors that may be lost."""
    path = new_folder(df.sparkSession, name)
    if (made := _MADE.get()) is not None:
        made.append(path)
    with shuffles_freed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def finished(name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """make()'s table, staged; the tables that it staged on the way are removed, so make must hand none of them out."""
    token = _MADE.set([])
    try:
        df = make()
        made = list(_MADE.get() or [])
    finally:
        _MADE.reset(token)
    out = staged(df, name)
    for path in made:
        removed(df.sparkSession, path)
    return out


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder on any file system that Spark knows."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def released(*tables: DataFrame) -> None:
    """Delete staged tables.  Nothing that is still to be read may depend on them."""
    for df in tables:
        for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
            removed(df.sparkSession, path)


def looked_up(rows: DataFrame, table: DataFrame, on: str | Sequence[str], how: str, salt: Column | None = None, most: int | None = None) -> DataFrame:
    """rows joined (inner, left, left_semi or left_anti) with a staged table whose keys are unique.  A table of at
    most so many rows (most; LOOKUP where it is not given) is broadcast.  With a larger one, where many rows may share a key, each key is
    copied to SALTS tasks, among which the hash of salt deals the rows; without salt it is a plain join."""
    on = [on] if isinstance(on, str) else list(on)
    if table.count() <= (LOOKUP if most is None else most):
        return rows.join(F.broadcast(table), on, how)
    if salt is None:
        return rows.join(table, on, how)
    many = rows.withColumn("_salt", F.pmod(F.xxhash64(salt), F.lit(SALTS)))
    copies = table.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return many.join(copies, [*on, "_salt"], how).drop("_salt")
