"""Session-level helpers: lineage cuts and size-checked joins.

Two rules hold everywhere in the package:

* an intermediate table that several later jobs read is cut from its lineage
  with a reliable checkpoint in the folder the session names;
* a table is broadcast only after its size has been counted; beyond the limit
  the same join runs as a salted shuffle join, so a hot key is spread out.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: largest table (bytes, estimated from a row count) that may be broadcast
BROADCAST_BYTES = 64 * 1024 * 1024
#: number of pieces a join key is split into when the small side is too large
JOIN_SALTS = 32


def _prepare_checkpoint_dir(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not re.match(r"local(\[|$)", sc.master):  # local-cluster[...] has executors of its own
            raise RuntimeError(
                "set spark.checkpoint.dir to a folder every executor can reach"
            )
        folder = tempfile.mkdtemp(prefix="runwatch-checkpoint-")
    sc.setCheckpointDir(folder)


def ship(spark: SparkSession) -> None:
    """Send this package's modules to the Python workers, once per application.

    Workers that run in another folder, or on another machine, then import the same
    code as the driver.  Not needed where the package is installed on every machine.
    """
    sc = spark.sparkContext
    if getattr(sc, "_runwatch_shipped", False):
        return
    home = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="runwatch-"), "runwatch.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, files in os.walk(home):
            for name in sorted(files):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(home)))
    sc.addPyFile(archive)
    sc._runwatch_shipped = True


@contextmanager
def _without_constraints(spark: SparkSession) -> Iterator[None]:
    """Plan without the search for inferred filters.

    A checkpoint hands the constraints of its plan on to every plan that reads it, so they pile up
    over a chain of steps until planning one takes longer than running it.  Results do not depend on them.
    """
    key = "spark.sql.constraintPropagation.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def materialise(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and store it reliably; later jobs read the stored copy."""
    _prepare_checkpoint_dir(df.sparkSession)
    with _without_constraints(df.sparkSession):
        return df.checkpoint(eager=True)


def visible(spark: SparkSession, path: str) -> str:
    """``path``, or where its name begins with ``_`` or ``.`` the path of a copy Spark's readers do not pass over.

    The file system copies the bytes into the checkpoint folder; they are not held in memory.
    """
    name = path.rstrip("/").rsplit("/", 1)[-1]
    if name[:1] not in ("_", "."):
        return path
    _prepare_checkpoint_dir(spark)
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    source = hadoop.Path(path)
    target = hadoop.Path(
        f"{spark.sparkContext.getCheckpointDir()}/visible-{uuid.uuid4().hex}/{name.lstrip('_.') or 'file'}")
    hadoop.FileUtil.copy(source.getFileSystem(conf), source, target.getFileSystem(conf), target, False, conf)
    return target.toString()


def stored(df: DataFrame) -> DataFrame:
    """``materialise`` for tables that grow with the data: compressed columns, read back as needed."""
    _prepare_checkpoint_dir(df.sparkSession)
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/stored-{uuid.uuid4().hex}"
    with _without_constraints(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def attach(
    df: DataFrame,
    small: DataFrame,
    keys: list[str],
    row_bytes: int = 256,
    how: str = "inner",
    limit: int | None = None,
    rows: int | None = None,
) -> DataFrame:
    """Equi-join a reduced table onto ``df``.

    ``small`` holds at most one row per key (or a few, one per chain).  It is
    counted here, so it should be materialised, unless the caller already knows
    its size (``rows``).  Within ``limit`` bytes it is
    broadcast, which leaves the partitioning of ``df`` alone.  Beyond it both
    sides are salted: each key of ``df`` is spread over ``JOIN_SALTS`` reducers by
    the partition its rows come from, and ``small`` is replicated to match.
    """
    limit = BROADCAST_BYTES if limit is None else limit
    if (small.count() if rows is None else rows) * row_bytes <= limit:
        return df.join(F.broadcast(small), keys, how)
    # a row's partition is known to every retry, and equal rows of one group are spread as well
    salted = df.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(JOIN_SALTS)))
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(JOIN_SALTS - 1))))
    return salted.join(copies.hint("shuffle_merge"), [*keys, "_salt"], how).drop("_salt")


def bounded_batches(df: DataFrame, size: int = 8 << 20) -> DataFrame:
    """``df`` as it is, with the session's bound on the bytes of an Arrow batch at most ``size``.

    For rows so wide that a bound on their number does not bound a batch.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    units = df.sparkSession._jvm.org.apache.spark.network.util.JavaUtils
    if not 0 < units.byteStringAsBytes(df.sparkSession.conf.get(key)) <= size:
        df.sparkSession.conf.set(key, str(size))
    return df


def col(name: str) -> Column:
    """Column by exact name, also when the name holds dots or spaces."""
    return F.col("`" + name.replace("`", "``") + "`")
