"""Session helpers: table loading and the shared checkpoint folder."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the test tables by name."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names in spark.checkpoint.dir.

    Only where executors are threads of this process (tests, one machine) a folder of the machine takes its place; on a
    cluster each machine would have its own, so a missing setting is an error there.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="pagewright-ckpt-")
    sc.setCheckpointDir(named)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives the loss of executors, unlike a local one."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_written: list[str] = []


def materialise(df: DataFrame) -> DataFrame:
    """Write a table that is used several times as Parquet in the shared folder and read it back.

    Like a checkpoint it survives the loss of executors, but it is compressed and columnar, so each use reads
    only the columns it needs. The folder is removed when the driver's process ends, or with ``tables_of``.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def tables_of(spark: SparkSession) -> Iterator[None]:
    """Remove the tables written within when it ends, as a micro-batch does once its result is written."""
    begun = len(_written)
    try:
        yield
    finally:
        for path in _written[begun:]:
            _remove(spark, path)
        del _written[begun:]


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone by then, and the folder with it
        pass


def ship_package(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once per context, wherever they run."""
    import zipfile
    from pathlib import Path

    sc = spark.sparkContext
    if getattr(sc, "_pagewright_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="pagewright-")) / "pagewright.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(target))
    sc._pagewright_shipped = True
