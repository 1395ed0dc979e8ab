"""Session helpers: table access and lineage cuts that outlive an executor."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``.

    Where the session names none, a folder of our own serves on one machine and goes when the process ends; on a cluster,
    whose machines don't share one, that is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("name a folder that all machines share in spark.checkpoint.dir")
        if not named:
            named = tempfile.mkdtemp(prefix="lexquarry-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the checkpoint folder, its lineage gone."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def bounded(df: DataFrame, max_rows: int = 10_000) -> DataFrame:
    """``df`` marked for broadcast if a count proves that it has at most ``max_rows`` rows, else as it is."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def local_table(spark: SparkSession, rows: list[tuple], schema: str | StructType) -> DataFrame:
    """A few rows of the driver as a table that is part of the plan: by Arrow, without a Python worker or a job to make it."""
    kind = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    columns = [pa.array([r[i] for r in rows], to_arrow_type(f.dataType)) for i, f in enumerate(kind.fields)]
    return spark.createDataFrame(pa.Table.from_arrays(columns, names=kind.names), kind)


def spread(df: DataFrame) -> DataFrame:
    """``df`` in as many partitions as the session runs tasks, if it reads few files that make fewer; else as it is.

    For work that is heavy per row on input that came in few files. What moves is less than one split of ``spark.sql.files.maxPartitionBytes`` for each task.
    """
    spark, files = df.sparkSession, df.inputFiles()
    tasks = spark.sparkContext.defaultParallelism
    if not 0 < len(files) < tasks:
        return df
    path, conf = spark._jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()
    held = sum(path(f).getFileSystem(conf).getFileStatus(path(f)).getLen() for f in files)
    split = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    return df.repartition(tasks) if held < split * tasks else df


def ship(spark: SparkSession) -> None:
    """Hands this package to the session's Python workers, once, so that they can import it on any machine.

    Spark serves the archive from the driver; it holds code only.
    """
    import zipfile
    from pathlib import Path

    sc = spark.sparkContext
    if getattr(sc, "_lexquarry_shipped", False):
        return
    root, d = Path(__file__).resolve().parents[1], tempfile.mkdtemp()
    atexit.register(shutil.rmtree, d, ignore_errors=True)
    path = os.path.join(d, "lexquarry.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(path)
    sc._lexquarry_shipped = True
