"""Where intermediate results live and how lineage is cut.

Everything that must survive a lost executor is written to the folder named by
``spark.checkpoint.dir``. The setting is read from the session; only where it is
unset and Spark runs in one process (tests, a laptop) a folder of our own is chosen.
"""

from __future__ import annotations

import io
import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``; on a cluster it must be set."""
    set_to = spark.conf.get("spark.checkpoint.dir", None)
    if not set_to:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        set_to = "file://" + os.path.join(tempfile.gettempdir(), f"pairloom-{os.getuid()}")
        spark.conf.set("spark.checkpoint.dir", set_to)
    return set_to.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; removed when the application ends."""
    path = f"{shared_dir(spark)}/pairloom/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here.

    Used where a result is read more than once or an iteration would grow the plan;
    a lost executor then costs a re-read, not a recomputation.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def put_bytes(spark: SparkSession, name: str, data: bytes, ending: str = "") -> str:
    """Write a small driver-built file (a model, a lexicon) to the shared folder."""
    path = scratch_path(spark, name) + ending
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).create(hadoop)
    try:
        for at in range(0, len(data), 1 << 20):
            out.write(bytearray(data[at : at + (1 << 20)]))
    finally:
        out.close()
    return path


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application.

    Executors of a cluster do not have it on their path; it goes out as a zip file in the
    shared folder. Called before a query makes its first Python function.
    """
    context = spark.sparkContext
    if getattr(context, "_pairloom_shipped", False):
        return
    root, buffer = os.path.dirname(os.path.abspath(__file__)), io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(root):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.join(os.path.basename(root), os.path.relpath(full, root)))
    context.addPyFile(put_bytes(spark, "package", buffer.getvalue(), ".zip"))
    context._pairloom_shipped = True
