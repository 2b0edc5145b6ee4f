"""Session helpers: tables, and places where lineage is cut."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: list[tuple[object, object]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the session's ``spark.checkpoint.dir``. Where that is unset, a temporary one if the session is local, an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tessel-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def materialize(df: DataFrame, name: str = "cut") -> DataFrame:
    """Cut lineage: write ``df`` as compressed Parquet into the shared folder and read it again.

    A lost executor costs nothing, the files are on shared storage. They are removed when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessel-{uuid.uuid4().hex}-{name}"
    df.write.option("compression", "zstd").parquet(path)
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    _WRITTEN.append((jvm_path, jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())))
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def _remove_written() -> None:
    for path, fs in _WRITTEN:
        try:
            fs.delete(path, True)
        except Exception:  # the JVM may be gone by now
            return
