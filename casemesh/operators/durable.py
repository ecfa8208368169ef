"""Cutting lineage with tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_folder: list[str] = []


class Tables:
    """Tables that are written together and removed together. As a context, it takes in those that are cut inside."""

    _open: list[Tables] = []

    def __init__(self) -> None:
        self.paths: list[str] = []

    def __enter__(self) -> Tables:
        Tables._open.append(self)
        return self

    def __exit__(self, *_: object) -> None:
        Tables._open.remove(self)
        self.release()

    def cut(self, df: DataFrame) -> DataFrame:
        """See cut()."""
        spark = df.sparkSession
        path = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
        df.write.parquet(path)
        self.paths.append(path)
        return spark.read.schema(df.schema).parquet(path)

    def release(self) -> None:
        """Removes the tables. Results that still read them can't be used afterwards."""
        spark = SparkSession.getActiveSession()
        for path in self.paths:
            if path.startswith("file:"):
                shutil.rmtree(path.removeprefix("file://").removeprefix("file:"), ignore_errors=True)
            elif spark is not None:
                try:
                    jvm = spark.sparkContext._jvm
                    target = jvm.org.apache.hadoop.fs.Path(path)
                    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
                except Exception:  # noqa: BLE001 - the session may be gone; the cluster's own clean-up remains
                    pass
        self.paths.clear()


#: Tables that are cut outside of any context: they stay until the driver's Python ends.
_rest = Tables()
atexit.register(_rest.release)


def shared_folder(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir. Only a local session without that setting gets a folder of its own."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own_folder:
        _own_folder.append(tempfile.mkdtemp(prefix="casemesh-"))
        atexit.register(shutil.rmtree, _own_folder[0], True)
    return f"file://{_own_folder[0]}"


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and returns the written table.

    Unlike a cached table it survives the loss of executors, and unlike an RDD checkpoint it stays columnar and
    compressed. The tables are removed with the innermost open Tables, else when the driver's Python ends.
    """
    return (Tables._open[-1] if Tables._open else _rest).cut(df)
