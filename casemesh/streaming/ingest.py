"""Rulings as they are delivered: the batch ingest on micro-batches of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from casemesh.operators import ingest


def raw_stream(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """Raw files of a folder and its subfolders, each once."""
    raw = spark.readStream.schema(ingest.RAW).options(multiLine=True, recursiveFileLookup=True, pathGlobFilter="*.json", maxFilesPerTrigger=files_per_batch, columnNameOfCorruptRecord="_corrupt").json(folder)
    path = F.expr("url_decode(_metadata.file_path)")
    return raw.withColumns({"file_name": F.element_at(F.split(path, "/"), -1), "folder_name": F.element_at(F.split(path, "/"), -2)})


_KEYS = ["id", "jid", "unit_norm", "jyear", "jcase_norm", "jno", "case_type", "doc_type"]


def run(spark: SparkSession, folder: str, courts: DataFrame, decisions: DataFrame, out: str, checkpoint: str, names: tuple[str, ...] = (), **trigger) -> StreamingQuery:
    """Writes rulings, citations, statutes and errors under out; a batch that is run again overwrites itself.

    decisions: the records that are there before, full rulings and placeholders. Every batch is upserted as a folder is
    (ingest.processed): a known jid keeps its id, a placeholder becomes the ruling. trigger: as of DataStreamWriter.trigger,
    by default everything that is there.
    """

    def known(number: int) -> DataFrame:
        before = [f"{out}/rulings/batch={n}" for n in range(number)]
        written = [p for p in before if _exists(spark, p)]
        return decisions.select(*_KEYS) if not written else decisions.select(*_KEYS).unionByName(spark.read.option("mergeSchema", True).parquet(*written).select(*_KEYS))

    def write(batch: DataFrame, number: int) -> None:
        for name, df in ingest.processed(batch, courts, known(number), names).items():
            df.write.mode("overwrite").parquet(f"{out}/{name}/batch={number}")

    return raw_stream(spark, folder).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
