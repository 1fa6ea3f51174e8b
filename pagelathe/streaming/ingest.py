"""Files that arrive in a folder, parsed in micro-batches: each batch is a window with warnings and errors of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pagelathe.sources import files

FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def arriving(spark: SparkSession, folder: str, window: int = 64) -> DataFrame:
    """New files of a folder, at most window in a batch."""
    return spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("maxFilesPerTrigger", window).load(folder)


def write_windows(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Parse each batch once and append its rows as JSON lines under out/<record>, with the batch's number as window.

    A batch that is run again overwrites its own folder, so that each file is written once.
    """

    def write(batch: DataFrame, window: int) -> None:
        rows = files.parsed(batch.select("path", "content")).withColumn("window", F.lit(window)).drop("content").persist()
        for record in ("block", "note", "asset", "warning", "error"):
            rows.where(F.col("record") == record).write.mode("overwrite").json(f"{out}/{record}/window={window}")
        rows.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
