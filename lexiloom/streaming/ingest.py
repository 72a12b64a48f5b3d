"""Incremental ingestion, an extension: new transcripts are analysed as they arrive, each on its own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def transcript_stream(spark: SparkSession, folder: str, files_at_once: int = 1_000) -> DataFrame:
    """(visit, text) of files that appear in a folder."""
    d = spark.readStream.option("wholetext", True).option("maxFilesPerTrigger", files_at_once).text(folder)
    return d.select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^./]*)?$", 1).alias("visit"), F.col("value").alias("text"))


def analyse_stream(stream: DataFrame, analyse: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Writes ``analyse`` of each batch under its own number, so that a batch that is run again replaces itself."""

    def sink(batch: DataFrame, number: int) -> None:
        analyse(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    w = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()
