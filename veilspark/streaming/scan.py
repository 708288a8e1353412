"""The same scan over a stream: stateless, so it needs no watermark and has no state to bound."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from veilspark.operators.scan import analyse


def text_stream(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """``source, text`` of JSON-line files ``{source, text}`` as they arrive in a folder."""
    return spark.readStream.schema("source string, text string").option("maxFilesPerTrigger", files_per_trigger).json(folder)


def report_stream(stream: DataFrame, id_col: str = "source", show_values: bool = False) -> DataFrame:
    return analyse(stream, id_col=id_col, show_values=show_values)


def level_counts(stream: DataFrame, id_col: str = "source") -> DataFrame:
    """Running number of documents by level; its state is the three levels."""
    return analyse(stream, id_col=id_col).groupBy(F.col("sensitivity.level").alias("level")).count()


def start(reports: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Exactly-once files of reports; every file that has arrived is worked off, then the query ends."""
    return reports.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
