"""Files or texts as they arrive: detection has no state across documents, so any micro-batch can be analysed alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.compile_text import compiled, decided, verified
from ..operators.detect import text_findings


def analyzed_stream(spark: SparkSession, folder: str, intent: str, style: str = "token") -> DataFrame:
    """A stream of JSON lines (doc_id, text): findings, decisions, output and verification of each document."""
    rows = spark.readStream.schema("doc_id bigint, text string").json(folder)
    return verified(compiled(decided(text_findings(rows), intent), style))


def run_available(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Analyses what is there now, exactly once, and stops."""
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
