"""Files as rows: intake by extension, and analyses kept as written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed


def read_files(spark: SparkSession, path: str, glob: str | None = None, stream: bool = False) -> DataFrame:
    """doc_id (a hash of the path), path, ext, kind (null for an unknown extension), length, content."""
    if stream:
        reader = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary")
    else:
        reader = spark.read.format("binaryFile")
    rows = (reader.option("pathGlobFilter", glob) if glob else reader).option("recursiveFileLookup", "true").load(path)
    return with_kind(rows).select(F.xxhash64("path").alias("doc_id"), "path", "ext", "kind", "length", "content")


def with_kind(rows: DataFrame, path: str = "path") -> DataFrame:
    ext = F.lower(F.regexp_extract(path, r"(\.[^./\\]*)$", 1))
    known = F.create_map(*[F.lit(x) for k, v in fixed.EXTENSIONS.items() for x in (k, v)])
    return rows.withColumn("ext", ext).withColumn("kind", F.try_element_at(known, F.col("ext")))


def quarantined(rows: DataFrame) -> DataFrame:
    """Files that no analyser takes."""
    return rows.filter("kind is null").select("doc_id", "path", "ext")


def media_type(ext):
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for k, v in fixed.MEDIA_TYPES.items() for x in (k, v)]), F.lower(ext)), F.lit("application/octet-stream"))


def output_name(path):
    return F.concat(F.lit("sanitized_"), F.regexp_extract(path, r"([^/\\]*)$", 1))


class Sessions:
    """Analyses and outputs by document and run, as Parquet under one folder; a run that is repeated replaces itself."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def create(self, rows: DataFrame, run: str) -> None:
        rows.write.mode("overwrite").parquet(f"{self.folder}/analyses/run={run}")

    def set_output(self, rows: DataFrame, run: str) -> None:
        rows.write.mode("overwrite").parquet(f"{self.folder}/outputs/run={run}")

    def get(self, run: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/analyses/run={run}")

    def output(self, run: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/outputs/run={run}")
