"""Coverage, reports and views of findings; nothing here returns a raw value."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import scalar as S


def public(rows: DataFrame) -> DataFrame:
    """Findings without their values, with a type's name and explanation."""
    return rows.drop("raw").withColumns({"label": S.type_label("type"), "description": S.type_description("type")})


def secrets(rows: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    return rows.select(doc_id, "id", "raw")


def coverage(spark: SparkSession, ext: str | None = None, own: bool = False) -> DataFrame:
    """kind, category, checked, detail; own: what this engine inspects itself. Unknown extensions have no rows."""
    rows = [(k, f"{k}.{c}", ok and not (own and c in fixed.OWN_COVERAGE[k]), d) for k, items in fixed.COVERAGE.items() for c, ok, d in items]
    out = spark.createDataFrame(rows, "kind string, category string, checked boolean, detail string")
    return out if ext is None else out.filter(F.col("kind") == fixed.EXTENSIONS.get(ext.lower(), ""))


def unchecked(covered: DataFrame) -> DataFrame:
    return covered.filter(~F.col("checked")).select("kind", "category")


def badge(removed, decision, ocr=None):
    """Text of the verification badge; findings that aren't to be removed have none."""
    visual = F.lit(False) if ocr is None else F.coalesce(ocr, F.lit(False))
    either = lambda k: F.when(visual, F.lit(fixed.BADGES[f"{k}_ocr"])).otherwise(F.lit(fixed.BADGES[k]))
    return F.when(decision != "REMOVE", F.lit("")).when(removed, either("removed")).when(~removed, either("present")).otherwise(F.lit(fixed.BADGES["unknown"]))


def exif_diff(exif: DataFrame) -> DataFrame:
    """doc_id, tag, original, sanitized, changed for each tag of either side; null and empty are the same."""
    side = lambda s: exif.filter(F.col("side") == s).select("doc_id", "tag", F.col("value").alias(s))
    both = side("original").join(side("sanitized"), ["doc_id", "tag"], "full_outer")
    return both.withColumn("changed", F.coalesce("original", F.lit("")) != F.coalesce("sanitized", F.lit("")))


def counts(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n_findings"), F.countDistinct("doc_id").alias("n_documents"))


def cube(rows: DataFrame) -> DataFrame:
    """Findings by type, severity and decision, with all subtotals."""
    return rows.cube("type", "severity", "decision").agg(F.count(F.lit(1)).alias("n_findings"), F.grouping_id().alias("level"))
