"""Items that a user names: each becomes a finding that is always removed, placed in the texts that hold it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S


def clean_terms(terms: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """doc_id, term_no, term without blanks around; blank ones are dropped."""
    return terms.withColumn("term", S.strip(F.coalesce("term", F.lit("")))).filter("term <> ''")


def term_findings(terms: DataFrame, texts: DataFrame, doc_id: str = "doc_id", part: str = "part", part_no: str = "part_no", text: str = "text", default_part: str = "text", missing: str = "recoverable") -> DataFrame:
    """A finding for each term and text part that contains it (case-sensitive); for a term in no part, one with visibility `missing`.

    texts: doc_id, part, part_no, text. Terms meet the parts of their own document only.
    """
    own = clean_terms(terms, doc_id)
    parts = texts.select(F.col(doc_id).alias("_doc"), F.col(part).alias("location"), F.col(part_no).alias("_part_no"), F.col(text).alias("_text"))
    held = own.join(parts, (F.col(doc_id) == F.col("_doc")) & F.contains(F.col("_text"), F.col("term")), "left")
    rows = held.select(
        doc_id, "term_no", "_part_no", F.lit("USER_SPECIFIED").alias("type"), F.coalesce("location", F.lit(default_part)).alias("location"),
        F.when(F.col("_doc").isNull(), F.lit(missing)).otherwise(F.lit("visible")).alias("visibility"), F.lit("HIGH").alias("severity"), F.col("term").alias("raw"),
    )
    order = Window.partitionBy(doc_id).orderBy("term_no", F.col("_part_no").asc_nulls_first(), "location")
    rows = rows.withColumn("n", F.row_number().over(order).cast("long")).withColumn("id", F.format_string("u_%02d", F.col("n")))
    first = F.min("n").over(Window.partitionBy(doc_id, "raw"))
    rank = F.dense_rank().over(Window.partitionBy(doc_id).orderBy("_first"))
    return rows.withColumn("_first", first).withColumn("value_preview", F.concat(F.lit("Your item "), rank.cast("string"))).withColumn("value_hash", S.sha256_hex("raw")).drop("_first", "_part_no", "term_no")


def corpus_terms(docs: DataFrame, terms: list[str], doc_id: str = "doc_id", text: str = "text", missing: str = "recoverable") -> DataFrame:
    """The same list of terms for every document, without a join: one row per term and document."""
    own = [t.strip() for t in terms if t and t.strip()]
    every = F.posexplode(F.array(*[F.lit(t) for t in own]).cast("array<string>")).alias("n", "raw")
    rows = docs.select(doc_id, F.coalesce(F.col(text), F.lit("")).alias("_text"), every)
    return rows.select(
        doc_id, F.format_string("u_%02d", F.col("n") + 1).alias("id"), F.lit("USER_SPECIFIED").alias("type"), F.lit("text").alias("location"),
        F.when(F.contains("_text", "raw"), F.lit("visible")).otherwise(F.lit(missing)).alias("visibility"), F.lit("HIGH").alias("severity"), "raw", S.sha256_hex("raw").alias("value_hash"),
    )


def merged(*findings: DataFrame) -> DataFrame:
    """Findings of all sources by name; columns that a source lacks are null."""
    out = findings[0]
    for f in findings[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
