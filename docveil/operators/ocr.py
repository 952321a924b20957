"""Recognised words of an image, given as ocr_words(doc_id, word_no, text, conf, x, y, w, h, block, line)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import scalar as S
from .detect import exploded, text_findings


def sure_words(words: DataFrame) -> DataFrame:
    return words.filter((F.col("conf") >= fixed.LEAST_CONFIDENCE) & (S.strip("text") != ""))


def full_text(words: DataFrame) -> DataFrame:
    """doc_id, text: words joined by spaces, with a line break where block or line changes."""
    order = Window.partitionBy("doc_id").orderBy("word_no")
    place = F.struct("block", "line")
    gap = F.when(F.lag("word_no").over(order).isNull(), F.lit("")).when(F.lag(place).over(order) != place, F.lit("\n")).otherwise(F.lit(" "))
    rows = sure_words(words).withColumn("_gap", gap)
    held = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("word_no", F.concat("_gap", S.strip("text")).alias("t")))).alias("w"))
    return held.select("doc_id", F.array_join(F.transform("w", lambda w: w["t"]), "").alias("text"))


def boxes_for(values: DataFrame, words: DataFrame) -> DataFrame:
    """boxes of each value (doc_id, id, raw): the first run of up to 30 words that spells it, else the first word that holds it.

    Letters and digits only, without case. A run starts at each word; windows of 30 words see no more of a document.
    """
    after = Window.partitionBy("doc_id").orderBy("word_no").rowsBetween(0, fixed.OCR_WINDOW - 1)
    rows = sure_words(words).withColumn("_n", S.norm("text")).withColumn("_run", F.collect_list(F.struct(F.col("_n").alias("n"), F.array("x", "y", "w", "h").alias("box"))).over(after))
    own = values.withColumn("_target", S.norm(F.coalesce("raw", F.lit("")))).join(rows.select("doc_id", "word_no", "_n", "_run"), "doc_id", "left")
    spelled = F.transform(F.sequence(F.lit(1), F.size("_run")), lambda k: F.array_join(F.transform(F.slice("_run", F.lit(1), k), lambda r: r["n"]), ""))
    length = F.when(F.size("_run") > 0, F.array_position(spelled, F.col("_target")))
    own = own.withColumn("_k", F.when(F.col("_target") != "", length))
    run = F.min(F.when(F.col("_k") > 0, F.struct("word_no", F.transform(F.slice("_run", F.lit(1), F.greatest(F.col("_k").cast("int"), F.lit(0))), lambda r: r["box"]).alias("boxes"))))
    single = F.min(F.when((F.col("_target") != "") & F.contains("_n", "_target"), F.struct("word_no", F.array(F.col("_run")[0]["box"]).alias("boxes"))))
    found = own.groupBy("doc_id", "id", "raw").agg(run.alias("_a"), single.alias("_b"))
    return found.select("doc_id", "id", "raw", F.coalesce("_a.boxes", "_b.boxes", F.array().cast("array<array<int>>")).alias("boxes"))


def findings(words: DataFrame) -> DataFrame:
    """Everything that the text detectors find in recognised words, with its boxes: doc_id, n, type, severity, raw, ocr, boxes."""
    found = exploded(text_findings(full_text(words)).select("doc_id", "findings"), "doc_id", "findings")
    rows = found.select("doc_id", F.col("n").cast("long").alias("n"), "f.id", "f.type", "f.severity", "f.value_hash", "f.value_preview", "f.raw")
    at = boxes_for(rows.select("doc_id", "id", "raw"), words).select("doc_id", "id", "boxes")
    return rows.join(at, ["doc_id", "id"]).withColumn("ocr", F.lit(True))


def verify_visual(decided: DataFrame, seen: DataFrame) -> DataFrame:
    """removed of findings from recognised text, by the text recognised in the output (doc_id, seen_text)."""
    own = decided.join(seen.select("doc_id", S.norm("seen_text").alias("_seen")), "doc_id", "left")
    value = S.norm(F.coalesce("raw", F.lit("")))
    due = (F.col("decision") == "REMOVE") & F.col("ocr") & F.col("_seen").isNotNull()
    return own.withColumn("removed", F.when(due, (value != "") & ~F.contains("_seen", value)).otherwise(F.col("removed") if "removed" in decided.columns else F.lit(None).cast("boolean"))).drop("_seen")
