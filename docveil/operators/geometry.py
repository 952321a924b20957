"""Rectangles: text under dark boxes, places of values on a page, overlays for review, and what to paint or redact.

Relations are given: words(doc_id, page, word_no, text, x0, y0, x1, y1), drawings(doc_id, page, rect_no, x0..y1, r, g, b).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import scalar as S

BOX = ("x0", "y0", "x1", "y1")


def dark_rectangles(drawings: DataFrame) -> DataFrame:
    filled = F.col("r").isNotNull() & F.col("g").isNotNull() & F.col("b").isNotNull()
    return drawings.filter(filled & (S.luminance("r", "g", "b") <= fixed.DARK) & (S.area(*BOX) > fixed.LEAST_AREA))


def covered_text(words: DataFrame, drawings: DataFrame) -> DataFrame:
    """A row per dark rectangle with words of which at least 60 % lie under it. An equi-join on the page, then the overlap."""
    dark = dark_rectangles(drawings).select("doc_id", "page", "rect_no", *[F.col(c).alias(f"d_{c}") for c in BOX])
    under = words.join(dark, ["doc_id", "page"]).filter(S.overlap_share(BOX, tuple(f"d_{c}" for c in BOX)) >= fixed.COVERED)
    held = under.groupBy("doc_id", "page", "rect_no", *[f"d_{c}" for c in BOX]).agg(F.array_sort(F.collect_list(F.struct("word_no", "text"))).alias("w"))
    raw = S.strip(F.array_join(F.transform("w", lambda w: w["text"]), " "))
    rows = held.select("doc_id", "page", "rect_no", F.array(*[f"d_{c}" for c in BOX]).alias("rect"), raw.alias("raw")).filter("raw <> ''")
    return rows.withColumns({"type": F.lit("COVERED_TEXT"), "location": F.concat(F.lit("pdf:page"), (F.col("page") + 1).cast("string"), F.lit("/covered")), "visibility": F.lit("recoverable"), "severity": F.lit("CRITICAL")})


def locate(values: DataFrame, words: DataFrame) -> DataFrame:
    """rects of each value (doc_id, page, id, raw): words equal to it, or of four characters or more that hold it or lie in it."""
    w, v = F.col("text"), F.col("raw")
    hit = (w != "") & ((w == v) | ((F.char_length(w) >= 4) & (F.contains(v, w) | F.contains(w, v))))
    own = values.join(words.select("doc_id", "page", "word_no", "text", *BOX), ["doc_id", "page"], "left")
    found = F.array_sort(F.collect_list(F.when(hit, F.struct("word_no", F.array(*BOX).alias("rect")))))
    return own.groupBy("doc_id", "page", "id", "raw").agg(found.alias("w")).withColumn("rects", F.transform("w", lambda x: x["rect"])).drop("w")


def overlay(rows: DataFrame) -> DataFrame:
    """A row per rectangle of findings with rects, for drawing."""
    return rows.select("doc_id", "id", "page", F.posexplode("rects").alias("rect_no", "rect")).select("doc_id", "id", "page", "rect_no", *[F.col("rect")[i].alias(c) for i, c in enumerate(BOX)])


def drawable(rows: DataFrame) -> DataFrame:
    """Whether a finding (page, ocr, rects) can be shown on the page and, if not, why."""
    has = F.coalesce(F.size("rects"), F.lit(0)) > 0
    on_page = F.col("page").isNotNull() | F.coalesce("ocr", F.lit(False))
    reason = F.when(has, F.lit(None).cast("string")).when(on_page, F.lit(fixed.REASONS["page"])).otherwise(F.lit(fixed.REASONS["file"]))
    return rows.withColumn("drawable", has).withColumn("reason", reason)


def previewed(rows: DataFrame) -> DataFrame:
    """Rows of the pages that a preview shows."""
    return rows.filter(F.col("page") < fixed.PREVIEW_PAGES)


def pdf_plan(decided: DataFrame, style: str = "token") -> DataFrame:
    """What a PDF writer has to do, step by step: metadata, comments, scrubs, then a row for each rectangle to redact."""
    due = decided.filter("decision = 'REMOVE'")
    flags = due.groupBy("doc_id").agg(F.bool_or(F.col("type").isin("REVISION_AUTHOR", "SOFTWARE_FINGERPRINT")).alias("metadata"), F.bool_or(F.col("type") == "COMMENT").alias("comments"), F.array_sort(F.collect_set("scrub")).alias("scrubs"))
    steps = flags.select("doc_id", F.explode(F.concat(F.when(F.col("metadata"), F.array(F.lit("1 clear metadata"))).otherwise(F.array().cast("array<string>")), F.transform("scrubs", lambda s: F.concat(F.lit("2 scrub "), s)), F.when(F.col("comments"), F.array(F.lit("3 delete comments"))).otherwise(F.array().cast("array<string>")))).alias("step"))
    fill = F.lit("black") if style == "blackbox" else F.concat(F.lit("["), S.category_label("type"), F.lit("]"))
    boxes = due.select("doc_id", "page", F.explode("rects").alias("rect"), fill.alias("fill"))
    return steps.select("doc_id", "step", F.lit(None).cast("int").alias("page"), F.lit(None).cast("array<double>").alias("rect"), F.lit(None).cast("string").alias("fill")).unionByName(boxes.select("doc_id", F.lit("4 redact").alias("step"), "page", "rect", "fill"))


def image_plan(decided: DataFrame) -> DataFrame:
    """Per image: whether its metadata go, and the boxes to paint, a little larger than the words."""
    due = decided.filter("decision = 'REMOVE'")
    strip = F.bool_or(F.col("type").isin("GPS_COORDINATES", "SOFTWARE_FINGERPRINT", "EXIF_THUMBNAIL", "USER_SPECIFIED"))
    pad = fixed.PAINT_PAD
    boxes = F.flatten(F.collect_list(F.when(F.col("ocr"), F.col("boxes"))))
    paint = F.transform(boxes, lambda b: F.array(b[0] - pad, b[1] - pad, b[0] + b[2] + pad, b[1] + b[3] + pad))
    return due.groupBy("doc_id").agg(F.coalesce(strip, F.lit(False)).alias("strip_metadata"), paint.alias("paint"))
