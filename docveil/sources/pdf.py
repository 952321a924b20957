"""PDF files as given relations: what a PDF reader found in them becomes findings, in the order in which a file is read.

relations (each may be left out):
  metadata(doc_id, key, value)               key: author, creator, producer or xmp
  attachments(doc_id, n, name)               scripts(doc_id, code)
  annotations(doc_id, page, n, author, content)
  page_texts(doc_id, page, text)             words and drawings as in operators.geometry
  images(doc_id, page, n, width, height, content, rects)
  fields(doc_id, page, n, name, value)

Pages are numbered from 0. Blank values give no finding. Values on a page are placed by its words (locate).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import geometry
from ..operators.detect import exploded, text_findings, tokens


def _on_page(suffix: str) -> Column:
    return F.concat(F.lit("pdf:page"), (F.col("page") + 1).cast("string"), F.lit(suffix))


def _rows(df: DataFrame, rank: int, part: int, type_, location, visibility: str, severity, raw, n=None, scrub=None, preview=None) -> DataFrame:
    page, rects = (F.col(c) if c in df.columns else F.lit(None) for c in ("page", "rects"))
    own = [page.cast("int").alias("page"), F.lit(part).alias("part"), (F.lit(0) if n is None else n).cast("long").alias("n"), type_, location.alias("location"), F.lit(visibility).alias("visibility"), severity, raw.alias("raw")]
    more = [(F.lit(None) if preview is None else preview).cast("string").alias("preview"), F.lit(scrub).cast("string").alias("scrub"), rects.cast("array<array<double>>").alias("rects")]
    return df.select("doc_id", F.lit(rank).alias("rank"), *own, *more).filter(S.strip("raw") != "")


def _kind(name: str) -> Column:
    return F.lit(name).alias("type")


def _level(name: str) -> Column:
    return F.lit(name).alias("severity")


def body(page_texts: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """doc_id, page, n, type, severity, raw and rects of everything that the text detectors find on each page."""
    found = exploded(text_findings(page_texts.select(F.struct("doc_id", "page").alias("at"), "text")).select("at", "findings"), "at", "findings")
    rows = found.select("at.doc_id", "at.page", F.col("n").cast("long").alias("n"), "f.type", "f.severity", "f.raw")
    if words is None:
        return rows.withColumn("rects", F.array().cast("array<array<double>>"))
    at = geometry.locate(rows.select("doc_id", "page", F.col("n").cast("string").alias("id"), "raw"), words)
    return rows.join(at.select("doc_id", "page", F.col("id").cast("long").alias("n"), "rects"), ["doc_id", "page", "n"])


def analyze(relations: dict[str, DataFrame]) -> DataFrame:
    """Findings of every file: doc_id, id, type, location, visibility, severity, value_hash, value_preview, raw, page, scrub, rects."""
    made, has = [], relations.get
    if has("metadata") is not None:
        rows = has("metadata").withColumn("k", F.array_position(F.array(*[F.lit(x) for x in ("author", "creator", "producer", "xmp")]), F.col("key"))).filter("k > 0")
        first = F.col("k") == 1
        place = F.when(F.col("key") == "xmp", F.lit("pdf:XMP")).otherwise(F.concat(F.lit("pdf:DocInfo/"), F.initcap("key")))
        made.append(_rows(rows, 0, 0, F.when(first, F.lit("REVISION_AUTHOR")).otherwise(F.lit("SOFTWARE_FINGERPRINT")).alias("type"), place, "hidden", F.when(first, F.lit("MEDIUM")).otherwise(F.lit("LOW")).alias("severity"), S.strip("value"), F.col("k")))
    if has("attachments") is not None:
        made.append(_rows(has("attachments"), 1, 0, _kind("EMBEDDED_OBJECT"), F.concat(F.lit("pdf:embfile/"), "name"), "recoverable", _level("HIGH"), F.col("name"), F.col("n"), "attached_files"))
    if has("scripts") is not None:
        made.append(_rows(has("scripts"), 2, 0, _kind("JAVASCRIPT"), F.lit("pdf:catalog/Names/JavaScript"), "hidden", _level("HIGH"), F.col("code"), scrub="javascript"))
    if has("annotations") is not None:
        author = S.strip(F.coalesce("author", F.lit("")))
        raw = F.concat(F.when(author != "", F.concat(author, F.lit(": "))).otherwise(F.lit("")), S.strip(F.coalesce("content", F.lit(""))))
        made.append(_rows(has("annotations"), 3, 0, _kind("COMMENT"), _on_page("/annot"), "hidden", _level("MEDIUM"), raw, F.col("n")))
    if has("words") is not None and has("drawings") is not None:
        rows = geometry.covered_text(has("words"), has("drawings")).withColumn("rects", F.array("rect"))
        made.append(_rows(rows, 3, 1, F.col("type"), F.col("location"), "recoverable", F.col("severity"), F.col("raw"), F.col("rect_no")))
    if has("page_texts") is not None:
        made.append(_rows(body(has("page_texts"), has("words")), 3, 2, F.col("type"), _on_page(""), "visible", F.col("severity"), F.col("raw"), F.col("n")))
    if has("images") is not None:
        # the bytes as one character each, or the picture's number
        content = F.when(F.length("content") > 0, F.decode("content", "ISO-8859-1"))
        shown = F.concat(F.lit("<image "), F.col("width").cast("string"), F.lit("x"), F.col("height").cast("string"), F.lit("px>"))
        made.append(_rows(has("images"), 3, 3, _kind("EMBEDDED_IMAGE"), _on_page("/image"), "visible", _level("LOW"), F.coalesce(content, F.concat(F.lit("pdf-image-"), F.col("n").cast("string"))), F.col("n"), preview=shown))
    if has("fields") is not None:
        name = F.when(F.coalesce("name", F.lit("")) != "", F.col("name")).otherwise(F.lit("?"))
        place = F.concat(_on_page("/field:"), name)
        made.append(_rows(has("fields"), 3, 4, _kind("FORM_FIELD"), place, "visible", _level("MEDIUM"), S.strip(F.coalesce("value", F.lit(""))), F.col("n"), "reset_fields"))
    if not made:
        raise ValueError("no relation is given")
    rows = made[0]
    for x in made[1:]:
        rows = rows.unionByName(x)
    order = [F.col("rank"), F.col("page").asc_nulls_first(), F.col("part"), F.col("n")]
    rows = rows.withColumn("id", F.format_string("f_%02d", F.row_number().over(Window.partitionBy("doc_id").orderBy(*order)))).withColumn("value_hash", S.sha256_hex("raw"))
    shown = tokens(rows, order).withColumn("value_preview", F.coalesce("preview", "value_preview"))
    return shown.select("doc_id", "id", "type", "location", "visibility", "severity", "value_hash", "value_preview", "raw", "page", "scrub", "rects")
