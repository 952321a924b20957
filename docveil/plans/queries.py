"""Registered queries over the exposure operators, with DuckDB SQL for those that SQL can express (oracles.py)."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import scalar as S
from ..operators import compile_text, detect, geometry, ocr, policy, report, terms
from ..sources import docx, exif, files, haystack, pdf
from . import fixtures


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw web pages as texts."""
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").alias("doc_id"), F.col("html").alias("text"))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, the samples and the generated texts."""
    return documents(spark, sf_dir).unionByName(fixtures.samples(spark)).unionByName(fixtures.generated(spark, sf_dir))


def _analyzed(spark, sf_dir) -> DataFrame:
    """All detectors and names over all texts."""
    return detect.text_findings(texts(spark, sf_dir))


def _findings(spark, sf_dir) -> DataFrame:
    return detect.findings(_analyzed(spark, sf_dir))


def _long(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in columns})


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every finding of every document for public sharing: decided, compiled, verified, without its value."""
    done = compile_text.verified(compile_text.compiled(compile_text.decided(detect.text_findings(documents(spark, sf_dir)), "public_sharing")))
    return _long(report.public(detect.findings(done)), "n")


# ---- detectors on whole tables ----


def detect_query(detector: str, spark, sf_dir):
    return detect.detect(documents(spark, sf_dir).unionByName(fixtures.generated(spark, sf_dir)), detector)


def detect_pages(detector: str, spark, sf_dir):
    return detect.detect(pages(spark, sf_dir), detector)


def samples_query(detector: str, spark, sf_dir):
    return detect.detect(fixtures.samples(spark), detector)


def address_query(rule: int, spark, sf_dir):
    return detect.address_rule(texts(spark, sf_dir), rule)


def name_query(rule: str, spark, sf_dir):
    return detect.name_rule(texts(spark, sf_dir), rule)


def name_dedup(spark, sf_dir):
    return detect.detect(texts(spark, sf_dir), "person_name")


def text_findings(spark, sf_dir):
    return _long(_findings(spark, sf_dir), "n").select("doc_id", "n", "id", "type", "location", "visibility", "severity", "value_hash", "value_preview")


def all_findings(spark, sf_dir):
    return _long(detect.findings(detect.text_findings(documents(spark, sf_dir))), "n").select("doc_id", "n", "id", "type", "value_hash", "value_preview", "severity")


# ---- scalar functions ----


def mask(spark, sf_dir):
    return fixtures.values(spark).select("v", S.mask("v").alias("masked"))


def hash_(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", S.sha256_hex("text").alias("value_hash"))


def tokenize(spark, sf_dir):
    customers = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("doc_id"), "o_orderkey", F.when(F.col("o_orderstatus") == "F", "EMAIL").otherwise("PHONE").alias("type"), F.col("o_orderpriority").alias("raw"))
    return detect.tokens(customers, [F.col("o_orderkey")]).select("doc_id", "o_orderkey", "value_preview")


def renumber(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("doc_id"), "o_orderkey")
    return detect.renumber(rows, [F.col("o_orderkey")])


def type_info(spark, sf_dir):
    types = spark.createDataFrame([(t,) for t in [*fixed.TYPES, "NEW_KIND"]], "type string")
    return types.select("type", S.category_label("type").alias("category"), S.type_label("type").alias("label"), S.family("type").alias("family"), S.replacement("type", F.lit("abcd"), "token").alias("token"), S.replacement("type", F.lit("ab"), "blackbox").alias("blackbox"))


def needles(spark, sf_dir):
    return fixtures.values(spark).select("v", F.posexplode(S.needles("v")).alias("n", "needle")).select("v", F.col("n").cast("long").alias("n"), F.lower(F.hex("needle")).alias("needle"))


def checksums(spark, sf_dir):
    """Check digits of every order key, as twelve digits."""
    d = F.lpad(F.col("o_orderkey").cast("string"), 12, "3")
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.call_function("luhn_check", d).alias("luhn"), S.verhoeff(d).alias("verhoeff"))


# ---- policy ----


def policy_matrix(spark, sf_dir):
    return policy.policy_matrix(spark)


def decide(intent: str, spark, sf_dir):
    return _long(policy.decide(_findings(spark, sf_dir), intent), "n").select("doc_id", "id", "type", "decision")


def decide_all(spark, sf_dir):
    return policy.decide_all(_findings(spark, sf_dir)).groupBy("type", "intent", "decision").agg(F.count(F.lit(1)).alias("n_findings"))


def _overrides(rows: DataFrame) -> DataFrame:
    """Every third document's first finding is kept, every fifth's removed, every seventh's choice is no action."""
    choice = F.when(F.col("doc_id") % 3 == 0, "KEEP").when(F.col("doc_id") % 5 == 0, "REMOVE").when(F.col("doc_id") % 7 == 0, "SHRED")
    return rows.filter("id = 'f_01'").select("doc_id", "id", choice.alias("choice")).filter("choice is not null")


def overrides(intent: str, spark, sf_dir):
    rows = _findings(spark, sf_dir)
    return policy.apply_overrides(policy.decide(rows, intent), _overrides(rows), intent).select("doc_id", "id", "type", "decision")


def judge_payload(spark, sf_dir):
    return policy.judge_payload(policy.decide(_findings(spark, sf_dir), "internal_sharing"))


def judge_clamp(spark, sf_dir):
    rows = policy.decide(_findings(spark, sf_dir), "internal_sharing")
    no = F.explode(F.array(F.lit(1), F.lit(2)))
    advice = rows.select("doc_id", "id", no.alias("advice_no")).select("doc_id", "id", "advice_no", F.when(F.col("advice_no") == 1, "REMOVE").when(F.col("doc_id") % 2 == 0, "WARN").otherwise("KEEP").alias("recommend"), F.when(F.col("doc_id") % 3 == 0, " look again ").otherwise(" ").alias("note"))
    return policy.apply_advice(rows, advice).select("doc_id", "id", "type", "decision", "note")


# ---- terms, compile, verify ----

TERMS = [" the ", "der", "Ananya Sharma", "", "no such thing"]


def custom_terms(spark, sf_dir):
    rows = documents(spark, sf_dir)
    own = rows.select("doc_id", F.posexplode(F.array(*[F.lit(t) for t in TERMS])).alias("term_no", "term"))
    parts = rows.select("doc_id", F.lit("text").alias("part"), F.lit(0).alias("part_no"), "text")
    return terms.term_findings(own, parts).select("doc_id", "id", "location", "visibility", "value_hash", "value_preview")


def custom_terms_broadcast(spark, sf_dir):
    return terms.corpus_terms(documents(spark, sf_dir), TERMS).groupBy("value_hash", "visibility").agg(F.count(F.lit(1)).alias("n_documents"))


def compile_query(style: str, spark, sf_dir):
    done = compile_text.compiled(compile_text.decided(_analyzed(spark, sf_dir), "public_sharing"), style)
    return done.select("doc_id", S.sha256_hex("output").alias("output_sha256"))


def verify(spark, sf_dir):
    done = compile_text.verified(compile_text.compiled(compile_text.decided(_analyzed(spark, sf_dir), "public_sharing")))
    return detect.findings(done).select("doc_id", "id", "type", "decision", "removed", "evidence")


def verify_relation(spark, sf_dir):
    """The verifier on untouched texts: nothing was removed."""
    rows = policy.decide(_findings(spark, sf_dir), "public_sharing")
    hay = texts(spark, sf_dir).select("doc_id", F.encode("text", "UTF-8").alias("content"))
    return compile_text.verify_relation(rows, hay).select("doc_id", "id", "decision", "removed")


# ---- reports ----


def coverage(spark, sf_dir):
    return report.coverage(spark).select("kind", "category", "checked")


def unchecked(spark, sf_dir):
    return report.unchecked(report.coverage(spark))


def own_coverage(spark, sf_dir):
    return report.coverage(spark, own=True).select("kind", "category", "checked")


def report_by_type(spark, sf_dir):
    return report.counts(policy.decide(_findings(spark, sf_dir), "public_sharing"), "type", "severity", "decision")


def report_cube(spark, sf_dir):
    return report.cube(policy.decide(_findings(spark, sf_dir), "public_sharing")).withColumn("level", F.col("level").cast("long"))


def exif_diff(spark, sf_dir):
    return report.exif_diff(fixtures.exif_rows(spark))


def badges(spark, sf_dir):
    rows = spark.createDataFrame([("REMOVE", True, False), ("REMOVE", True, True), ("REMOVE", False, False), ("REMOVE", False, True), ("REMOVE", None, None), ("KEEP", None, None)], "decision string, removed boolean, ocr boolean")
    return rows.select("decision", "removed", "ocr", report.badge(F.col("removed"), F.col("decision"), F.col("ocr")).alias("badge"))


# ---- given relations ----


def covered_text(spark, sf_dir):
    rows = geometry.covered_text(fixtures.words(spark, sf_dir), fixtures.drawings(spark, sf_dir))
    return _long(rows, "doc_id", "page", "rect_no").select("doc_id", "page", "rect_no", "raw")


def locate(spark, sf_dir):
    values = fixtures.words(spark, sf_dir).filter("word_no = 0").select("doc_id", "page", F.lit("f_01").alias("id"), F.col("text").alias("raw"))
    return geometry.locate(values, fixtures.words(spark, sf_dir)).select("doc_id", "raw", F.size("rects").cast("long").alias("n_rects"))


def ocr_full_text(spark, sf_dir):
    return ocr.full_text(fixtures.ocr_words(spark, sf_dir))


def ocr_boxes(spark, sf_dir):
    rows = ocr.boxes_for(fixtures.ocr_values(spark, sf_dir), fixtures.ocr_words(spark, sf_dir))
    return rows.select("doc_id", "id", "raw", F.to_json("boxes").alias("boxes"))


def ocr_verify(spark, sf_dir):
    values = fixtures.ocr_values(spark, sf_dir).withColumns({"decision": F.lit("REMOVE"), "ocr": F.lit(True)})
    seen = ocr.full_text(fixtures.ocr_words(spark, sf_dir).filter("word_no % 3 = 0")).withColumnRenamed("text", "seen_text")
    return ocr.verify_visual(values, seen).select("doc_id", "id", "raw", "removed")


def plans(spark, sf_dir):
    rows = spark.createDataFrame([(1, "f_01", "COMMENT", "REMOVE", None, None, None), (1, "f_02", "JAVASCRIPT", "REMOVE", "javascript", None, None), (1, "f_03", "CARD", "REMOVE", None, 0, [[1.0, 2.0, 3.0, 4.0]]), (1, "f_04", "EMAIL", "KEEP", None, 0, [[1.0, 2.0, 3.0, 4.0]])], "doc_id long, id string, type string, decision string, scrub string, page int, rects array<array<double>>")
    return _long(geometry.pdf_plan(rows), "page").select("doc_id", "step", "page", "fill")


def _pdf(spark, sf_dir) -> DataFrame:
    return pdf.analyze(fixtures.pdf_relations(spark, sf_dir))


def pdf_findings(spark, sf_dir):
    return _pdf(spark, sf_dir).select("doc_id", "id", "type", "location", "visibility", "severity", "value_hash", "value_preview", F.col("page").cast("long").alias("page"), "scrub", F.coalesce(F.size("rects"), F.lit(0)).cast("long").alias("n_rects"))


def pdf_drawable(spark, sf_dir):
    rows = geometry.drawable(_pdf(spark, sf_dir).withColumn("ocr", F.lit(False)))
    return rows.groupBy("type", "drawable", "reason").agg(F.count(F.lit(1)).alias("n_findings"))


def pdf_overlay(spark, sf_dir):
    rows = geometry.previewed(geometry.overlay(_pdf(spark, sf_dir).filter("rects is not null")))
    return _long(rows, "page", "rect_no").select("doc_id", "id", "page", "rect_no", "x0", "y0", "x1", "y1")


def pdf_steps(spark, sf_dir):
    rows = geometry.pdf_plan(policy.decide(_pdf(spark, sf_dir), "public_sharing"))
    return rows.groupBy("step", "fill").agg(F.count(F.lit(1)).alias("n_steps"), F.countDistinct("doc_id").alias("n_documents"))


def image_findings(spark, sf_dir):
    return ocr.findings(fixtures.ocr_pages(spark, sf_dir)).select("doc_id", "n", "id", "type", "severity", "value_hash", "value_preview", F.size("boxes").cast("long").alias("n_boxes"))


def image_plan(spark, sf_dir):
    rows = geometry.image_plan(policy.decide(ocr.findings(fixtures.ocr_pages(spark, sf_dir)), "public_sharing"))
    return rows.select("doc_id", "strip_metadata", F.size("paint").cast("long").alias("n_boxes"))


def override_all(spark, sf_dir):
    rows = policy.decide(_findings(spark, sf_dir), "public_sharing")
    made = [policy.override_all(rows, c, i).select(F.lit(c).alias("choice"), F.lit(i).alias("intent"), "decision") for c, i in (("REMOVE", "public_sharing"), ("REMOVE", "legal_hold"), ("KEEP", "public_sharing"), ("SHRED", "public_sharing"))]
    return terms.merged(*made).groupBy("choice", "intent", "decision").agg(F.count(F.lit(1)).alias("n_findings"))


# ---- containers ----


def word_files(spark, sf_dir) -> DataFrame:
    """A container for each document, its text as the body."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for some in haystack.slices(batch, "text"):
                out = [fixtures.docx_bytes(t or "") for t in some.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(out, pa.binary())], ["doc_id", "content"])

    return documents(spark, sf_dir).mapInArrow(run, "doc_id bigint, content binary")


def docx_findings(spark, sf_dir):
    return docx.analyze(word_files(spark, sf_dir)).select("doc_id", "id", "type", "location", "value_hash", "value_preview")


def docx_compile(spark, sf_dir):
    done = docx.compiled(compile_text.decided(docx.analysed(word_files(spark, sf_dir)), "public_sharing"), seen=haystack.haystack)
    return detect.findings(compile_text.verified_bytes(done)).select("doc_id", "id", "type", "decision", "removed")


def docx_parts(spark, sf_dir):
    return docx.parts(word_files(spark, sf_dir)).groupBy("part_name").agg(F.count(F.lit(1)).alias("n_documents"), F.sum(F.length("content")).alias("n_bytes"))


def exif_findings(spark, sf_dir):
    return exif.analyze(fixtures.photos(spark)).select("doc_id", "id", "type", "location", "value_preview", "value_hash")


def exif_compile(spark, sf_dir):
    own = fixtures.photos(spark)
    rows = policy.decide(exif.analyze(own), "public_sharing")
    return compile_text.verify_relation(rows, haystack.haystacks(exif.compile_files(own, rows))).select("doc_id", "id", "type", "decision", "removed")


def routing(spark, sf_dir):
    names = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").alias("doc_id"), F.concat(F.lit("/in/a"), F.col("page_id").cast("string"), F.element_at(F.array(*[F.lit(x) for x in (".docx", ".PDF", ".jpg", ".jpeg", ".png", ".txt", "")]), (F.col("page_id") % 7 + 1).cast("int"))).alias("path"))
    return files.with_kind(names).select("doc_id", "ext", "kind", files.media_type(F.col("ext")).alias("media_type"), files.output_name("path").alias("output_name"))


QUERIES = {
    "flagship": flagship,
    **{f"detect_{d}": partial(detect_query, d) for d in detect.DETECTORS},
    "detect_email_pages": partial(detect_pages, "email"),
    "detect_card_pages": partial(detect_pages, "card"),
    **{f"samples_{d}": partial(samples_query, d) for d in detect.DETECTORS},
    **{f"detect_address_{n}": partial(address_query, k) for k, n in enumerate(("prefix", "street", "zip", "pin"))},
    **{f"name_{r}": partial(name_query, r) for r in ("prefix", "honorific", "toplines")},
    "name_dedup": name_dedup,
    "text_findings": text_findings,
    **{f"decide_{i}": partial(decide, i) for i in fixed.INTENTS},
    "decide_all": decide_all,
    "overrides": partial(overrides, "public_sharing"),
    "overrides_legal_hold": partial(overrides, "legal_hold"),
    "judge_payload": judge_payload,
    "judge_clamp": judge_clamp,
    "compile_token": partial(compile_query, "token"),
    "compile_blackbox": partial(compile_query, "blackbox"),
    "verify": verify,
    "verify_relation": verify_relation,
    "report_by_type": report_by_type,
    "report_cube": report_cube,
    "all_findings": all_findings,
    "mask": mask,
    "hash": hash_,
    "tokenize": tokenize,
    "renumber": renumber,
    "type_info": type_info,
    "needles": needles,
    "checksums": checksums,
    "policy_matrix": policy_matrix,
    "custom_terms": custom_terms,
    "custom_terms_corpus": custom_terms_broadcast,
    "coverage": coverage,
    "unchecked": unchecked,
    "own_coverage": own_coverage,
    "exif_diff": exif_diff,
    "badges": badges,
    "covered_text": covered_text,
    "locate": locate,
    "ocr_full_text": ocr_full_text,
    "ocr_boxes": ocr_boxes,
    "ocr_verify": ocr_verify,
    "pdf_plan": plans,
    "pdf_findings": pdf_findings,
    "pdf_drawable": pdf_drawable,
    "pdf_overlay": pdf_overlay,
    "pdf_steps": pdf_steps,
    "image_findings": image_findings,
    "image_plan": image_plan,
    "override_all": override_all,
    "docx_findings": docx_findings,
    "docx_compile": docx_compile,
    "docx_parts": docx_parts,
    "exif_findings": exif_findings,
    "exif_compile": exif_compile,
    "file_routing": routing,
}

from .oracles import ORACLES  # noqa: E402, F401
