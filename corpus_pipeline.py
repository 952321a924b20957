"""A corpus pipeline of five operators: language ID, quality, near duplicates, repeated passages, packing.

STAGES lists (name, function). A function takes (spark, docs, sf_dir), docs with the columns of `documents`, and works
on all that the stage before kept; all but the last give back those columns. run() applies them to `documents`, each
stage written to the shared folder and read again. Columns beyond those of `documents` are carried along.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docveil.llm.common import cut
from docveil.llm.language_id import language_id
from docveil.llm.ngram_join import ngram_join
from docveil.llm.packing import pack
from docveil.llm.quality import quality, trained
from docveil.llm.substring import without_repeats

#: Documents whose language is less sure than this are rejected; of four languages, the surest has at least 0.25.
LEAST_SCORE = 0.35
#: Documents less likely than this to have the highest grade are rejected.
LEAST_QUALITY = 0.5


def _apart(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The columns under names that nothing else has, so that none can clash, and those names by column."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def _back(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    return rows.select(*[F.col(new).alias(c) for c, new in names.items()])


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of unknown language (null, empty and letterless ones too) or of an unsure one. Repeated rows and
    rows with a null id are judged like any other; columns of any name are carried along."""
    rows, at = _apart(docs)
    out = language_id(rows, doc_id=at["doc_id"], text=at["text"], lang=at["lang"])
    return _back(out.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)), at)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality classifier rejects; it learns from labels of documents that are still there, and
    keeps all if these have fewer than two grades. Null and empty texts, null ids and repeated rows are judged like any other."""
    model = trained(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    if len(model.grades) < 2:
        return docs  # nothing was learned that could reject a document
    rows, at = _apart(docs)
    return _back(quality(rows, model, doc_id=at["doc_id"], text=at["text"]).filter(F.col("tail_prob") >= LEAST_QUALITY), at)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates: the one with the smallest id, of equal ids the one with the
    smallest hash of its text, one with a null id only where no other is there. Of rows with equal id and text, one stays.
    A document without words is a group by itself."""
    rows, at = _apart(docs)
    doc_id, text = F.col(at["doc_id"]), F.col(at["text"])
    # orders rows as their ids do and tells rows with different texts apart
    key = {"none": doc_id.isNull(), "id": F.coalesce(doc_id, F.lit(0)), "no_text": text.isNull(), "hash": F.xxhash64(text)}
    rows = rows.withColumns(key)
    joined = ngram_join(rows.select(F.struct(*key).alias("key"), at["text"]), doc_id="key", text=at["text"])
    kept = joined.filter(F.col("key") == F.col("component_id")).select("key.*").distinct()
    # flat keys: so the rows are shuffled once for both
    return _back(rows.join(kept, [*key], "left_semi").dropDuplicates([*key]), at)


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes words in repeated windows of 35 words out of the texts; a text with nothing to remove stays as it is, a null one
    becomes empty. Rows that repeat count as occurrences of each other."""
    out = without_repeats(docs, carry=True, as_it_was=True)
    new = {"doc_id": F.col("doc_id"), "text": F.col("kept"), "n_chars": F.char_length("kept").cast("long")}
    columns = [(new[c] if c in new else F.col(f"row.`{c}`")).alias(c) for c in docs.columns]
    return out.select(*columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 ids in sequences. A null or empty text is the end id alone; repeated rows are packed once each."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language ID", known_language),
    ("quality classifier", good_quality),
    ("n-gram Jaccard join", one_of_each_group),
    ("substring dedup", without_repeated_passages),
    ("packing", packed),
]
#: Learned models and a tokenizer decide on the rows: SQL can't express them. tests/llm holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
