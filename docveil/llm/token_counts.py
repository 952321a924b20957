"""Token counts: batch encoding in Arrow functions that return lengths only.

Long texts are split at safe boundaries (pieces.py), batches are balanced by bytes, nothing but lengths leaves the
Arrow function. One pass over the rows without any shuffle; a worker holds one slice of texts (by_bytes) and the
bounded memory of pieces.

Null and empty texts count as 0 bytes and 0 tokens. Repeated rows and ids give a row each. Columns other than the id
and the text are not read; an empty table gives no row.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_bytes, table
from .pieces import Ids, spaced_pieces, sums


def _lengths(path: str):
    """A function from a list of pieces to objects that have a length."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: model.encode(texts, num_threads=1)
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()
    return lambda texts: model.encode_batch_fast(texts, add_special_tokens=False)


def token_counts(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", slice_bytes: int = 8 << 20) -> DataFrame:
    """doc_id, n_bytes (UTF-8) and n_tokens of every row.

    path: a byte-level BPE file of the tokenizers library (.json) or a sentencepiece model (.model); of the latter,
    texts are given whole, since its pieces may cross any boundary.
    """
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches):
        encode = _lengths(path)
        whole = path.endswith(".model")
        memo = Ids(lambda pieces: encode([f" {p}" for p in pieces]), keep_ids=False)
        for big in batches:
            for batch in by_bytes(big, "text", slice_bytes):
                texts = [x or "" for x in batch.column("text").to_pylist()]
                n_bytes = pa.compute.fill_null(pa.compute.binary_length(batch.column("text")), 0)
                firsts, rest, lens = [], [], []
                for t in texts:
                    pieces = [t] if whole else spaced_pieces(t)
                    firsts.append(pieces[0])
                    lens.append(len(pieces) - 1)
                    rest += pieces[1:]
                head = Ids(encode, keep_ids=False).counts(firsts)
                n = head + sums(memo.counts(rest), np.array(lens, dtype=np.int64))
                yield pa.RecordBatch.from_arrays([batch.column("id"), n_bytes.cast(pa.int64()), pa.array(n, pa.int64())], ["id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, n_bytes bigint, n_tokens bigint").withColumnRenamed("id", doc_id)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return out.withColumn("over_limit", F.col("n_tokens") > 1024)
