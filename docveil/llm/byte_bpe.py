"""Byte-level BPE encoding and decoding from a rank file, by the tokenizers library over Arrow batches.

The library works on characters, so each byte stands for one printable character (byte_chars). The merges that it
wants follow from the ranks: any two tokens whose bytes join to a ranked token merge at that rank. Decoding reverses
the byte table on the bytes of the whole text, so characters split over several ids come back whole.

Null and empty texts have no ids. Repeated rows give a row each; columns other than the id and the text are not read.
"""

from __future__ import annotations

import base64
import hashlib
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_bytes, spread, table
from .pieces import Ids, spaced_pieces, sums


def byte_chars() -> list[str]:
    """A printable character for each byte: itself where it is one in Latin-1, else one from code point 256 on."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    rest = [b for b in range(256) if b not in set(own)]
    return [chr(b) if b in set(own) else chr(256 + rest.index(b)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Codec:
    """Encodes and decodes by ranks; pattern: the regular expression whose matches are encoded separately."""

    def __init__(self, path: str, pattern: str):
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        ranks = read_ranks(path)
        chars = byte_chars()
        name = {t: "".join(chars[b] for b in t) for t in ranks}
        merges = [(name[t[:i]], name[t[i:]]) for t in sorted(ranks, key=ranks.get) for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        self.model = Tokenizer(models.BPE(vocab={name[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True))
        self.model.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        back = {c: b for b, c in enumerate(chars)}
        by_id = sorted(ranks.items(), key=lambda x: x[1])
        self.lens = np.zeros(by_id[-1][1] + 1, dtype=np.int64)
        for t, r in by_id:
            self.lens[r] = len(t)
        self.starts = np.cumsum(self.lens) - self.lens
        self.pool = np.frombuffer(bytes(back[c] for t, _ in by_id for c in name[t]), dtype=np.uint8)

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """(id, first character, end character) of each token; several tokens of one split character share its span."""
        e = self.model.encode(text, add_special_tokens=False)
        return [(i, a, b) for i, (a, b) in zip(e.ids, e.offsets, strict=True)]

    def decode(self, ids: np.ndarray) -> bytes:
        return self.pool[spread(self.starts[ids], self.lens[ids])].tobytes()


@lru_cache(2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def encoded(docs: DataFrame, path: str, pattern: str, finish, schema: str, doc_id: str = "doc_id", text: str = "text", slice_bytes: int = 4 << 20) -> DataFrame:
    """finish(codec, ids of all texts, how many each text has) gives the columns that follow the id."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches):
        c = codec(path, pattern)
        memo = Ids(lambda pieces: c.encode_batch([f" {p}" for p in pieces]))
        for big in batches:
            for batch in by_bytes(big, "text", slice_bytes):
                pieces, lens, at_head, heads = [], [], [], []
                for t in batch.column("text").to_pylist():
                    own = spaced_pieces(t or "")
                    heads.append(own[0])
                    pieces += own[1:]
                    lens.append(len(own) - 1)
                head_ids, head_lens = Ids(c.encode_batch).ids(heads)
                ids, piece_lens = memo.ids(pieces)
                tails = sums(piece_lens, np.array(lens, dtype=np.int64))
                # the ids of a text: its head's, then its other pieces'
                both = np.concatenate([head_ids, ids])
                ends_h, ends_t = np.cumsum(head_lens), np.cumsum(tails) + len(head_ids)
                starts = np.stack([ends_h - head_lens, ends_t - tails], axis=1).ravel()
                spans = np.stack([head_lens, tails], axis=1).ravel()
                yield pa.RecordBatch.from_arrays([batch.column("id"), *finish(c, both[spread(starts, spans)], head_lens + tails)], ["id", *columns])

    columns = [x.split()[0] for x in schema.split(",")]
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, {schema}").withColumnRenamed("id", doc_id)


def _parts(values: np.ndarray, lens: np.ndarray):
    ends = np.cumsum(lens)
    return (values[a:b] for a, b in zip((ends - lens).tolist(), ends.tolist(), strict=True))


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and ids (array of int) of every row."""

    def finish(c, ids, lens):
        return [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lens)]), pa.int32()), pa.array(ids.astype(np.int32)))]

    return encoded(docs, path, pattern, finish, "ids array<int>")


def decode_documents(rows: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """doc_id and content (bytes; invalid UTF-8 stays as it is) of rows with arrays of ids; null has no bytes."""
    kind = rows.schema[doc_id].dataType.simpleString()

    def run(batches):
        c = codec(path, pattern)
        for batch in batches:
            out = [c.decode(np.array(x or [], dtype=np.int64)) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, pa.binary())], ["id", "content"])

    return rows.select(F.col(doc_id).alias("id"), F.col(ids).alias("ids")).mapInArrow(run, f"id {kind}, content binary").withColumnRenamed("id", doc_id)


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    def finish(c, ids, lens):
        each = list(_parts(ids, lens))
        sha = [hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in each]
        back = [hashlib.sha256(c.decode(x)).hexdigest() for x in each]
        return [pa.array(lens, pa.int64()), pa.array(sha), pa.array(back)]

    return encoded(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, finish, "n_tokens bigint, ids_sha256 string, decoded_sha256 string")
