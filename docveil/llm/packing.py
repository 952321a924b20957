"""Sum-of-squares online packing of tokenized documents into windows.

Each task packs the documents of its partition as they come. A document's full windows stand alone; what is left of
it goes into the fill level h for which the sum over levels of (open windows at that level) squared is least
afterwards; the counts are kept in a level array. Windows stay open until they are full. At the end of a partition,
and when more than `most_open` windows are open, the open windows are closed with cuts: their content is laid end to
end into full windows, and the last remainder into windows of a power of two, which need no padding.

No shuffle: sequence ids are the partition's number and a counter. A retried task reads the same rows in the same
order and so gives the same ids. Null and empty texts are documents of the end id alone. Repeated rows are packed
once each. Columns other than the id and the text are not read; an empty table gives no row.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_bytes, raw_column, table
from .pieces import Ids, kept, sums


class Packer:
    """pieces: (document, start, ids, document's number of ids). Closed windows are given to `out` as lists of pieces."""

    def __init__(self, out, window: int = 2048, most_open: int = 4096):
        self.out, self.window, self.most_open = out, window, most_open
        self.count = np.zeros(window + 1, dtype=np.int64)
        self.open: dict[int, list] = defaultdict(list)
        self.n_open = 0

    def level(self, size: int) -> int:
        """Where a piece of this size makes the sum of squares least; 0: a new window."""
        w, n = self.window, self.count
        best, at = n[size] + 0.5, 0  # halves of the change of the sum
        if w - size > 0 and n[w - size] and -n[w - size] + 0.5 <= best:
            best, at = -n[w - size] + 0.5, w - size  # a full window counts no more
        levels = np.flatnonzero(n[1 : w - size]) + 1
        if len(levels):
            change = n[levels + size] - n[levels] + 1.0
            k = int(change[::-1].argmin())  # of equals, the fullest window
            k = len(levels) - 1 - k
            if change[k] < best:
                at = int(levels[k])
        return at

    def add(self, doc, ids: np.ndarray) -> None:
        w, total = self.window, len(ids)
        whole = total // w * w
        for a in range(0, whole, w):
            self.out([(doc, a, ids[a : a + w], total)])
        if whole == total:
            return
        piece = (doc, whole, ids[whole:], total)
        size = total - whole
        at = self.level(size)
        if at:
            held = self.open[at].pop()
            self.count[at] -= 1
            self.n_open -= 1
        else:
            held = []
        held.append(piece)
        if at + size == w:
            self.out(held)
            return
        self.open[at + size].append(held)
        self.count[at + size] += 1
        self.n_open += 1
        if self.n_open > self.most_open:
            self.close()

    def close(self) -> None:
        """Closes all open windows: fullest first, each filled up with cuts of the emptiest ones."""
        held = [p for h in sorted(self.open, reverse=True) for x in self.open[h] for p in x]
        self.open.clear()
        self.count[:] = 0
        self.n_open = 0
        left = sum(len(p[2]) for p in held)
        want = min(self.window, 1 << (left.bit_length() - 1)) if left else 0
        now, room = [], want
        for doc, start, ids, total in held:
            while len(ids):
                part = ids[:room]
                now.append((doc, start, part, total))
                start, ids, room, left = start + len(part), ids[len(part) :], room - len(part), left - len(part)
                if not room:
                    self.out(now)
                    now, room = [], min(self.window, 1 << (left.bit_length() - 1)) if left else 0


_STOP = re.compile(rb"(?<=[a-z0-9])([.,])(?=[ \n])")
#: a capital before other than ASCII: a mark there may compose with the capital or only with its small letter
_MARKED = re.compile(rb"[A-Z][\x80-\xff]")
_UNMARKED = re.compile(rb"[A-Z]+(?![\x80-\xff])")


def white_pieces(text: bytes) -> list[bytes]:
    """The text cut at white space, and before a lone stop or comma after a word, where the file's pattern cuts as well.

    A-Z become a-z, as in the file's normaliser, unless a special string, which that doesn't touch, may be there, or
    a mark may follow, which the normaliser composes first.
    """
    if b"<|" in text:
        return text.split()
    low = text.lower() if text.isascii() or not _MARKED.search(text) else _UNMARKED.sub(lambda m: m[0].lower(), text)
    return _STOP.sub(rb" \1", low).split()


def word_ids(path: str):
    """Ids of byte strings by a tokenizers file that lower-cases, drops white space and never joins over it."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()
    return lambda pieces: [e.ids for e in model.encode_batch_fast([p.decode("utf-8", "replace") for p in pieces], add_special_tokens=False)]


def pack(docs: DataFrame, path: str, end_id: int = 1, window: int = 2048, most_open: int = 4096, with_ids: bool = False, doc_id: str = "doc_id", text: str = "text", slice_bytes: int = 1 << 20) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids if asked for."""
    kind = docs.schema[doc_id].dataType.simpleString()
    columns = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids

    def run(batches):
        memo = kept(f"word ids {path}", lambda: Ids(word_ids(path), most=900_000))
        rows: list[tuple] = []
        sequence = [TaskContext.get().partitionId() << 40]

        def closed(pieces):
            at = 0
            for doc, start, ids, total in pieces:
                row = (doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, sequence[0], at)
                rows.append((*row, ids.tolist()) if with_ids else row)
                at += len(ids)
            sequence[0] += 1

        def ready(id_type):
            types = [id_type, *[pa.int64()] * 6, *[pa.list_(pa.int32())] * with_ids]
            out = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], columns)
            rows.clear()
            return out

        packer, id_type = Packer(closed, window, most_open), None
        for big in batches:
            for batch in by_bytes(big, "text", slice_bytes):
                id_type = batch.column("id").type
                words = [white_pieces(t) for t in raw_column(batch, "text")]
                n = np.array([len(x) for x in words], dtype=np.int64)
                ids, lens = memo.ids([w for x in words for w in x])
                ends = np.cumsum(sums(lens, n))
                a = 0
                for doc, b in zip(batch.column("id").to_pylist(), ends.tolist(), strict=True):
                    packer.add(doc, np.append(ids[a:b], np.uint32(end_id)))
                    a = b
                yield ready(id_type)
        packer.close()
        if rows:
            yield ready(id_type)

    schema = f"id {kind}, " + ", ".join(f"{c} bigint" for c in columns[1:7]) + ", ids array<int>" * with_ids
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, schema).withColumnRenamed("id", doc_id)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
