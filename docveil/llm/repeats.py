"""Which 64-bit keys occur more than once, over all tasks, without gathering a key's rows anywhere.

A task sorts its entries (key, id, extra) by key. Keys that it holds more than once (by_id: with different ids) are known to
repeat; all of their entries but one are passed on as such, dealt out by id. What a task says about a key beyond that
is one entry, so a key with a third of all entries costs each reducer no more than an entry from each task. Entries
travel as packed columns, one row for each task and bucket, not as rows of their own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, mix

ROW = "bucket int, entries binary, known binary, chunk int, counts binary"
FIELDS = np.dtype("<u8")


def packed(*columns: np.ndarray) -> bytes:
    """64-bit columns byte plane by byte plane, so that the shuffle's compression finds the empty planes."""
    return b"".join(np.ascontiguousarray(c.astype(FIELDS).view(np.uint8).reshape(-1, 8).T).tobytes() for c in columns)


def unpacked(data: bytes, n_columns: int) -> np.ndarray:
    """Rows: the columns."""
    planes = np.frombuffer(data, dtype=np.uint8).reshape(n_columns, 8, -1)
    return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(FIELDS)[:, :, 0]


class Counter:
    """Counts of hashes in 2 ** bits cells, the same for every amount of data; a cell's count is at least that of any of its hashes."""

    CHUNK = 1 << 12

    def __init__(self, bits: int, lanes: int = 1):
        self.bits, self.counts = bits, np.zeros((lanes, 1 << bits), dtype=np.int64)

    def add(self, hashes: np.ndarray, lane: int = 0) -> None:
        if len(hashes):
            self.counts[lane] += np.bincount((hashes >> np.uint64(64 - self.bits)).astype(np.int64), minlength=1 << self.bits)

    def chunks(self):
        flat = self.counts.ravel()
        for i in range(0, len(flat), self.CHUNK):
            yield i // self.CHUNK, flat[i : i + self.CHUNK]

    @classmethod
    def collected(cls, sums: DataFrame, bits: int, lanes: int = 1) -> np.ndarray:
        """Counts from the summed chunks: a fixed number of rows."""
        out = np.zeros(lanes << bits, dtype=np.int64)
        for row in sums.toLocalIterator():
            out[row["chunk"] * cls.CHUNK : (row["chunk"] + 1) * cls.CHUNK] += np.frombuffer(row["counts"], dtype="<i8")
        return out.reshape(lanes, -1)


def _distinct(key: np.ndarray, other: np.ndarray, by_id: bool) -> np.ndarray:
    """For sorted keys: whether each one's group holds more than one entry, or more than one value of `other`."""
    n = len(key)
    if not n:
        return np.zeros(0, dtype=bool)
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    if not by_id:
        sizes = np.diff(starts, append=n)
        return np.repeat(sizes > 1, sizes)
    low, high = np.minimum.reduceat(other, starts), np.maximum.reduceat(other, starts)
    return np.repeat(low != high, np.diff(starts, append=n))


def as_row(bucket: int, entries: bytes = b"", known: bytes = b"", chunk=None, counts=None) -> tuple:
    return bucket, entries, known, chunk, counts


def as_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.binary()]
    names = ["bucket", "entries", "known", "chunk", "counts"]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)


def n_buckets(df: DataFrame, mb: int = 4) -> tuple[int, int]:
    """(partitions, buckets) for entries made from this input: by the size of its files as Spark's planner has it."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    at_least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if size >= int(df.sparkSession.conf.get("spark.sql.defaultSizeInBytes", str(2**62))) // 2:
        size = 0  # rows that aren't in files: the planner doesn't know
    n = max(at_least, min(100_000, size // (mb << 20)))
    return n, 4 * n


def send(rows: DataFrame, entries_of, buckets: int, counter=None, by_id: bool = True, most: int = 500_000) -> DataFrame:
    """The map side. entries_of(batch, counter) gives (key, id, extra) arrays, one batch after the other. An entry goes with
    the number of those like it that stayed behind."""

    def run(batches):
        lean()
        held, n, sketch = [], 0, counter() if counter else None

        def flush():
            key, own, extra = (np.concatenate(c) for c in zip(*held, strict=True))
            held.clear()
            order = np.lexsort((own, key) if by_id else (extra, own, key))
            key, own, extra = key[order], own[order], extra[order]
            del order
            first = np.concatenate([[True], key[1:] != key[:-1]])
            repeats = _distinct(key, own, by_id)
            # copies of an entry (by id: whatever its extra) say nothing; the first of them stays
            other = first.copy()
            other[1:] |= own[1:] != own[:-1]
            if not by_id:
                other[1:] |= extra[1:] != extra[:-1]
            late = repeats & ~first & other
            # a known key's first entry goes with the number of the others, so that all other tasks' entries of that key learn of it
            starts = np.flatnonzero(first)
            more = np.zeros(len(key), dtype=np.uint64)
            more[starts] = (np.diff(starts, append=len(key)) - 1) * repeats[starts]
            to = np.where(late, own % np.uint64(buckets), mix(key) % np.uint64(buckets)).astype(np.int64)
            out: dict[int, dict[str, bytes]] = {}
            for name, sel in (("entries", first), ("known", late)):
                at = np.flatnonzero(sel)
                if not len(at):
                    continue
                at = at[np.argsort(to[at], kind="stable")]
                edges = np.flatnonzero(np.diff(to[at], prepend=-1))
                for a, b in zip(edges, [*edges[1:], len(at)], strict=True):
                    part = at[a:b]
                    cols = (key[part], own[part], extra[part], more[part]) if name == "entries" else (key[part], own[part], extra[part])
                    out.setdefault(int(to[part[0]]), {})[name] = packed(*cols)
            yield as_batch([as_row(k, **v) for k, v in out.items()])

        for batch in batches:
            for got in entries_of(batch, sketch):
                if len(got[0]):
                    held.append(got)
                    n += len(got[0])
                if n >= most:
                    yield from flush()
                    n = 0
        if n:
            yield from flush()
        if sketch is not None:
            yield as_batch([as_row(c % buckets, chunk=c, counts=x.astype("<i8").tobytes()) for c, x in sketch.chunks()])

    return rows.mapInArrow(run, ROW)


def sum_chunks(rows: DataFrame, partitions: int) -> DataFrame:
    """chunk, counts: each chunk's counts summed, a batch at a time."""

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for c, x in zip(batch.column("chunk").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                own = np.frombuffer(x, dtype="<i8")
                total[c] = total[c] + own if c in total else own
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.astype("<i8").tobytes() for x in total.values()], pa.binary())], ["chunk", "counts"])

    return rows.select("chunk", "counts").repartition(partitions, "chunk").mapInArrow(run, "chunk int, counts binary")


def receive(sent: DataFrame, partitions: int, finish, schema: str, by_id: bool = True, often=None) -> DataFrame:
    """The reduce side: finish(key, id, extra) gives batches from all entries whose key occurs more than once (by_id: with
    several ids); often(key, count), if given, gives batches from all keys and their numbers of entries over all tasks."""

    def run(batches):
        lean()
        held, known, n = [], [], 0
        for batch in batches:
            for x in batch.column("known").to_pylist():
                if x:
                    known.append(unpacked(x, 3))
                    n += known[-1].shape[1]
                    if n >= 500_000:
                        yield from finish(*np.concatenate(known, axis=1))
                        known, n = [], 0
            held += [unpacked(e, 4) for e in batch.column("entries").to_pylist() if e]
        if held:
            key, own, extra, more = np.concatenate(held, axis=1)
            held.clear()
            order = np.argsort(key, kind="stable")
            key, own, extra, more = key[order], own[order], extra[order], more[order]
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            sizes = np.diff(starts, append=len(key))
            marked = np.repeat(np.maximum.reduceat(more, starts), sizes) > 0
            live = marked | _distinct(key, own, by_id)
            if often:
                yield from often(key[starts], np.add.reduceat(more, starts) + sizes.astype(np.uint64))
            known.append(np.stack([key[live], own[live], extra[live]]))
        if known:
            yield from finish(*np.concatenate(known, axis=1))

    return sent.select("bucket", "entries", "known").repartition(partitions, "bucket").mapInArrow(run, schema)
