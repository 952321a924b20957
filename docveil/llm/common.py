"""Shared pieces: tables, Arrow helpers, hashing of words and a place for written tables."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Learners leave out rows whose crc32(doc_id as text) is 0 modulo this.
FOLDS = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id="doc_id"):
    """True for rows kept out of every training set (null ids too)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir). Only in local mode, where all share the machine's folders, may
    it be unset, as in tests: then a temporary one takes its place."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        held = sc._jsc.sc().getCheckpointDir()
        if held.isDefined():
            at = held.get()
        elif sc.master == "local" or sc.master.startswith("local["):
            at = tempfile.mkdtemp(prefix="docveil-")
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(at)
    return at


def _delete(spark: SparkSession, at: str) -> None:
    if spark.sparkContext._jsc is None:  # the session has ended
        return
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """Cuts lineage: the rows are written to the shared folder and read back from there."""
    spark = df.sparkSession
    at = f"{shared_dir(spark).rstrip('/')}/docveil-{uuid.uuid4().hex}"
    df.write.parquet(at)
    out = spark.read.schema(df.schema).parquet(at)
    out._written = at
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes tables that cut() wrote, once nothing that is still to be computed reads them."""
    for df in tables:
        _delete(df.sparkSession, df._written)


# ---- memory of a Python worker ----

#: what a worker process keeps from task to task, by name
KEPT: dict[str, object] = {}
_LIBC = ctypes.CDLL(None)


def lean(but: str = "") -> None:
    """Gives back what earlier operators' tasks left in this worker, all but what is kept by the name `but`."""
    for name in [k for k in KEPT if k != but]:
        del KEPT[name]
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def drawn(rows: DataFrame, n: int, *by: str) -> DataFrame:
    """The n rows whose `by` columns have the smallest hashes. All but about 4 n rows are left out before they are sorted,
    so what is sorted and sent doesn't grow with the table."""
    h = F.xxhash64(*[F.col(c).cast("string") for c in by])
    total = rows.count()
    some = rows if total <= 8 * n else rows.filter(h < F.lit(int(4 * n / total * 2**64) - 2**63))
    return some.orderBy(h, *by).limit(n)


def within_bytes(rows: DataFrame, text: str, most: int, *order: str) -> DataFrame:
    """Those of a few rows that come first and have at most `most` bytes of text together."""
    upto = F.sum(F.octet_length(text)).over(Window.orderBy(*order))
    return rows.withColumn("_upto", upto).filter(F.col("_upto") <= most).drop("_upto")


def by_text(make, fields: str, slice_bytes: int):
    """A function of a text column that gives a struct of `fields`; make() gives, for a task, a function from a list of texts
    (bytes; null is empty) to the fields' Arrow arrays. Only the text goes to Python, once, and only the struct comes back."""
    kind = StructType.fromDDL(fields)

    names = kind.names

    @F.arrow_udf(kind)
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        of = make()
        for column in columns:
            parts = by_bytes(pa.RecordBatch.from_arrays([column], ["text"]), "text", slice_bytes)
            yield pa.concat_arrays([pa.StructArray.from_arrays(of(raw_column(x, "text")), names) for x in parts])

    return run.asNondeterministic()  # so that it is computed once, whatever reads its fields


def raw_column(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A string column as bytes objects; null is empty."""
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def by_bytes(batch: pa.RecordBatch, name: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `most` bytes of the named column each, so that long texts don't pile up."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(name)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    if sizes.sum() <= most:
        yield batch
        return
    group = np.cumsum(sizes) // most
    edges = np.flatnonzero(np.diff(group, prepend=-1))
    for a, b in zip(edges, [*edges[1:], len(sizes)], strict=True):
        yield batch.slice(int(a), int(b - a))


def spread(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The concatenation of arange(start, start + len) of every pair."""
    total = int(lens.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    ends = np.cumsum(lens)
    return np.repeat(starts - (ends - lens), lens) + np.arange(total, dtype=np.int64)


# ---- 64-bit hashes of words and of runs of words, without a Python step per word ----

_M1, _M2, _P = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), 0x9E3779B97F4A7C15
_BYTE = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int, base: int) -> np.ndarray:
    """base ** i modulo 2 ** 64 for i < n."""
    out = np.ones(max(n, 1), dtype=np.uint64)
    done = 1
    while done < n:
        step = np.uint64(pow(base, done, 1 << 64))
        take = min(done, n - done)
        out[done : done + take] = out[:take] * step
        done += take
    return out


_POW = [_powers(1 << 16, _P)]


#: bytes hashed at once, about; working memory is some 40 times as much
_AT_ONCE = 1 << 20


def _hashed(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash and the start of each word; data ends with white space."""
    inside = ~_SPACE[data]
    edge = np.diff(inside.view(np.int8), prepend=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), starts
    lens = (ends - starts).astype(np.int32)
    longest = int(lens.max())
    if longest > len(_POW[0]):
        _POW[0] = _powers(longest, _P)
    # place of each byte in its word, so equal words get equal sums
    at = np.flatnonzero(inside).astype(np.int32)
    at -= np.repeat(starts.astype(np.int32), lens)
    value = _BYTE[data[inside]]
    value *= _POW[0][at]
    first = np.cumsum(lens, dtype=np.int64) - lens
    return mix(np.add.reduceat(value, first) + lens.astype(np.uint64) * np.uint64(_P)), starts


def word_hashes(texts: list[bytes], lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Words are runs of bytes other than 0x20 and 0x09-0x0D.

    Returns a 64-bit hash of each word of all texts and the number of words of each text.
    """
    joined = b" ".join(texts) + b" "
    if lower:
        joined = joined.lower()
    data = np.frombuffer(joined, dtype=np.uint8)
    hashes, starts, a = [], [], 0
    while a < len(data):
        b, span = len(data), _AT_ONCE
        while a + span < len(data):  # up to a white space, so that no word is cut
            spaces = np.flatnonzero(_SPACE[data[a : a + span]])
            if len(spaces):
                b = a + int(spaces[-1]) + 1
                break
            span *= 2
        own, at = _hashed(data[a:b])
        hashes.append(own)
        starts.append(at + a)
        a = b
    text_ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts)))
    upto = np.searchsorted(np.concatenate(starts), text_ends)
    return np.concatenate(hashes), np.diff(upto, prepend=0)


def runs(hashes: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """A hash of each run of k hashes; the result has k - 1 entries less."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    base = (_P ^ (seed * 0xD1342543DE82EF95)) & (2**64 - 1) | 1
    out = np.zeros(n, dtype=np.uint64)
    done, span = 0, 1  # by doubling: block[i] covers `span` hashes from i
    block = hashes
    left = k
    while left:
        if left & 1:
            out = out * np.uint64(pow(base, span, 1 << 64)) + block[done : done + n]
            done += span
        left >>= 1
        if left:
            block = block[:-span] * np.uint64(pow(base, span, 1 << 64)) + block[span:]
            span *= 2
    return mix(out + np.uint64(k))
