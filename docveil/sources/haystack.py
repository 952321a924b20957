"""What a byte search of an output has to look through: zip members, or the bytes and every zlib stream in them."""

from __future__ import annotations

import io
import struct
import zipfile
import zlib

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame

# fixed value: zlib headers that are tried in one file
MOST_STREAMS = 200_000
HEADS = (b"\x78\x01", b"\x78\x9c", b"\x78\xda", b"\x78\x5e")


#: bytes of one zlib stream that are looked through, so that a small file can't fill a worker
MOST_BYTES = 256 << 20
#: bytes of files that a worker handles and hands on together
SLICE = 1 << 20


def member(z: zipfile.ZipFile, info: zipfile.ZipInfo, content: bytes) -> bytes:
    """The bytes of a member of content. A sound one is inflated at once; zipfile reads or refuses everything else."""
    info = z.NameToInfo[info.filename]  # the last one of several with a name
    at = info.header_offset
    if info.compress_type in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED) and not info.flag_bits & 0x61 and content[at : at + 4] == b"PK\x03\x04" and len(content) >= at + 30:
        n_name, n_extra = struct.unpack_from("<HH", content, at + 26)
        begin = at + 30 + n_name + n_extra
        end = begin + info.compress_size
        if content[at + 30 : at + 30 + n_name] == info.orig_filename.encode("utf-8" if info.flag_bits & 0x800 else "cp437", "replace") and end <= (getattr(info, "_end_offset", None) or 0):
            data = content[begin:end]
            try:
                if info.compress_type == zipfile.ZIP_DEFLATED:
                    data = zlib.decompressobj(-15).decompress(data, info.file_size + 1)
                if len(data) == info.file_size and zlib.crc32(data) == info.CRC:
                    return data
            except zlib.error:
                pass
    return z.read(info.filename)


def haystack(content: bytes | None) -> bytes | None:
    """Null where the bytes can't be looked through: a damaged or encrypted container, or a stream of more than MOST_BYTES."""
    content = content or b""
    if zipfile.is_zipfile(io.BytesIO(content)):
        try:
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                if sum(i.file_size for i in z.infolist()) > MOST_BYTES:
                    return None
                return b"\n".join(member(z, i, content) for i in z.infolist())
        except (zipfile.BadZipFile, zlib.error, NotImplementedError, RuntimeError, EOFError, struct.error, OSError):
            return None
    found, view = [content], memoryview(content)
    at = sorted(i for head in HEADS for i in _places(content, head))[:MOST_STREAMS]
    for i in at:
        try:
            opened = zlib.decompressobj()
            data = opened.decompress(view[i:], MOST_BYTES)
        except zlib.error:
            continue
        if opened.unconsumed_tail:
            return None
        if data:
            found.append(data)
    return b"\n".join(found)


def _places(content: bytes, head: bytes):
    i = content.find(head)
    while i >= 0:
        yield i
        i = content.find(head, i + 1)


def slices(batch: pa.RecordBatch, column: str = "content"):
    """The rows of a batch, so many at a time that the bytes of a column stay near SLICE."""
    at = held = 0
    for i, n in enumerate(pa.compute.binary_length(batch.column(column)).to_pylist()):
        held += n or 0
        if held >= SLICE:
            yield batch.slice(at, i + 1 - at)
            at, held = i + 1, 0
    if at < batch.num_rows:
        yield batch.slice(at)


def haystacks(files: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """doc_id, content of files (doc_id, content)."""
    kind = files.schema[doc_id].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for some in slices(batch):
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array([haystack(c) for c in some.column(1).to_pylist()], pa.binary())], [doc_id, "content"])

    return files.select(doc_id, "content").mapInArrow(run, f"{doc_id} {kind}, content binary")
