"""EXIF of JPEG files: tags as rows, findings, and a copy without metadata segments.

The copy keeps the pixels as they are and drops APP1, APP13 and comment segments; it doesn't decode and encode anew.
"""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators.detect import tokens

# fixed values: names of tags; others go by their number
NAMES = {
    "0th": {270: "ImageDescription", 271: "Make", 272: "Model", 274: "Orientation", 282: "XResolution", 283: "YResolution", 296: "ResolutionUnit", 305: "Software", 306: "DateTime", 315: "Artist", 33432: "Copyright", 34665: "ExifTag", 34853: "GPSTag"},
    "Exif": {33434: "ExposureTime", 33437: "FNumber", 34855: "ISOSpeedRatings", 36864: "ExifVersion", 36867: "DateTimeOriginal", 36868: "DateTimeDigitized", 37386: "FocalLength", 37510: "UserComment", 40962: "PixelXDimension", 40963: "PixelYDimension", 42036: "LensModel"},
    "GPS": {0: "GPSVersionID", 1: "GPSLatitudeRef", 2: "GPSLatitude", 3: "GPSLongitudeRef", 4: "GPSLongitude", 5: "GPSAltitudeRef", 6: "GPSAltitude", 7: "GPSTimeStamp", 29: "GPSDateStamp"},
    "1st": {259: "Compression", 282: "XResolution", 283: "YResolution", 296: "ResolutionUnit", 513: "JPEGInterchangeFormat", 514: "JPEGInterchangeFormatLength"},
}
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8}
_CODES = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i"}


def segments(data: bytes):
    """(marker, start, end) of each segment before the image data; nothing for bytes that are no JPEG."""
    at = 2 if (data or b"")[:2] == b"\xff\xd8" else len(data or b"")
    while at + 4 <= len(data or b"") and data[at] == 0xFF and data[at + 1] != 0xDA:
        size = struct.unpack(">H", data[at + 2 : at + 4])[0]
        yield data[at + 1], at, at + 2 + size
        at += 2 + size


def _value(t: bytes, order: str, kind: int, n: int, at: int):
    size = _SIZES[kind] * n
    where = at if size <= 4 else struct.unpack(order + "I", t[at : at + 4])[0]
    raw = t[where : where + size]
    if len(raw) < size:
        raise ValueError("value beyond the end")
    if kind in (2, 7):
        return raw.rstrip(b"\0") if kind == 2 else raw
    if kind in (5, 10):
        x = struct.unpack(order + ("I" if kind == 5 else "i") * 2 * n, raw)
        pairs = tuple(zip(x[::2], x[1::2], strict=True))
        return pairs[0] if n == 1 else pairs
    x = struct.unpack(order + _CODES[kind] * n, raw)
    return x[0] if n == 1 else x


def read_exif(data: bytes) -> dict:
    """ifd -> tag -> value, and the thumbnail's bytes; nothing if there is no readable EXIF."""
    try:
        body = next((data[a + 10 : b] for m, a, b in segments(data) if m == 0xE1 and data[a + 4 : a + 10] == b"Exif\0\0"), None)
        if body is None:
            return {}
        order = {b"II": "<", b"MM": ">"}[body[:2]]

        def ifd(at: int) -> tuple[dict, int]:
            n = struct.unpack(order + "H", body[at : at + 2])[0]
            own = {}
            for i in range(n):
                e = at + 2 + 12 * i
                tag, kind, count = struct.unpack(order + "HHI", body[e : e + 8])
                if kind in _SIZES:
                    own[tag] = _value(body, order, kind, count, e + 8)
            after = body[at + 2 + 12 * n : at + 6 + 12 * n]
            return own, struct.unpack(order + "I", after)[0] if len(after) == 4 else 0

        zeroth, following = ifd(struct.unpack(order + "I", body[4:8])[0])
        out = {"0th": zeroth}
        for name, tag in (("Exif", 34665), ("GPS", 34853)):
            if tag in zeroth:
                out[name] = ifd(zeroth[tag])[0]
        if following:
            out["1st"] = ifd(following)[0]
            a, n = out["1st"].get(513), out["1st"].get(514)
            if a and n:
                out["thumbnail"] = body[a : a + n]
        return out
    except (KeyError, ValueError, struct.error, IndexError, TypeError):
        return {}


def flat_tags(data: bytes) -> list[tuple[str, str]]:
    """(ifd/name, value of at most 120 characters); the thumbnail as its size."""
    exif = read_exif(data)
    out = []
    for ifd in ("0th", "Exif", "GPS", "1st"):
        for tag, v in exif.get(ifd, {}).items():
            shown = v.decode("latin-1").rstrip("\0") if isinstance(v, bytes) else str(v)
            out.append((f"{ifd}/{NAMES[ifd].get(tag, tag)}", shown[:120]))
    if exif.get("thumbnail"):
        out.append(("thumbnail", f"<embedded JPEG, {len(exif['thumbnail'])} bytes>"))
    return out


def _parse(data: bytes) -> dict:
    """What the native part needs: rational degrees with references, three names, the thumbnail."""
    exif = read_exif(data)
    gps, zeroth = exif.get("GPS", {}), exif.get("0th", {})

    def degrees(tag):
        v = gps.get(tag)
        if not (isinstance(v, tuple) and len(v) == 3 and all(isinstance(x, tuple) and x[1] for x in v)):
            return None
        return [x[0] / x[1] for x in v]

    ref = lambda tag, default: gps.get(tag, default).decode("latin-1") if isinstance(gps.get(tag, default), bytes) else ""
    name = lambda tag: (v.decode("latin-1").rstrip("\0").strip() if isinstance(v, bytes) else str(v)) if (v := zeroth.get(tag)) else None
    return {"lat": degrees(2), "lat_ref": ref(1, b"N"), "lon": degrees(4), "lon_ref": ref(3, b"E"), "make": name(271), "model": name(272), "software": name(305), "thumbnail": exif.get("thumbnail")}


_PARSED = pa.struct([("lat", pa.list_(pa.float64())), ("lat_ref", pa.string()), ("lon", pa.list_(pa.float64())), ("lon_ref", pa.string()), ("make", pa.string()), ("model", pa.string()), ("software", pa.string()), ("thumbnail", pa.binary())])
_PARSED_SQL = "struct<lat:array<double>,lat_ref:string,lon:array<double>,lon_ref:string,make:string,model:string,software:string,thumbnail:binary>"


def analyze(files: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Findings of images (doc_id, content): coordinates, make, model, software and thumbnail. A thumbnail's value is its bytes read as Latin-1."""
    kind = files.schema[doc_id].dataType.simpleString()

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_parse(c or b"") for c in batch.column(1).to_pylist()], _PARSED)], [doc_id, "e"])

    parsed = files.select(doc_id, "content").mapInArrow(run, f"{doc_id} {kind}, e {_PARSED_SQL}")
    deg = lambda side: S.degrees(F.col(f"e.{side}")[0], F.col(f"e.{side}")[1], F.col(f"e.{side}")[2], F.col(f"e.{side}_ref"))
    made = lambda n, type_, loc, vis, sev, raw, shown=None: F.struct(F.lit(n).alias("n"), F.lit(type_).alias("type"), F.lit(loc).alias("location"), F.lit(vis).alias("visibility"), F.lit(sev).alias("severity"), raw.alias("raw"), (F.lit(None).cast("string") if shown is None else shown).alias("shown"))
    thumb = F.decode(F.col("e.thumbnail"), "ISO-8859-1")
    rows = F.array(
        made(1, "GPS_COORDINATES", "exif:GPS", "hidden", "CRITICAL", F.format_string("%.6f,%.6f", deg("lat"), deg("lon")), F.format_string("%.3f, %.3f (approx)", deg("lat"), deg("lon"))),
        *[made(n, "SOFTWARE_FINGERPRINT", f"exif:{f.capitalize()}", "hidden", "LOW", F.col(f"e.{f}")) for n, f in ((2, "make"), (3, "model"), (4, "software"))],
        made(5, "EXIF_THUMBNAIL", "exif:thumbnail", "recoverable", "HIGH", thumb, F.format_string("<embedded JPEG, %d bytes — original framing>", F.length("e.thumbnail"))),
    )
    there = F.filter(rows, lambda r: F.when(r["n"] == 1, F.col("e.lat").isNotNull() & F.col("e.lon").isNotNull()).otherwise(r["raw"].isNotNull() & (r["raw"] != "")))
    found = parsed.select(doc_id, F.explode(there).alias("r")).select(doc_id, "r.*")
    numbered = found.withColumn("id", F.format_string("f_%02d", F.row_number().over(Window.partitionBy(doc_id).orderBy("n")))).withColumn("value_hash", S.sha256_hex("raw"))
    out = tokens(numbered, [F.col("n")], doc_id)
    return out.withColumn("value_preview", F.when(F.col("type") == "EXIF_THUMBNAIL", F.col("shown")).otherwise(F.col("value_preview"))).drop("n", "shown")


def tags(files: DataFrame, side: str = "original", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, side, tag, value."""
    kind = files.schema[doc_id].dataType.simpleString()

    def run(batches):
        for batch in batches:
            rows = [(i, t, v) for i, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for t, v in flat_tags(c or b"")]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], batch.column(0).type), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())], [doc_id, "tag", "value"])

    return files.select(doc_id, "content").mapInArrow(run, f"{doc_id} {kind}, tag string, value string").withColumn("side", F.lit(side))


def strip(data: bytes) -> bytes:
    """The file without APP1, APP13 and comment segments."""
    out, done = [], 0
    for marker, a, b in segments(data):
        if marker in (0xE1, 0xED, 0xFE):
            out.append(data[done:a])
            done = b
    return b"".join([*out, data[done:]])


def compile_files(files: DataFrame, decided: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """doc_id, content: without metadata where any finding of these kinds is to go, else a plain copy."""
    kinds = ["GPS_COORDINATES", "SOFTWARE_FINGERPRINT", "EXIF_THUMBNAIL", "USER_SPECIFIED"]
    due = decided.filter((F.col("decision") == "REMOVE") & F.col("type").isin(kinds)).select(F.col(doc_id).alias("_doc")).distinct()
    kind = files.schema[doc_id].dataType.simpleString()

    def run(batches):
        for batch in batches:
            out = [strip(c) if go else c for c, go in zip(batch.column("content").to_pylist(), batch.column("go").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], [doc_id, "content"])

    return files.join(due, F.col(doc_id) == F.col("_doc"), "left").select(doc_id, "content", F.col("_doc").isNotNull().alias("go")).mapInArrow(run, f"{doc_id} {kind}, content binary")
