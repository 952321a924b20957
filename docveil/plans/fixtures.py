"""Small given relations for queries over formats that the tables don't hold."""

from __future__ import annotations

import io
import re
import struct
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SAMPLES = [
    "4111 1111 1111 1111 ",
    "4111111111111111 4111111111111111",
    "4111111111111111 4111111111111111 ",
    "id 234123412346 and 234123412347",
    "+91 91761 31104, 98765-43210; 09876543210 / 0091 98765 43210 or 4757965300",
    "ABCPE1234F éABCPE1234F ABCXE1234F ABCPE0000F",
    "Address: ab 12 Long Road, Paris\nResiding at: 5 Rue Haute\nunited front",
    "318 Quarry Terrace, Millbrook, OR 97477\nP.O. Box 12, Springfield",
    "Springfield, OR 97477-1234 and Shelbyville, IL 62565",
    "12 Park Street, Chennai PIN code: 600001",
    "Name: John Smith\nDr. Ananya Sharma and Mr. Robert B. Lee met.\nAnanya Sharma",
    "RESUME\nSoftware Engineer\nJane Q. Public\nAuthor: Senior Manager\nContact: jane@corp.com",
    "mail a.b+c@d-e.org, a.b+c@d-e.org; x@y.z",
    "",
]
#: A text for each customer, as an expression that Spark and DuckDB both read: phone, identity, PAN and card numbers, valid and
#: not, addresses of every rule, names and near misses, next to letters of other scripts.
_K = "c_custkey"
_LETTER = lambda x: f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ', CAST({x} % 26 AS INT) + 1, 1)"
_PICK = lambda words, x: f"split_part('{words}', ',', CAST({x} % {len(words.split(','))} AS INT) + 1)"
_PAD = lambda x, n: f"lpad(concat('', {x}), {n}, '0')"
_ID = f"({_K} * 480061753 % 700000000000 + 200000000000)"
_GIVEN, _FAMILY = _PICK("Ananya,Robert,Jane,Élise,Miguel", _K), _PICK("Sharma,Lee,Public,Rao,Engineer,Moreau,Q. Adams", f"({_K} * 5)")
GENERATED = "concat(" + ", chr(10), ".join([
    f"{_PICK('Name,Author,contact,Full name,Title', _K)}, ': ', {_GIVEN}, ' ', {_FAMILY}",
    f"'met ', {_PICK('Dr.,Mr.,Miss,Sir,xDr.,éMr.', _K)}, ' ', {_FAMILY}, ' ', {_GIVEN}, ' ', {_PICK('Iyer,de,Singh and', _K)}, ' there'",
    f"'call ', {_PICK('+91 ,91-,0,,0091 ,+91', _K)}, {_K} * 7919 % 50000 + 50000, {_PICK(' ,-,', _K)}, {_PAD(f'{_K} * 104729 % 100000', 5)}, {_PICK('.,  12345,1, now', _K)}",
    f"'id ', {_PAD(f'CAST(floor({_ID} / 100000000) AS BIGINT)', 4)}, {_PICK(' ,-', _K)}, {_PAD(f'CAST(floor({_ID} / 10000) AS BIGINT) % 10000', 4)}, {_PICK('-, ', _K)}, {_PAD(f'{_ID} % 10000', 4)}",
    f"'tax ', {_PICK(',é,_', _K)}, 'AB', {_LETTER(_K)}, {_LETTER(f'({_K} * 7)')}, {_LETTER(f'({_K} * 11)')}, {_PAD(f'{_K} % 97 * 31 % 1000', 4)}, {_LETTER(f'({_K} * 3)')}, ' end'",
    f"{_PICK('Address: ,,réunit ,Residing at : ,', _K)}, {_K} % 4000, ' ', {_PICK('Park,Long,Old Hill,St. Mary,Évora', _K)}, ' ', {_PICK('Street,rd.,Lane,Plaza,Boulevard,drive', f'({_K} * 3)')}, {_PICK(', Springfield,, near the old mill', _K)}, ', ', {_PICK('OR,il,X', _K)}, ' ', {_PAD(f'{_K} * 13 % 100000', 5)}",
    f"{_PICK('Flat,unit,P.O. Box,Block,éunit', _K)}, ' ', {_K} % 90, {_PICK(', Tower 2, Chennai, - see', _K)}",
    f"{_PICK('Chennai,Anna Nagar West,X', _K)}, ' ', {_K} % 700, {_PICK(' PIN: , pincode , pin code - , pun ', _K)}, {_K} * 17 % 900000 + 100000, {_PICK(',0,x', _K)}",
]) + ")"
VALUES = ["John Smith", "jane@corp.com", "9876543210", "ab", "a", "", "  padded name  ", "@corp.com", "x@", "name with @sign", "Łódź", "café"]


def samples(spark: SparkSession) -> DataFrame:
    """doc_id below zero, so that they can stand beside the documents."""
    return spark.createDataFrame([(-1 - i, t) for i, t in enumerate(SAMPLES)], "doc_id long, text string")


def generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text: one text for each customer, ids below those of samples()."""
    return spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr("-1000 - c_custkey AS doc_id", f"{GENERATED} AS text")


def values(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(v,) for v in VALUES], "v string")


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of each benchmark text on a grid of eight columns, 10 x 4 apart."""
    own = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("doc_id"), F.posexplode(F.split("text", "[ \n]+")).alias("word_no", "text"))
    x, y = (F.col("word_no") % 8) * 10.0, F.floor(F.col("word_no") / 8) * 4.0
    return own.select("doc_id", F.lit(0).alias("page"), "word_no", "text", x.alias("x0"), y.alias("y0"), (x + 9.0).alias("x1"), (y + 3.0).alias("y1"))


def drawings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three boxes for each benchmark text: one dark over two words, one light, one dark that covers half of a word."""
    boxes = [(0, 0.0, 0.0, 19.0, 3.0, 0.0, 0.0, 0.0), (1, 0.0, 0.0, 80.0, 40.0, 0.9, 0.9, 0.9), (2, 30.0, 0.0, 34.0, 3.0, 0.1, 0.1, 0.1)]
    names = ["page", "rect_no", "x0", "y0", "x1", "y1", "r", "g", "b"]
    each = F.explode(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, (0, *b), strict=True)]) for b in boxes]))
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("doc_id"), each.alias("d")).select("doc_id", "d.*")


def ocr_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of five words, three lines to a block; every eleventh word is unsure."""
    n = F.col("word_no")
    return words(spark, sf_dir).select(
        "doc_id", "word_no", "text", F.when(n % 11 == 10, 12.0).otherwise(90.0).alias("conf"), (n % 5 * 10).cast("int").alias("x"), F.floor(n / 5).cast("int").alias("y"), F.lit(9).alias("w"), F.lit(1).alias("h"),
        F.floor(n / 15).cast("int").alias("block"), (F.floor(n / 5) % 3).cast("int").alias("line"),
    )


def ocr_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The generated texts as recognised words, a line for each line."""
    lines = generated(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "t"))
    each = lines.select("doc_id", "line", F.posexplode(F.split("t", " +")).alias("k", "text")).filter("text <> ''")
    return each.selectExpr("doc_id", "line * 100 + k AS word_no", "text", "90.0D AS conf", "k * 10 AS x", "line * 4 AS y", "9 AS w", "3 AS h", "0 AS block", "line")


def ocr_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third and fourth word of each text, the inside of its first, and a value that isn't there."""
    held = words(spark, sf_dir).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("word_no", "text"))), lambda w: w["text"]).alias("w"))
    two = F.concat_ws(" ", F.try_element_at("w", F.lit(3)), F.try_element_at("w", F.lit(4)))
    return held.select("doc_id", F.posexplode(F.array(two, F.expr("substring(w[0], 2, 3)"), F.lit("no such value"))).alias("n", "raw")).select("doc_id", F.format_string("f_%02d", F.col("n") + 1).alias("id"), "raw")


def exif_rows(spark: SparkSession) -> DataFrame:
    rows = [(1, "original", "0th/Make", "A"), (1, "sanitized", "0th/Make", "A"), (1, "original", "GPS/GPSLatitude", "((1, 1),)"), (1, "original", "0th/Artist", ""), (2, "sanitized", "0th/Model", "B"), (2, "original", "0th/Software", "x"), (2, "sanitized", "0th/Software", "y")]
    return spark.createDataFrame(rows, "doc_id long, side string, tag string, value string")


def pdf_relations(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """What a reader would give of a file for each benchmark text: two pages, the second with a customer's generated text."""
    own = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("doc_id"))
    second = spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr("c_custkey AS doc_id", "1 AS page", f"{GENERATED} AS text").join(own, "doc_id", "left_semi")
    placed = second.select("doc_id", "page", F.posexplode(F.split("text", "[ \n]+")).alias("word_no", "text"))
    x = (F.col("word_no") * 10).cast("double")
    placed = placed.select("doc_id", "page", "word_no", "text", x.alias("x0"), F.lit(0.0).alias("y0"), (x + 9).alias("x1"), F.lit(3.0).alias("y1"))
    return {
        "metadata": own.selectExpr("doc_id", "stack(4, 'xmp', concat('packet ', doc_id), 'author', concat(' A. Uthor ', doc_id % 3, ' '), 'producer', if(doc_id % 2 = 0, ' ', 'Maker'), 'creator', 'Maker') AS (key, value)"),
        "attachments": own.filter("doc_id % 3 = 0").selectExpr("doc_id", "1 AS n", "concat('a', doc_id, '.csv') AS name"),
        "scripts": own.filter("doc_id % 5 = 0").selectExpr("doc_id", "'app.alert(1)' AS code"),
        "annotations": own.selectExpr("doc_id", "doc_id % 2 AS page", "1 AS n", "if(doc_id % 4 = 0, NULL, ' Bob ') AS author", "if(doc_id % 4 = 1, ' ', 'look') AS content"),
        "images": own.selectExpr("doc_id", "0 AS page", "7 AS n", "640 AS width", "480 AS height", "if(doc_id % 2 = 0, unhex('FFD8E9'), NULL) AS content", "array(array(1.0D, 2.0D, 3.0D, 4.0D)) AS rects"),
        "fields": own.selectExpr("doc_id", "1 AS page", "doc_id AS n", "if(doc_id % 2 = 0, 'Name', '') AS name", "if(doc_id % 3 = 0, ' ', ' filled ') AS value"),
        "words": words(spark, sf_dir).unionByName(placed),
        "drawings": drawings(spark, sf_dir),
        "page_texts": second,
    }


# ---- containers ----

_W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


#: characters that XML can't hold
_ILLEGAL = re.compile("[^\t\n\r\x20-\\ud7ff\\ue000-\\ufffd\\U00010000-\\U0010ffff]")


def docx_bytes(text: str, header: str = "call 98765 43210") -> bytes:
    """A small container: metadata, a comment, a deletion, an insertion, an embedded file, a header, a custom property."""
    legal = _ILLEGAL.sub("", text)
    body = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(line)}</w:t></w:r></w:p>' for line in legal.split("\n"))
    parts = {
        "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Override PartName="/word/comments.xml" ContentType="c"/><Override PartName="/word/document.xml" ContentType="d"/></Types>',
        "docProps/core.xml": '<cp:coreProperties xmlns:cp="http://schemas.openxmlformats.org/package/2006/metadata/core-properties" xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:creator>corp\\author</dc:creator><cp:lastModifiedBy>corp\\author</cp:lastModifiedBy></cp:coreProperties>',
        "docProps/app.xml": '<Properties xmlns="http://schemas.openxmlformats.org/officeDocument/2006/extended-properties"><Application>Writer</Application><Company>Acme</Company></Properties>',
        "docProps/custom.xml": '<Properties xmlns="http://schemas.openxmlformats.org/officeDocument/2006/custom-properties" xmlns:vt="http://schemas.openxmlformats.org/officeDocument/2006/docPropsVTypes"><property name="Case"><vt:lpwstr>X-17</vt:lpwstr></property></Properties>',
        "word/comments.xml": f'<w:comments {_W}><w:comment w:author="Bob"><w:p><w:r><w:t>check this</w:t></w:r></w:p></w:comment></w:comments>',
        "word/_rels/document.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="comments.xml"/><Relationship Id="r2" Target="embeddings/a.bin"/></Relationships>',
        "word/document.xml": f'<w:document {_W}><w:body>{body}<w:p><w:del><w:r><w:delText>gone words</w:delText></w:r></w:del><w:ins><w:r><w:t>new words</w:t></w:r></w:ins><w:r><w:commentReference/></w:r></w:p></w:body></w:document>',
        "word/header1.xml": f"<w:hdr {_W}><w:p><w:r><w:t>{escape(header)}</w:t></w:r></w:p></w:hdr>",
        "word/embeddings/a.bin": "bytes",
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in parts.items():
            z.writestr(zipfile.ZipInfo(name), data, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def jpeg_bytes(thumbnail: bytes = b"\xff\xd8small\xff\xd9") -> bytes:
    """A JPEG header with EXIF: coordinates, make, model, software and a thumbnail; no picture."""

    def ifd(entries, at, following=0):
        """Entries (tag, kind, count, data); data beyond four bytes go behind the directory."""
        head, tail = b"", b""
        behind = at + 2 + 12 * len(entries) + 4
        for tag, kind, count, data in entries:
            if len(data) > 4:
                head += struct.pack("<HHII", tag, kind, count, behind + len(tail))
                tail += data
            else:
                head += struct.pack("<HHI", tag, kind, count) + data.ljust(4, b"\0")
        return struct.pack("<H", len(entries)) + head + struct.pack("<I", following) + tail

    rational = lambda *x: b"".join(struct.pack("<II", a, b) for a, b in x)
    text = lambda tag, s: (tag, 2, len(s) + 1, s.encode() + b"\0")
    first = [text(271, "Canon"), text(272, "Canon EOS 5D"), text(305, "Camera 1.0"), (34853, 4, 1, b"\0\0\0\0")]
    gps_at = 8 + len(ifd(first, 8))
    gps = ifd([text(1, "N"), (2, 5, 3, rational((37, 1), (46, 1), (2999, 100))), text(3, "W"), (4, 5, 3, rational((122, 1), (25, 1), (10, 1)))], gps_at)
    last_at = gps_at + len(gps)
    first[3] = (34853, 4, 1, struct.pack("<I", gps_at))
    last = ifd([(513, 4, 1, struct.pack("<I", last_at + 30)), (514, 4, 1, struct.pack("<I", len(thumbnail)))], last_at)
    tiff = b"II*\0" + struct.pack("<I", 8) + ifd(first, 8, last_at) + gps + last + thumbnail
    app1 = b"Exif\0\0" + tiff
    return b"\xff\xd8\xff\xe1" + struct.pack(">H", len(app1) + 2) + app1 + b"\xff\xda\x00\x02pixels\xff\xd9"


def photos(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(1, bytearray(jpeg_bytes())), (2, bytearray(b"no image")), (3, bytearray(b""))], "doc_id long, content binary")
