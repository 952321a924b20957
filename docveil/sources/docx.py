"""Word documents (zip of XML parts) as relations: parts, structural findings, texts, and the rewritten container.

Parsing needs Python (zip and XML from the standard library); texts then go through the native detectors. Namespace
declarations and prefixes of a part stay as they are when it is rewritten. Each document is handled on its own: analysed()
and compiled() read a container once each and keep all that belongs to it in its row, without a join or a shuffle.
"""

from __future__ import annotations

import io
import re
import struct
import zipfile
import zlib
from xml.dom import minidom
from xml.etree import ElementTree
from xml.parsers import expat
from xml.sax.saxutils import escape

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators.detect import candidates, exploded, tokens
from .haystack import member, slices

# fixed values: namespaces and parts
W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
CORE = "http://schemas.openxmlformats.org/package/2006/metadata/core-properties"
DC = "http://purl.org/dc/elements/1.1/"
TERMS = "http://purl.org/dc/terms/"
APP = "http://schemas.openxmlformats.org/officeDocument/2006/extended-properties"
CUSTOM = "http://schemas.openxmlformats.org/officeDocument/2006/custom-properties"
TYPES = "http://schemas.openxmlformats.org/package/2006/content-types"
RELS = "http://schemas.openxmlformats.org/package/2006/relationships"
COMMENT_PARTS = ["word/comments.xml", "word/commentsExtended.xml", "word/commentsIds.xml", "word/commentsExtensible.xml", "word/people.xml"]
HEADER = re.compile(r"word/(header|footer)\d+\.xml$")
BODY = "word/document.xml"


#: bytes that a container's parts may have together
MOST_BYTES = 256 << 20
DAMAGED = (zipfile.BadZipFile, zlib.error, NotImplementedError, RuntimeError, EOFError, struct.error, OSError, ValueError)


def read_parts(content: bytes | None) -> dict[str, bytes]:
    """Nothing for bytes that are no zip file, or a damaged, encrypted or overlong one."""
    try:
        with zipfile.ZipFile(io.BytesIO(content or b"")) as z:
            if sum(i.file_size for i in z.infolist()) > MOST_BYTES:
                return {}
            return {i.filename: member(z, i, content) for i in z.infolist()}
    except DAMAGED:
        return {}


def write_parts(parts: dict[str, bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in parts.items():
            z.writestr(name, data)
    return out.getvalue()


def _is_plain(data: bytes) -> bool:
    # entities can make a small part fill the memory; Word writes none
    return b"<!ENTITY" not in data and b"<!DOCTYPE" not in data


def _parsed(parts: dict[str, bytes], name: str):
    """A part as a tree to change."""
    if name not in parts or not _is_plain(parts[name]):
        return None
    try:
        return minidom.parseString(parts[name])
    except Exception:  # a part that is no XML gives nothing
        return None


def _root(parts: dict[str, bytes], name: str):
    """A part as a tree to read."""
    if name not in parts or not _is_plain(parts[name]):
        return None
    try:
        return ElementTree.fromstring(parts[name])
    except Exception:  # a part that is no XML gives nothing
        return None


def _own_text(node) -> str:
    """Text right below an element."""
    return "".join([node.text or "", *(c.tail or "" for c in node)])


def _runs(node, *tags: str) -> str:
    return "".join(_own_text(t) for t in node.iter() if t.tag in tags)


_T, _DELETED = f"{{{W}}}t", f"{{{W}}}delText"


def visible_text(root) -> str:
    """A line for each paragraph."""
    return "\n".join(_runs(p, _T) for p in root.iter(f"{{{W}}}p"))


def content_of(parts: dict[str, bytes]) -> tuple[list[tuple], str | None, list[tuple], list[tuple], list[tuple]]:
    """Findings before the texts, the body, findings of embedded files, (part, text) of headers and footers in the container's
    order, findings of properties. A finding is (type, visibility, severity, location, raw, part, custom_prop)."""
    first = []

    def first_of(type_, severity, name, wanted):
        root = _root(parts, name)
        for ns, tag in wanted if root is not None else ():
            node = root.find(f"{{{ns}}}{tag}")
            if node is not None and _own_text(node).strip():
                first.append((type_, "hidden", severity, f"{name}:{tag}", _own_text(node).strip(), None, None))

    first_of("REVISION_AUTHOR", "MEDIUM", "docProps/core.xml", [(DC, "creator"), (CORE, "lastModifiedBy")])
    first_of("SOFTWARE_FINGERPRINT", "LOW", "docProps/app.xml", [(APP, "Application"), (APP, "Company")])
    root = _root(parts, "word/comments.xml")
    for c in root.findall(f"{{{W}}}comment") if root is not None else ():
        author = c.get(f"{{{W}}}author", "")
        raw = (f"{author}: " if author else "") + _runs(c, _T, _DELETED).strip()
        if raw.strip():
            first.append(("COMMENT", "hidden", "MEDIUM", "word/comments.xml:comment", raw, None, None))
    root = _root(parts, BODY)
    for d in root.iter(f"{{{W}}}del") if root is not None else ():
        raw = _runs(d, _T, _DELETED).strip()
        if raw:
            first.append(("HIDDEN_TEXT", "recoverable", "HIGH", f"{BODY}:deletion", raw, None, None))
    body = None if root is None else visible_text(root)
    embedded = [("EMBEDDED_OBJECT", "recoverable", "HIGH", name, name, name, None) for name in parts if name.startswith("word/embeddings/")]
    headers = [(n, visible_text(root)) for n in parts if HEADER.match(n) and (root := _root(parts, n)) is not None]
    properties = []
    root = _root(parts, "docProps/custom.xml")
    for p in root.findall(f"{{{CUSTOM}}}property") if root is not None else ():
        raw = "".join(_own_text(x) for x in p.iter() if x is not p).strip()
        if raw:
            name = p.get("name", "")
            properties.append(("CUSTOM_PROPERTY", "hidden", "LOW", f"docProps/custom.xml:{name}", raw, None, name))
    return first, body, embedded, headers, properties


def _rows(files: DataFrame, make, fields: str, doc_id: str) -> DataFrame:
    """make(content) gives tuples; each becomes a row with its document's id and its place."""
    kind = files.schema[doc_id].dataType.simpleString()
    schema = f"{doc_id} {kind}, n int, {fields}"
    names = [x.strip().split()[0] for x in schema.split(",")]
    types = {"int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    kinds = [types[x.strip().split()[1]] for x in fields.split(",")]

    def run(batches):
        for batch in batches:
            ids, out = [], []
            for i, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                got = make(content)
                ids += [i] * len(got)
                out += [(n, *row) for n, row in enumerate(got)]
            cols = [pa.array([r[k] for r in out], t) for k, t in enumerate([pa.int32(), *kinds])]
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.column(0).type), *cols], names)

    return files.select(doc_id, "content").mapInArrow(run, schema)


def parts(files: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n (place in the container), part_name, content."""
    return _rows(files, lambda c: list(read_parts(c).items()), "part_name string, content binary", doc_id)


#: findings of a container
OWN = ("type", "visibility", "severity", "location", "raw", "part", "custom_prop")
_OWN = pa.list_(pa.struct([(f, pa.string()) for f in OWN]))
_OWN_SQL = f"array<struct<{','.join(f'{f}:string' for f in OWN)}>>"


def _found(text: Column, location: Column, names: bool) -> Column:
    """What the detectors find in a text, as findings of a container."""
    values = {"visibility": F.lit("visible"), "location": location, "part": F.lit(None), "custom_prop": F.lit(None)}
    return F.transform(candidates(text, names), lambda c: F.struct(*[(values[f] if f in values else c[f]).cast("string").alias(f) for f in OWN]))


def analysed(files: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """A row per document: doc_id, content, findings (id and OWN of each, in order)."""
    kind = files.schema[doc_id].dataType.simpleString()
    text = pa.struct([("part", pa.string()), ("text", pa.string())])
    kinds = [_OWN, pa.string(), _OWN, pa.list_(text), _OWN]
    names = ["first", "body", "embedded", "headers", "properties"]

    def run(batches):
        for batch in batches:
            for some in slices(batch):
                rows = [content_of(read_parts(c)) for c in some.column("content").to_pylist()]
                structs = lambda own, of: [[dict(zip(of, x, strict=True)) for x in each] for each in own]
                cols = [pa.array(own if k == 1 else structs(own, ("part", "text") if k == 3 else OWN), t) for k, (t, own) in enumerate(zip(kinds, zip(*rows, strict=True), strict=True))]
                yield pa.RecordBatch.from_arrays([some.column(doc_id), some.column("content"), *cols], [doc_id, "content", *names])

    read = files.select(doc_id, "content").mapInArrow(run, f"{doc_id} {kind}, content binary, first {_OWN_SQL}, body string, embedded {_OWN_SQL}, headers array<struct<part:string,text:string>>, properties {_OWN_SQL}")
    headers = F.flatten(F.transform("headers", lambda h: _found(h["text"], h["part"], False)))
    every = F.concat("first", _found(F.coalesce("body", F.lit("")), F.lit(BODY), True), "embedded", headers, "properties")
    return read.select(doc_id, "content", F.transform(every, lambda f, i: F.struct(F.format_string("f_%02d", i + 1).alias("id"), *[f[x].alias(x) for x in OWN])).alias("findings"))


def analyze(files: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Findings of every document (doc_id, content): id, type, location, visibility, ..., raw, part, custom_prop."""
    rows = exploded(analysed(files, doc_id), doc_id, "findings").select(doc_id, "n", "f.*")
    return tokens(rows.withColumn("value_hash", S.sha256_hex("raw")), [F.col("n")], doc_id).drop("n")


# ---- rewriting ----


def _bytes(tree) -> bytes:
    return tree.toxml(encoding="UTF-8", standalone=True)


def _below(tree) -> dict[tuple, list]:
    """The elements by namespace and name, in the order of the document."""
    found: dict[tuple, list] = {}
    todo = [tree.documentElement]
    while todo:
        node = todo.pop()
        found.setdefault((node.namespaceURI or "", node.localName), []).append(node)
        todo += [c for c in reversed(node.childNodes) if c.nodeType == c.ELEMENT_NODE]
    return found


def _text_nodes(node) -> list:
    return [c for c in node.childNodes if c.nodeType in (c.TEXT_NODE, c.CDATA_SECTION_NODE)]


def _set_text(node, text: str) -> None:
    for c in _text_nodes(node):
        node.removeChild(c)
    node.insertBefore(node.ownerDocument.createTextNode(text), node.firstChild)


class Changes:
    """What becomes of a part: texts put into first elements, elements dropped or unwrapped, values replaced, properties blanked."""

    def __init__(self):
        self.put: dict[str, str] = {}
        self.drop: dict[tuple, object] = {}
        self.unwrap: list[tuple] = []
        self.fill: list[tuple[str, str]] = []
        self.blank: set[str] = set()

    def filled(self, text: str) -> str:
        for raw, repl in self.fill:
            text = text.replace(raw, repl)
        return text

    def first(self, own: dict[tuple, list], tag: str):
        return next((own[ns, tag][0] for ns in (DC, CORE, APP, TERMS) if (ns, tag) in own), None)

    def in_tree(self, tree) -> None:
        own = _below(tree)
        for tag, new in self.put.items():
            node = self.first(own, tag)
            if node is not None:
                _set_text(node, new)
        for key, due in self.drop.items():
            for x in own.get(key, []):
                if x.parentNode is not None and due(lambda name, x=x: x.getAttribute(name)):
                    x.parentNode.removeChild(x)
        for key in self.unwrap:
            for x in own.get(key, []):
                while x.firstChild is not None:
                    x.parentNode.insertBefore(x.firstChild, x)
                x.parentNode.removeChild(x)
        for t in own.get((W, "t"), []) if self.fill else ():
            old = "".join(c.data for c in _text_nodes(t))
            if (new := self.filled(old)) != old:
                _set_text(t, new)
        for p in own.get((CUSTOM, "property"), []) if self.blank else ():
            if p.getAttribute("name") in self.blank:
                for c in p.childNodes:
                    if c.nodeType == c.ELEMENT_NODE:
                        _set_text(c, "")

    def in_bytes(self, data: bytes) -> bytes | None:
        """The part with only the changed bytes changed, everything else as it is; null where that needs a tree."""
        marks = _marks(data)
        if marks is None:
            return None
        own: dict[tuple, list[_Mark]] = {}
        for m in marks:
            own.setdefault(m.key, []).append(m)
        cuts: list[tuple[int, int, bytes]] = []

        def put(m: _Mark, text: str) -> None:
            new = escape(text, {"\r": "&#13;"}).encode()
            if data[m.inside - 2 : m.inside] == b"/>":  # an empty element
                name = re.match(rb"<([^\s/>]+)", data[m.start : m.inside])[1]
                cuts.append((m.start, m.end, data[m.start : m.inside - 2] + b">" + new + b"</" + name + b">"))
            else:
                cuts.append((m.inside, m.close, new))

        texts: list[tuple[_Mark, str]] = []
        for tag, new in self.put.items():
            m = self.first(own, tag)
            texts += [(m, new)] if m is not None else []
        for key, due in self.drop.items():
            cuts += [(m.start, m.end, b"") for m in own.get(key, []) if due(lambda name, m=m: m.attrs.get(name, ""))]
        for key in self.unwrap:
            cuts += [x for m in own.get(key, []) for x in ((m.start, m.inside, b""), (m.close, m.end, b""))]
        texts += [(m, new) for m in own.get((W, "t"), []) if (new := self.filled("".join(m.text))) != "".join(m.text)] if self.fill else []
        blanked = {id(m) for m in own.get((CUSTOM, "property"), []) if m.attrs.get("name", "") in self.blank}
        texts += [(m, "") for m in marks if id(m.parent) in blanked] if blanked else []
        if not all(m.plain for m, _ in texts):
            return None
        for m, new in texts:
            put(m, new)
        out, at = [], 0
        for start, end, new in sorted(cuts, key=lambda c: (c[0], -c[1])):
            if start >= at:  # what lies within a dropped element is gone with it
                out += [data[at:start], new]
                at = end
        return b"".join([*out, data[at:]])


class _Mark:
    """An element and where its tags lie: start, inside, close, end. plain: it holds text alone."""

    __slots__ = ("attrs", "close", "end", "inside", "key", "parent", "plain", "start", "text")

    def __init__(self, key, attrs, start, parent):
        self.key, self.attrs, self.start, self.parent, self.text, self.plain = key, attrs, start, parent, [], True


def _marks(data: bytes) -> list[_Mark] | None:
    """Null for bytes that are no XML or not known to be UTF-8."""
    if b"\0" in data[:4] or data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return None
    parser = expat.ParserCreate(None, " ")
    found: list[_Mark] = []
    above: list[_Mark] = []
    waiting: list[tuple[_Mark, str]] = []
    foreign: list[str] = []

    def settle() -> int:
        at = parser.CurrentByteIndex
        for m, field in waiting:
            setattr(m, field, at)
        waiting.clear()
        return at

    def begun(name, attrs):
        at = settle()
        ns, _, local = name.rpartition(" ")
        parent = above[-1] if above else None
        if parent is not None:
            parent.plain = False
        m = _Mark((ns, local), attrs, at, parent)
        found.append(m)
        above.append(m)
        waiting.append((m, "inside"))

    def ended(_):
        at = settle()
        m = above.pop()
        m.close = at
        waiting.append((m, "end"))

    def said(text):
        settle()
        above[-1].text.append(text)

    def other(_):
        settle()
        if above:
            above[-1].plain = False

    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler, parser.DefaultHandler = begun, ended, said, other
    parser.StartCdataSectionHandler = parser.EndCdataSectionHandler = lambda: settle() and None
    parser.XmlDeclHandler = lambda _, encoding, __: foreign.append(encoding) if (encoding or "utf-8").lower() != "utf-8" else None
    try:
        parser.Parse(data, True)
    except Exception:
        return None
    for m, field in waiting:
        setattr(m, field, len(data))
    return None if foreign else found


def rewrite(content: bytes | None, removals: list[dict]) -> bytes | None:
    """A fresh container. removals: type, location, raw, part, custom_prop, repl of each finding to remove, in order.
    Bytes that can't be read as one, null included, are handed through as they are: see unreadable()."""
    parts = read_parts(content)
    if not parts:
        return content
    by_type: dict[str, list[dict]] = {}
    for r in removals:
        by_type.setdefault(r["type"], []).append(r)
    gone = {r["part"] or r["location"] for r in by_type.get("EMBEDDED_OBJECT", [])} | set(COMMENT_PARTS if "COMMENT" in by_type else ())
    gone = {n for n in gone if parts.pop(n, None) is not None}
    # the changes of each part, so that it is read and written once
    changes: dict[str, Changes] = {}
    of = lambda name: changes.setdefault(name, Changes())
    for type_ in ("REVISION_AUTHOR", "SOFTWARE_FINGERPRINT"):
        for r in by_type.get(type_, []):
            name, _, tag = r["location"].partition(":")
            if tag:
                of(name).put[tag] = r["repl"]
    if gone:
        files = tuple(n.rsplit("/", 1)[-1] for n in gone)
        of("[Content_Types].xml").drop[TYPES, "Override"] = lambda attr: attr("PartName").lstrip("/") in gone
        of("word/_rels/document.xml.rels").drop[RELS, "Relationship"] = lambda attr: attr("Target").endswith(files)
    if "COMMENT" in by_type:
        of(BODY).drop |= {(W, tag): lambda attr: True for tag in ("commentRangeStart", "commentRangeEnd", "commentReference")}
    if "HIDDEN_TEXT" in by_type:  # deletions go, insertions become plain text
        of(BODY).drop[W, "del"] = lambda attr: True
        of(BODY).unwrap.append((W, "ins"))
    for type_ in S.fixed.REPLACE_ORDER:
        for r in by_type.get(type_, []):
            if r["raw"]:
                of(r["location"]).fill.append((r["raw"], r["repl"]))
    for r in by_type.get("CUSTOM_PROPERTY", []):
        of("docProps/custom.xml").blank.add(r["custom_prop"] or "")
    for name, own in changes.items():
        if name not in parts or not _is_plain(parts[name]):
            continue
        new = own.in_bytes(parts[name])
        if new is None and (tree := _parsed(parts, name)) is not None:
            own.in_tree(tree)
            new = _bytes(tree)
        if new is not None:
            parts[name] = new
    return write_parts(parts)


def unreadable(files: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """doc_id of the files that can't be read as containers, to be kept apart from the compiled ones."""
    kind = files.schema[doc_id].dataType.simpleString()

    def run(batches):
        for batch in batches:
            bad = [not read_parts(c) for c in batch.column("content").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(bad, pa.bool_()))], [doc_id])

    return files.select(doc_id, "content").mapInArrow(run, f"{doc_id} {kind}")


#: what rewrite() reads of a finding to remove
_REMOVAL = ("type", "location", "raw", "part", "custom_prop", "repl")


def _replacement(type_: Column, raw: Column, style: str) -> Column:
    blank = (type_ == "SOFTWARE_FINGERPRINT") | ((type_ == "REVISION_AUTHOR") & F.lit(style == "blackbox"))
    return F.when(blank, F.lit("")).otherwise(S.replacement(type_, F.coalesce(raw, F.lit("")), style))


def _rewritten(rows: DataFrame, due: str, keep: list[str], seen=None) -> DataFrame:
    """keep and content, rewritten by what has a replacement in the array `due` of findings; seen(content) instead, if given."""
    fields = [rows.schema[c] for c in keep]
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in fields), "content binary"])

    def run(batches):
        for batch in batches:
            for some in slices(batch):
                flat = some.column(due).flatten()
                removals = [dict(zip(_REMOVAL, r, strict=True)) for r in zip(*(flat.field(f).to_pylist() for f in _REMOVAL), strict=True)]
                out, at = [], 0
                for content, n in zip(some.column("content").to_pylist(), pa.compute.list_value_length(some.column(due)).to_pylist(), strict=True):
                    made = rewrite(content, [r for r in removals[at : at + (n or 0)] if r["repl"] is not None])
                    out.append(made if seen is None else seen(made))
                    at += n or 0
                yield pa.RecordBatch.from_arrays([*(some.column(c) for c in keep), pa.array(out, pa.binary())], [*keep, "content"])

    return rows.select(*dict.fromkeys([*keep, "content", due])).mapInArrow(run, schema)


def compiled(docs: DataFrame, style: str = "token", doc_id: str = "doc_id", seen=None) -> DataFrame:
    """doc_id, findings, content of analysed documents whose findings carry a decision, as compile_files() rewrites them; with
    seen, content is what seen(content) makes of the bytes written, such as what a search has to look through."""
    due = lambda f: f.withField("repl", F.when(f["decision"] == "REMOVE", _replacement(f["type"], f["raw"], style)))
    return _rewritten(docs.select(doc_id, "content", F.transform("findings", due).alias("findings")), "findings", [doc_id, "findings"], seen)


def compile_files(files: DataFrame, decided: DataFrame, style: str = "token", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, content: containers rewritten by the REMOVE findings; documents without any are packed anew as they are, and
    files that can't be read as containers are handed through untouched; unreadable() lists them, and nothing in them is removed."""
    have = [F.col(c) if c in decided.columns else F.lit(None).cast("string").alias(c) for c in ("id", *_REMOVAL[:-1])]
    repl = _replacement(F.col("type"), F.col("raw"), style).alias("repl")
    due = decided.filter("decision = 'REMOVE'").select(F.col(doc_id).alias("_doc"), F.struct(F.char_length("id").alias("k"), *have, repl).alias("r")).groupBy("_doc").agg(F.array_sort(F.collect_list("r")).alias("due"))
    return _rewritten(files.join(due, F.col(doc_id) == F.col("_doc"), "left").select(doc_id, "content", "due"), "due", [doc_id])
