"""Compiling plain texts and verifying the result by searching its bytes, both row by row on analysed documents.

The verifier shares nothing with the detectors: it sees the output's bytes and the values that should be gone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import scalar as S
from .policy import action_of, checked_intent


def decided(analyzed: DataFrame, intent: str) -> DataFrame:
    """Analysed documents whose findings carry a decision."""
    intent = checked_intent(intent)
    return analyzed.withColumn("findings", F.transform("findings", lambda f: f.withField("decision", action_of(f["type"], intent))))


def removals(findings: Column) -> Column:
    """Values to replace, type by type in a fixed order, then as they were found; types without a replacement are left out."""
    place = F.create_map(*[F.lit(x) for k, t in enumerate(fixed.REPLACE_ORDER) for x in (t, k)])
    own = F.filter(findings, lambda f: (f["decision"] == "REMOVE") & f["raw"].isNotNull() & (f["raw"] != "") & F.map_contains_key(place, f["type"]))
    return F.array_sort(F.transform(own, lambda f, i: F.struct(F.element_at(place, f["type"]).alias("k"), i.alias("i"), f["raw"].alias("raw"), f["type"].alias("type"))))


def replaced(text: Column, findings: Column, style: str = "token") -> Column:
    """The text with every removal replaced, one after the other and literally."""
    return F.aggregate(removals(findings), text, lambda t, r: F.replace(t, r["raw"], S.replacement(r["type"], r["raw"], style)))


def compiled(docs: DataFrame, style: str = "token", text: str = "text") -> DataFrame:
    """Decided documents with output; style: token labels, or blackbox (anything else is token)."""
    return docs.withColumn("output", replaced(F.col(text), F.col("findings"), "blackbox" if style == "blackbox" else "token"))


def verified(docs: DataFrame, text: str = "text", output: str = "output") -> DataFrame:
    """Findings with removed (null unless removal was due) and evidence: whether the input's bytes held the value at all."""
    there = lambda h, f: F.exists(S.needles(f["raw"]), lambda n: F.contains(h, n))
    due = lambda f: (f["decision"] == "REMOVE") & f["raw"].isNotNull()
    one = lambda hay, before: lambda f: f.withField("removed", F.when(due(f), ~there(hay, f))).withField("evidence", F.when(due(f), there(before, f)))
    # the bytes are made once a document, and only where something was due
    bytes_of = lambda c: F.when(F.exists("findings", due), F.encode(F.col(c), "UTF-8"))
    return docs.withColumn("findings", S.let(F.struct(bytes_of(output).alias("hay"), bytes_of(text).alias("before")), lambda b: F.transform("findings", one(b["hay"], b["before"]))))


def verified_bytes(docs: DataFrame, content: str = "content") -> DataFrame:
    """Decided documents whose findings carry removed: null unless removal was due and there are bytes to search."""
    one = lambda f: f.withField("removed", F.when((f["decision"] == "REMOVE") & f["raw"].isNotNull() & F.col(content).isNotNull(), ~F.exists(S.needles(f["raw"]), lambda n: F.contains(F.col(content), n))))
    return docs.withColumn("findings", F.transform("findings", one))


def verify_relation(rows: DataFrame, haystacks: DataFrame, doc_id: str = "doc_id", content: str = "content", ocr: str | None = None) -> DataFrame:
    """The same for a relation of decided findings with raw values and one of output bytes, one row per document."""
    due = (F.col("decision") == "REMOVE") & F.col("raw").isNotNull()
    if ocr:
        due = due & ~F.coalesce(F.col(ocr), F.lit(False))
    own = rows.join(haystacks.select(doc_id, F.col(content).alias("_hay")), doc_id, "left")
    return own.withColumn("removed", F.when(due & F.col("_hay").isNotNull(), ~F.exists(S.needles("raw"), lambda n: F.contains(F.col("_hay"), n)))).drop("_hay")
