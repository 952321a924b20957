"""Detectors over text, as array expressions on one row: no shuffle, no join, however large the corpus.

candidates() lists what the rules match in a text, in the order in which findings are numbered; text_findings() adds the
numbered findings to each row; findings() makes them a relation. A detector is a function from a text column to an
array of candidates, registered by name in DETECTORS.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import scalar as S

#: one match: its place in the order of findings, its type, severity and value
CANDIDATE = "struct<rule:int,line:int,sub:int,pos:int,type:string,severity:string,raw:string>"
FINDING = "struct<id:string,type:string,location:string,visibility:string,value_hash:string,value_preview:string,severity:string,raw:string>"


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _candidates(raws: Column, rule: int, type_: str, severity: str, line: Column | None = None, sub: int = 0) -> Column:
    line = F.lit(0) if line is None else line
    made = F.transform(raws, lambda r, i: F.struct(F.lit(rule).alias("rule"), line.cast("int").alias("line"), F.lit(sub).alias("sub"), i.cast("int").alias("pos"), F.lit(type_).alias("type"), F.lit(severity).alias("severity"), r.alias("raw")))
    return made.cast(f"array<{CANDIDATE}>")


def _where(there: Column, found: Column) -> Column:
    """What is found, looked for only where a cheaper search says that it can be there."""
    return F.when(there, found).otherwise(F.array().cast("array<string>"))


def _long_number(text: Column) -> Column:
    """Whether ten digits stand together, as telephone, identity and card numbers need them."""
    return text.rlike(r"(?U)\d(?:[\s\-]?\d){9}")


def emails(text: Column) -> Column:
    return _candidates(_where(F.contains(text, F.lit("@")), _all(text, fixed.EMAIL)), 1, "EMAIL", "MEDIUM")


def phones(text: Column) -> Column:
    return _candidates(F.filter(F.transform(_where(_long_number(text), _all(text, fixed.PHONE)), S.strip), S.valid_phone), 3, "PHONE", "MEDIUM")


def pans(text: Column) -> Column:
    return _candidates(F.filter(_all(text, fixed.PAN), S.valid_pan), 4, "PAN", "HIGH")


def aadhaars(text: Column) -> Column:
    return _candidates(F.filter(_where(_long_number(text), _all(text, fixed.AADHAAR)), S.valid_aadhaar), 5, "AADHAAR", "CRITICAL")


def cards(text: Column) -> Column:
    return _candidates(F.filter(_where(_long_number(text), _all(text, fixed.CARD)), S.valid_card), 6, "CARD", "CRITICAL")


def line_addresses(line: Column, number: Column) -> Column:
    """Addresses of one stripped line. A labelled line gives its rest or, where that is too short, nothing."""
    labelled = S.strip(F.regexp_extract(line, fixed.ADDRESS_PREFIX, 1))
    own = F.filter(F.array(labelled), lambda r: F.char_length(r) >= 5)
    long_enough = lambda r: F.char_length(r) >= 8
    street = F.transform(_all(line, fixed.ADDRESS_STREET), lambda r: F.regexp_replace(S.strip(r), r"[.,;]+\z", ""))
    make = lambda raws, sub: _candidates(raws, 2, "ADDRESS", "HIGH", number, sub)
    rest = [make(F.filter(street, long_enough), 1)]
    # the ends that these patterns need are looked for first: the patterns try a beginning at every word
    for k, pattern, end in ((2, fixed.ADDRESS_ZIP, r"(?U),\s*[A-Z]{2}\s+\d{5}"), (3, fixed.ADDRESS_PIN, r"(?iU)pin(?:\s*code)?\s*[:\-]?\s*\d{6}")):
        rest.append(F.when(line.rlike(end), make(F.filter(F.transform(_all(line, pattern), S.strip), long_enough), k)).otherwise(F.array().cast(f"array<{CANDIDATE}>")))
    return F.when(line.rlike(fixed.ADDRESS_PREFIX), make(own, 0)).otherwise(F.concat(*rest))


def addresses(text: Column, own: Column | None = None) -> Column:
    """own: the text's lines, if they are at hand."""
    return F.flatten(F.transform(S.lines(text) if own is None else own, line_addresses))


def _name_candidates(text: Column, own: Column) -> dict[str, Column]:
    """own: the text's lines."""
    labelled = F.transform(own, lambda line: S.strip(F.regexp_extract(line, fixed.NAME_PREFIX, 1)))
    titled = F.when(text.rlike(r"M(?:rs?|s)\.|Miss|Dr\.|Prof\.|Sir"), _all(text, fixed.NAME_HONORIFIC)).otherwise(F.array().cast("array<string>"))
    honorific = F.transform(titled, lambda r: S.strip(F.regexp_extract(r, r"\A[^\n\r]*", 0)))
    return {"prefix": F.filter(labelled, lambda r: (r != "") & S.valid_name(r)), "honorific": honorific, "toplines": F.filter(F.slice(own, 1, 6), S.valid_name)}


def _anchored(text: Column, low: Column, found: Column) -> Column:
    """Each value as it first stands in the text, whatever its case there; distinct and not blank."""

    def one(r):
        return S.let(F.call_function("locate", F.lower(r), low), lambda at: S.strip(F.when(at > 0, F.substring(text, at, F.char_length(r))).otherwise(r)))

    return F.array_distinct(F.filter(F.transform(found, one), lambda r: r != ""))


def person_names(text: Column, own: Column | None = None) -> Column:
    """Names by label, by honorific and among the first six lines, as they first stand in the text; none within a longer one.
    own: the text's lines, if they are at hand."""

    def outer(own):
        whole = F.filter(own, lambda r: ~F.exists(own, lambda s: (s != r) & F.contains(s, r)))
        return F.array_sort(F.transform(whole, lambda r: F.struct((-F.char_length(r)).alias("n"), F.call_function("locate", r, text).alias("at"), r.alias("raw"))))

    named = lambda own: F.array_distinct(F.concat(*_name_candidates(text, own).values()))
    found = S.let(S.lines(text), named) if own is None else named(own)
    # most texts have none; then nothing is searched for
    keyed = S.let(found, lambda f: S.let(F.when(F.size(f) > 0, F.lower(text)), lambda low: S.let(_anchored(text, low, f), outer)))
    return _candidates(F.transform(keyed, lambda s: s["raw"]), 7, "PERSON_NAME", "MEDIUM")


#: in the order of findings; the text detectors share the rule that a value is reported once
DETECTORS: dict[str, Callable[..., Column]] = {"email": emails, "address": addresses, "phone": phones, "pan": pans, "aadhaar": aadhaars, "card": cards}
NAMES = {"person_name": person_names}


_ORDER = ("rule", "line", "sub", "pos", "type", "severity", "raw")


def once(candidates: Column) -> Column:
    """The first candidate of each value, in the order of findings. Sorts instead of comparing all with all."""
    by_value = F.array_sort(F.transform(candidates, lambda c: F.struct(c["raw"].alias("raw"), *[c[f].alias(f) for f in _ORDER[:-1]])))
    # index - 1 of the first element is no index: get() gives null there
    firsts = S.let(by_value, lambda v: F.filter(v, lambda c, i: ~F.get(v, i - 1)["raw"].eqNullSafe(c["raw"])))
    return F.array_sort(F.transform(firsts, lambda c: F.struct(*[c[f].alias(f) for f in _ORDER])))


def numbered(candidates: Column, location: Column, visibility: str = "visible", prefix: str = "f") -> Column:
    """Findings: numbered as they come, shown by tokens ("Email 2") that count the values of a family."""

    def one(ranks):
        def make(c, i):
            kind = S.family(c["type"])
            return F.struct(
                F.format_string(f"{prefix}_%02d", i + 1).alias("id"), c["type"].alias("type"), location.alias("location"), F.lit(visibility).alias("visibility"), S.sha256_hex(c["raw"]).alias("value_hash"),
                F.coalesce(F.concat(kind, F.lit(" "), F.get(ranks, i).cast("string")), S.mask(c["raw"])).alias("value_preview"), c["severity"].alias("severity"), c["raw"].alias("raw"),
            )

        return make

    def ranks_of(kin):
        """The number of each place within its family: its place among all, sorted by family, less that of the family's first."""
        by_family = F.array_sort(F.transform(kin, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))

        def ranked(own):
            kinds = F.transform(own, lambda x: x["k"])
            firsts = S.let(F.array_distinct(kinds), lambda f: F.map_from_arrays(f, F.transform(f, lambda k: F.array_position(kinds, k))))
            places = S.let(firsts, lambda m: F.transform(own, lambda x, j: F.struct(x["i"].alias("i"), (j + 2 - F.element_at(m, x["k"])).alias("n"))))
            return F.transform(F.array_sort(places), lambda x: x["n"])

        return S.let(by_family, ranked)

    return S.let(candidates, lambda all_: S.let(ranks_of(F.transform(all_, lambda c: F.coalesce(S.family(c["type"]), F.lit("")))), lambda ranks: F.transform(all_, one(ranks))))


def candidates(text: Column, names: bool = True, detectors: list[str] | None = None) -> Column:
    """All candidates of a text; its lines are made once."""
    wanted = {d: f for d, f in DETECTORS.items() if detectors is None or d in detectors}

    def every(own):
        found = once(F.concat(*[f(text, own) if d == "address" else f(text) for d, f in wanted.items()]))
        return F.concat(found, *[f(text, own) for f in NAMES.values()]) if names else found

    return S.let(S.lines(text), every) if names or "address" in wanted else every(None)


def text_findings(docs: DataFrame, text: str = "text", location: str = "text", names: bool = True, detectors: list[str] | None = None) -> DataFrame:
    """docs with `findings`, an array of findings; null and empty texts have none. detectors: names, all by default."""
    held = docs.withColumn("_candidates", F.coalesce(candidates(F.coalesce(F.col(text), F.lit("")), names, detectors), F.array().cast(f"array<{CANDIDATE}>")))
    return held.withColumn("findings", numbered(F.col("_candidates"), F.lit(location))).drop("_candidates")


def exploded(rows: DataFrame, doc_id: str, array: str) -> DataFrame:
    """doc_id, n, f. Spark derives a filter from an inner explode and computes the array again for it; an outer one has none."""
    return rows.select(doc_id, F.posexplode_outer(array).alias("n", "f")).filter("f is not null")


def findings(analyzed: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """A row per finding, raw values included; report.public() leaves them out."""
    return exploded(analyzed.select(doc_id, "findings"), doc_id, "findings").select(doc_id, "n", "f.*")


def detect(docs: DataFrame, detector: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n, raw: what one detector finds, each value once per text."""
    f = {**DETECTORS, **NAMES}[detector]
    found = docs.select(doc_id, once(f(F.coalesce(F.col(text), F.lit("")))).alias("c"))
    return exploded(found, doc_id, "c").select(doc_id, F.col("n").cast("long").alias("n"), "f.type", "f.severity", "f.raw")


def address_rule(docs: DataFrame, rule: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, raw, line of one address rule (0 labelled line, 1 street, 2 city and ZIP, 3 postal index), repeats included."""
    found = exploded(docs.select(doc_id, addresses(F.coalesce(F.col(text), F.lit(""))).alias("c")), doc_id, "c").filter(F.col("f.sub") == rule)
    return found.select(doc_id, F.col("f.line").cast("long").alias("line"), "f.raw")


def name_rule(docs: DataFrame, rule: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    found = docs.select(doc_id, F.posexplode(S.let(S.lines(F.coalesce(F.col(text), F.lit(""))), lambda own: _name_candidates(F.coalesce(F.col(text), F.lit("")), own)[rule])).alias("n", "raw"))
    return found.select(doc_id, F.col("n").cast("long").alias("n"), "raw")


# ---- the same numbering for findings that are a relation already ----


def renumber(rows: DataFrame, order: list, doc_id: str = "doc_id", prefix: str = "f") -> DataFrame:
    """id by place in the order, within a document."""
    n = F.row_number().over(Window.partitionBy(doc_id).orderBy(*order))
    return rows.withColumn("id", F.format_string(f"{prefix}_%02d", n))


def tokens(rows: DataFrame, order: list, doc_id: str = "doc_id", type_: str = "type", raw: str = "raw") -> DataFrame:
    """value_preview by family and first appearance of the value in its document; equal values share a token."""
    of_value = Window.partitionBy(doc_id, "_family", raw)
    place = F.row_number().over(Window.partitionBy(doc_id).orderBy(*order))
    numbered_ = rows.withColumn("_family", S.family(type_)).withColumn("_at", place).withColumn("_first", F.min("_at").over(of_value))
    n = F.dense_rank().over(Window.partitionBy(doc_id, "_family").orderBy("_first"))
    token = F.concat("_family", F.lit(" "), n.cast("string"))
    return numbered_.withColumn("value_preview", F.coalesce(token, S.mask(raw))).drop("_family", "_at", "_first")
