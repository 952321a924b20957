"""Column functions: masks, labels, check digits, name rules and small geometry. All are native expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, also where body names it often or within a lambda."""
    return F.transform(F.array(value), body)[0]


def strip(x) -> Column:
    """Without white space at both ends, Unicode white space and separators included."""
    return F.regexp_replace(col(x), f"(?U)\\A{fixed.WHITE}+|{fixed.WHITE}+\\z", "")


def words(x) -> Column:
    return F.filter(F.split(col(x), f"(?U){fixed.WHITE}+"), lambda w: w != "")


def lines(x) -> Column:
    """Stripped lines that are not blank."""
    return F.filter(F.transform(F.split(col(x), fixed.LINE_BREAK), strip), lambda line: line != "")


def sha256_hex(x) -> Column:
    return F.sha2(F.encode(col(x), "UTF-8"), 256)


def stars(n) -> Column:
    return F.repeat(F.lit("*"), F.greatest(n, F.lit(0)).cast("int"))


def mask(x) -> Column:
    """A preview that shows first characters, and the last of a single long word; an e-mail keeps its domain."""
    v = strip(F.coalesce(col(x), F.lit("")))
    parts = words(v)
    at = F.instr(v, "@")
    initial = lambda w: F.concat(F.left(w, F.lit(1)), stars(F.char_length(w) - 1))
    local = F.substring(v, F.lit(1), at - 1)
    email = F.concat(F.when(at > 1, initial(local)).otherwise(F.lit("")), F.substring(v, at, F.char_length(v)))
    n = F.char_length(v)
    return (
        F.when(v == "", F.lit(""))
        .when((at > 0) & (F.instr(v, " ") == 0), email)
        .when(F.size(parts) > 1, F.array_join(F.transform(parts, initial), " "))
        .when(n <= 2, stars(n))
        .otherwise(F.concat(F.left(v, F.lit(1)), stars(n - 2), F.right(v, F.lit(1))))
    )


def _lookup(values: dict, key) -> Column:
    """null where a key has no value."""
    pairs = [F.lit(x) for k, v in values.items() if v is not None for x in (k, v)]
    return F.try_element_at(F.create_map(*pairs), col(key))


def category_label(type_) -> Column:
    return F.coalesce(_lookup({t: v[0] for t, v in fixed.TYPES.items()}, type_), F.lit("REDACTED"))


def type_label(type_) -> Column:
    return F.coalesce(_lookup({t: v[1] for t, v in fixed.TYPES.items()}, type_), F.initcap(F.replace(col(type_), F.lit("_"), F.lit(" "))))


def type_description(type_) -> Column:
    return F.coalesce(_lookup({t: v[2] for t, v in fixed.TYPES.items()}, type_), F.lit(""))


def family(type_) -> Column:
    return _lookup({t: v[3] for t, v in fixed.TYPES.items()}, type_)


def replacement(type_, raw, style: str) -> Column:
    if style == "blackbox":
        return F.repeat(F.lit("█"), F.greatest(F.lit(3), F.char_length(col(raw))))
    return F.concat(F.lit("["), category_label(type_), F.lit("]"))


def digits(x) -> Column:
    return F.regexp_replace(col(x), r"(?U)\D", "")


def valid_phone(raw) -> Column:
    """Ten digits that start with 6 to 9, after 91 of twelve digits or 0 of eleven."""
    d = digits(raw)
    n = F.char_length(d)
    d = F.when((n == 12) & d.startswith("91"), F.substring(d, 3, 10)).when((n == 11) & d.startswith("0"), F.substring(d, 2, 10)).otherwise(d)
    return d.rlike(r"\A[6-9][0-9]{9}\z")


def valid_card(raw) -> Column:
    d = digits(raw)
    return F.char_length(d).between(13, 19) & F.call_function("luhn_check", d)


def verhoeff(d) -> Column:
    """Whether the check digit at the end of a string of digits holds (dihedral group of order ten)."""
    turn = [1, 5, 7, 6, 2, 8, 3, 0, 9, 4]
    powers = [list(range(10))]
    for _ in range(7):
        powers.append([turn[x] for x in powers[-1]])
    table = F.array(*[F.lit(x) for row in powers for x in row])
    n = F.char_length(col(d))

    def step(c, i):
        digit = F.substring(col(d), n - i, F.lit(1)).cast("int")
        p = F.element_at(table, (F.pmod(i, F.lit(8)) * 10 + digit + 1).cast("int"))
        turned = F.pmod(F.when(c < 5, c + p).otherwise(c - p), F.lit(5))
        flipped = (c < 5) != (p < 5)
        return F.when(flipped, turned + 5).otherwise(turned).cast("int")

    # element_at and sequence need at least one digit
    return F.when(col(d).rlike(r"\A[0-9]+\z"), F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), step) == 0).otherwise(F.lit(False))


def valid_aadhaar(raw) -> Column:
    """Twelve digits, the first 2 to 9, no palindrome, Verhoeff check digit. The first two rules are public knowledge, not confirmed."""
    d = digits(raw)
    return d.rlike(r"\A[2-9][0-9]{11}\z") & (d != F.reverse(d)) & verhoeff(d)


def valid_pan(raw) -> Column:
    """The fourth letter names a kind of holder, the number isn't 0000. Public knowledge, not confirmed."""
    return col(raw).rlike(r"\A[A-Z]{3}[ABCFGHJKLPT][A-Z](?!0000)[0-9]{4}[A-Z]\z")


def valid_name(x) -> Column:
    """One to four capitalised words, none of them a job's or an address's, and no heading."""
    barred = F.array(*[F.lit(w) for w in [*fixed.JOB_WORDS, *fixed.ADDRESS_WORDS]])
    plain = lambda w: F.regexp_replace(w, r"\A[.,;]+|[.,;]+\z", "")
    fit = lambda own: F.size(own).between(1, 4) & F.forall(own, lambda w: w.rlike(r"\A[A-Z][a-zA-Z.\-]*\z")) & ~F.arrays_overlap(F.transform(own, F.lower), barred)
    return let(strip(x), lambda v: ~F.lower(v).isin(fixed.NOT_NAMES) & let(F.filter(F.transform(words(v), plain), lambda w: w != ""), fit))


def norm(x) -> Column:
    return F.regexp_replace(F.lower(col(x)), "[^a-z0-9]", "")


def luminance(r, g, b) -> Column:
    """1 (light) if a part is missing."""
    return F.coalesce(F.lit(0.2126) * col(r) + F.lit(0.7152) * col(g) + F.lit(0.0722) * col(b), F.lit(1.0))


def area(x0, y0, x1, y1) -> Column:
    return F.greatest(col(x1) - col(x0), F.lit(0.0)) * F.greatest(col(y1) - col(y0), F.lit(0.0))


def overlap_share(word: tuple, box: tuple) -> Column:
    """The share of a word's rectangle that lies in a box; both as (x0, y0, x1, y1)."""
    inside = area(F.greatest(col(word[0]), col(box[0])), F.greatest(col(word[1]), col(box[1])), F.least(col(word[2]), col(box[2])), F.least(col(word[3]), col(box[3])))
    own = area(*word)
    return F.when(own > 0, inside / own).otherwise(F.lit(0.0))


def degrees(d, m, s, ref) -> Column:
    value = col(d) + col(m) / 60.0 + col(s) / 3600.0
    return F.when(col(ref).isin("S", "W"), -value).otherwise(value)


def needles(raw) -> Column:
    """Byte strings that prove a value is still there: UTF-8, Latin-1 where it can be written so, and the hash's hex form."""
    raw = col(raw)
    latin = F.when(raw.rlike(r"\A[\x00-\xFF]*\z"), F.encode(F.regexp_replace(raw, r"[^\x00-\xFF]", "?"), "ISO-8859-1"))
    return F.filter(F.array(F.encode(raw, "UTF-8"), latin, F.encode(sha256_hex(raw), "UTF-8")), lambda n: n.isNotNull() & (F.length(n) > 0))


def any_of(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions)
