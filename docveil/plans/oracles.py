"""DuckDB SQL with the rows of the registered queries, written apart from the operators."""

from __future__ import annotations

from ..functions import fixed

from .fixtures import GENERATED, SAMPLES, VALUES


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def values(rows: list[tuple], *names: str) -> str:
    cell = lambda v: "NULL" if v is None else str(v) if isinstance(v, (bool, int, float)) else q(v)
    return f"(VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) AS t({', '.join(names)})"


DOCS = "SELECT doc_id, text FROM documents"
PAGES = "SELECT page_id AS doc_id, html AS text FROM pages"
OWN = f"SELECT doc_id, text FROM {values([(-1 - i, t) for i, t in enumerate(SAMPLES)], 'doc_id', 'text')}"
WHITE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def strip(x: str) -> str:
    return f"regexp_replace({x}, {q(f'^{WHITE}+|{WHITE}+$')}, '', 'g')"


def luhn(x: str) -> str:
    """Sum of digits from the right, every second one doubled and its digits added."""
    digit = f"CAST(substr(reverse({x}), i, 1) AS INTEGER)"
    return f"(list_sum(list_transform(range(1, length({x}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN {digit} WHEN {digit} > 4 THEN {digit} * 2 - 9 ELSE {digit} * 2 END)) % 10 = 0)"


MADE = f"SELECT -1000 - c_custkey AS doc_id, {GENERATED} AS text FROM customer"
#: RE2 knows ASCII words alone: a letter or digit of another script becomes a word character that no pattern names, other
#: white space a space, one character for one, so places stay
PLAIN = lambda x: f"regexp_replace(regexp_replace({x}, {q(r'[\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]')}, ' ', 'g'), '[^\\x00-\\x7f]', '_', 'g')"
BREAKS = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"


def ascii_pattern(pattern: str) -> str:
    return pattern.replace("(?iU)", "(?i)").replace("(?U)", "")


def matches(rows: str, columns: str, x: str, pattern: str) -> str:
    """columns, pos, raw: all matches of a pattern in x of rows. Matches are marked, so their places are known and raw is
    taken from x itself."""
    return f"""SELECT {columns}, pos, substr({x}, CAST(list_sum(list_transform(pieces[1:pos], lambda y: length(y))) - pos + 2 AS BIGINT), strpos(pieces[pos + 1], chr(2)) - 1) AS raw
 FROM (SELECT *, unnest(range(1, len(pieces))) AS pos FROM (SELECT {columns}, {x}, string_split(regexp_replace({PLAIN(x)}, {q(ascii_pattern(pattern))}, chr(1) || '\\0' || chr(2), 'g'), chr(1)) AS pieces FROM {rows}) WHERE len(pieces) > 1)"""


def verhoeff(x: str) -> str:
    """The check digit of twelve digits, by the tables of the dihedral group written out as products."""
    steps = "struct_pack(c := 0)"
    for i in range(12):
        digit = f"CAST(substr({x}, {12 - i}, 1) AS INTEGER)"
        steps = f"list_transform([{steps}], lambda s: struct_pack(c := {_TIMES}[s.c * 10 + {_POWERS[i % 8]}[{digit} + 1] + 1]))[1]"
    return f"({steps}.c = 0)"


_TURN = [1, 5, 7, 6, 2, 8, 3, 0, 9, 4]
_POWERS = [list(range(10))]
for _ in range(7):
    _POWERS.append([_TURN[x] for x in _POWERS[-1]])
#: products of two elements of the dihedral group of order ten: turns 0 to 4, flips 5 to 9
_TIMES = [((a + b) % 5 if a < 5 else (a - b) % 5 + 5) if b < 5 else ((a + b) % 5 + 5 if a < 5 else (a - b) % 5) for a in range(10) for b in range(10)]
SEP = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\-]"
ALL = ("EMAIL", "ADDRESS", "PHONE", "PAN", "AADHAAR", "CARD")


def walked(name: str, chain: str, sep: str, ends: str) -> str:
    """CTEs <name>_chains, <name>_walk, <name>: groups of digits, each a single separator from the next, matched from left to
    right; ends: the last group of a match from group i on (n: its digits up to group j, s: that string), or null."""
    last = f"(SELECT {ends} FROM (SELECT j, array_to_string(g[{{i}}:j], '') AS s, plus AND {{i}} = 1 AS signed, g[{{i}}] AS head, list_transform(range({{i}}, j), lambda k: CAST(list_sum(list_transform(g[{{i}}:k], lambda y: length(y))) AS BIGINT)) AS cuts FROM range({{i}}, least({{i}} + 18, len(g)) + 1) r(j)))"
    return rf"""{name}_chains AS (SELECT doc_id, chain, starts_with(s, '+') AS plus, regexp_extract_all(s, '[0-9]+') AS g, regexp_extract_all(s, {q(sep)}) AS seps FROM (SELECT doc_id, unnest(l) AS s, generate_subscripts(l, 1) AS chain FROM (SELECT doc_id, regexp_extract_all(text, {q(chain)}) AS l FROM d)) WHERE length(s) >= 10),
{name}_walk AS (
  SELECT doc_id, chain, plus, g, seps, 1 AS i, {last.format(i=1)} AS j FROM {name}_chains
  UNION ALL
  SELECT doc_id, chain, plus, g, seps, n, {last.format(i='n')} FROM (SELECT *, CAST(coalesce(j, i) + 1 AS INTEGER) AS n FROM {name}_walk) WHERE n <= len(g)
),
{name} AS (SELECT doc_id, chain * 1000000 + i AS pos, array_to_string(g[i:j], '') AS digits, array_to_string(list_transform(range(i, j + 1), lambda k: g[k] || CASE WHEN k < j THEN seps[k] ELSE '' END), '') AS bare, plus AND i = 1 AS signed FROM {name}_walk WHERE j IS NOT NULL)"""


def candidates(docs: str, only: tuple[str, ...] = ALL) -> str:
    """CTEs up to `c`: doc_id, rule, line, sub, pos, type, severity, raw."""
    flat = lambda pattern, group=0: f"SELECT doc_id, unnest(l) AS raw, generate_subscripts(l, 1) AS pos FROM (SELECT doc_id, regexp_extract_all(text, {q(pattern)}, {group}) AS l FROM d)"
    row = lambda rule, type_, severity, rest: f"SELECT doc_id, {rule} AS rule, 0 AS line, 0 AS sub, pos, '{type_}' AS type, '{severity}' AS severity, {rest}"
    # of several beginnings of a phone number, the first that leaves ten digits up to a group's end
    phone_ends = "coalesce(min(CASE WHEN signed AND length(s) = 12 AND starts_with(head, '91') THEN j END), min(CASE WHEN length(s) = 14 AND starts_with(head, '0091') THEN j END), min(CASE WHEN length(s) = 12 AND starts_with(head, '91') THEN j END), min(CASE WHEN length(s) = 11 AND starts_with(s, '0') AND length(head) > 1 THEN j END), min(CASE WHEN length(s) = 10 THEN j END))"
    card_ends = "max(CASE WHEN length(s) BETWEEN 13 AND 19 THEN j END)"
    aadhaar_ends = "max(CASE WHEN length(s) = 12 AND len(list_filter(cuts, lambda x: x NOT IN (4, 8))) = 0 THEN j END)"
    tables = {
        "EMAIL": f"emails AS ({flat(fixed.EMAIL)})",
        "PAN": rf"""pan_words AS ({flat(r'[\pL\pN_]+')}),
pans AS (SELECT * FROM pan_words WHERE regexp_matches(raw, '^[A-Z]{{5}}[0-9]{{4}}[A-Z]$'))""",
        "CARD": rf"""chains AS (SELECT doc_id, chain, regexp_extract_all(s, '[0-9]+') AS g, regexp_extract_all(s, '[ \-]') AS seps FROM (SELECT doc_id, unnest(l) AS s, generate_subscripts(l, 1) AS chain FROM (SELECT doc_id, regexp_extract_all(text, '[0-9](?:[ \-]?[0-9])*[ \-]?') AS l FROM d)) WHERE length(s) >= 13),
walk AS (
  SELECT doc_id, chain, g, seps, 1 AS i, (SELECT max(j) FROM range(1, len(g) + 1) r(j) WHERE list_sum(list_transform(g[1:j], lambda x: length(x))) BETWEEN 13 AND 19) AS j FROM chains
  UNION ALL
  SELECT doc_id, chain, g, seps, n, (SELECT max(j) FROM range(n, len(g) + 1) r(j) WHERE list_sum(list_transform(g[n:j], lambda x: length(x))) BETWEEN 13 AND 19)
  FROM (SELECT *, CAST(coalesce(j, i) + 1 AS INTEGER) AS n FROM walk) WHERE n <= len(g)
),
cards AS (SELECT doc_id, chain * 1000000 + i AS pos, array_to_string(g[i:j], '') AS digits, array_to_string(list_transform(range(i, j + 1), lambda k: g[k] || CASE WHEN k < j OR j = len(g) THEN coalesce(seps[k], '') ELSE '' END), '') AS raw FROM walk WHERE j IS NOT NULL)""",
        "PHONE": walked("phones", rf"\+?[0-9]+(?:{SEP}[0-9]+)*", SEP, phone_ends),
        "AADHAAR": walked("aadhaars", f"[0-9]+(?:{SEP}[0-9]+)*", SEP, aadhaar_ends),
        "ADDRESS": f"""own_lines AS MATERIALIZED ({lines('SELECT * FROM d')}),
free_lines AS MATERIALIZED (SELECT * FROM own_lines WHERE NOT regexp_matches(s, {q(ascii_pattern(fixed.ADDRESS_PREFIX))})),
addresses AS (SELECT doc_id, line, 0 AS sub, 1 AS pos, {strip(f'regexp_extract(s, {q(ascii_pattern(fixed.ADDRESS_PREFIX))}, 1)')} AS raw, 5 AS least FROM own_lines WHERE regexp_matches(s, {q(ascii_pattern(fixed.ADDRESS_PREFIX))})
 UNION ALL SELECT doc_id, line, 1, pos, regexp_replace({strip('raw')}, '[.,;]+$', ''), 8 FROM ({matches('free_lines', 'doc_id, line', 's', fixed.ADDRESS_STREET)})
 UNION ALL SELECT doc_id, line, 2, pos, {strip('raw')}, 8 FROM ({matches('free_lines', 'doc_id, line', 's', fixed.ADDRESS_ZIP)})
 UNION ALL SELECT doc_id, line, 3, pos, {strip('raw')}, 8 FROM ({matches('free_lines', 'doc_id, line', 's', fixed.ADDRESS_PIN)}))""",
    }
    bare_phone = "CASE WHEN length(digits) = 12 AND starts_with(digits, '91') THEN substr(digits, 3) WHEN length(digits) = 11 AND starts_with(digits, '0') THEN substr(digits, 2) ELSE digits END"
    rules = {
        "EMAIL": row(1, "EMAIL", "MEDIUM", "raw FROM emails"),
        "ADDRESS": "SELECT doc_id, 2 AS rule, line, sub, pos, 'ADDRESS' AS type, 'HIGH' AS severity, raw FROM addresses WHERE length(raw) >= least",
        "PHONE": row(3, "PHONE", "MEDIUM", f"CASE WHEN signed AND length(digits) = 12 AND starts_with(bare, '91') THEN '+' ELSE '' END || bare AS raw FROM phones WHERE regexp_matches({bare_phone}, '^[6-9][0-9]{{9}}$')"),
        # a word character of any script before or after makes it part of a longer word
        "PAN": row(4, "PAN", "HIGH", "raw FROM pans WHERE regexp_matches(raw, '^[A-Z]{3}[ABCFGHJKLPT][A-Z][0-9]{4}[A-Z]$') AND substr(raw, 6, 4) <> '0000'"),
        "AADHAAR": row(5, "AADHAAR", "CRITICAL", f"bare AS raw FROM aadhaars WHERE regexp_matches(digits, '^[2-9]') AND digits <> reverse(digits) AND {verhoeff('digits')}"),
        "CARD": row(6, "CARD", "CRITICAL", f"raw FROM cards WHERE {luhn('digits')}"),
    }
    return f"d AS MATERIALIZED ({docs}),\n" + ",\n".join(tables[t] for t in only) + f",\nc AS ({' UNION ALL '.join(rules[t] for t in only)})"


def once(docs: str, only=ALL) -> str:
    """CTEs up to `o`: c with each value once, n from 0 in the order of findings."""
    return f"{candidates(docs, only)}, firsts AS (SELECT *, row_number() OVER (PARTITION BY doc_id, raw ORDER BY rule, line, sub, pos) AS k FROM c), o AS (SELECT * EXCLUDE (k), row_number() OVER (PARTITION BY doc_id ORDER BY rule, line, sub, pos) - 1 AS n FROM firsts WHERE k = 1)"


def detected(docs: str, type_: str) -> str:
    return f"WITH RECURSIVE {once(docs, (type_,))} SELECT doc_id, n, {q(type_)} AS type, (SELECT max(severity) FROM c) AS severity, raw FROM o"


def lines(docs: str) -> str:
    return f"SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS line, s FROM (SELECT doc_id, k, {strip('s')} AS s FROM (SELECT doc_id, unnest(l) AS s, generate_subscripts(l, 1) AS k FROM (SELECT doc_id, regexp_split_to_array(text, {q(BREAKS)}) AS l FROM ({docs})))) WHERE s <> ''"


def valid_name(v: str) -> str:
    own = f"list_filter(list_transform(regexp_split_to_array({strip(v)}, '\\s+'), lambda w: trim(w, '.,;')), lambda w: w <> '')"
    barred = "[" + ", ".join(q(w) for w in [*fixed.JOB_WORDS, *fixed.ADDRESS_WORDS]) + "]"
    not_names = ", ".join(q(w) for w in fixed.NOT_NAMES)
    return f"(lower({strip(v)}) NOT IN ({not_names}) AND len({own}) BETWEEN 1 AND 4 AND NOT list_has_any(list_transform({own}, lambda w: lower(w)), {barred}) AND len(list_filter({own}, lambda w: NOT regexp_matches(w, '^[A-Z][a-zA-Z.\\-]*$'))) = 0)"


# prefixes for RE2, where Unicode classes are spelled out
PREFIX = ascii_pattern(fixed.ADDRESS_PREFIX)
NAME_PREFIX = ascii_pattern(fixed.NAME_PREFIX)


def names() -> str:
    """CTEs up to `names` (doc_id, n, raw) of the names in d: labelled, after an honorific, or alone on an early line."""
    labelled = f"SELECT doc_id, {strip(f'regexp_extract(s, {q(NAME_PREFIX)}, 1)')} AS raw FROM name_lines WHERE regexp_matches(s, {q(NAME_PREFIX)})"
    first_line = strip(f"regexp_extract(raw, {q('^[^' + chr(92) + 'n' + chr(92) + 'r]*')})")
    return f"""name_lines AS MATERIALIZED ({lines('SELECT * FROM d')}),
honorifics AS MATERIALIZED (SELECT doc_id, pos, {first_line} AS raw FROM ({matches('d', 'doc_id', 'text', fixed.NAME_HONORIFIC)})),
guessed AS (SELECT DISTINCT doc_id, raw FROM (SELECT doc_id, raw FROM ({labelled}) WHERE raw <> '' AND {valid_name('raw')} UNION ALL SELECT doc_id, raw FROM honorifics UNION ALL SELECT doc_id, s FROM name_lines WHERE line < 6 AND {valid_name('s')})),
anchored AS (SELECT DISTINCT doc_id, raw FROM (SELECT doc_id, {strip("CASE WHEN strpos(lower(text), lower(raw)) > 0 THEN substr(text, strpos(lower(text), lower(raw)), length(raw)) ELSE raw END")} AS raw FROM guessed JOIN d USING (doc_id)) WHERE raw <> ''),
names AS (SELECT x.doc_id, x.raw, row_number() OVER (PARTITION BY x.doc_id ORDER BY length(x.raw) DESC, strpos(text, x.raw), x.raw) - 1 AS n FROM anchored x JOIN d USING (doc_id) WHERE NOT EXISTS (SELECT 1 FROM anchored y WHERE y.doc_id = x.doc_id AND y.raw <> x.raw AND contains(y.raw, x.raw)))"""


FAMILY = "CASE type " + " ".join(f"WHEN {q(t)} THEN {q(v[3])}" for t, v in fixed.TYPES.items() if v[3]) + " END"
LABEL = "CASE type " + " ".join(f"WHEN {q(t)} THEN {q(v[0])}" for t, v in fixed.TYPES.items() if v[0]) + " ELSE 'REDACTED' END"
MATRIX = values([(t, i, a) for t, x in fixed.POLICY.items() for i, a in zip(fixed.INTENTS, x, strict=True)], "type", "intent", "action")
TEXTS = f"{DOCS} UNION ALL {OWN} UNION ALL {MADE}"


def found(docs: str) -> str:
    """CTEs up to `f`: the numbered findings of all detectors and names."""
    every = "every AS (SELECT doc_id, n, type, severity, raw FROM o UNION ALL SELECT names.doc_id, names.n + coalesce(k, 0), 'PERSON_NAME', 'MEDIUM', names.raw FROM names LEFT JOIN (SELECT doc_id, count(*) AS k FROM o GROUP BY doc_id) t ON t.doc_id = names.doc_id)"
    return f"{once(docs)}, {names()}, {every}, f AS MATERIALIZED (SELECT doc_id, n, printf('f_%02d', n + 1) AS id, type, 'text' AS location, 'visible' AS visibility, severity, sha256(raw) AS value_hash, {FAMILY} || ' ' || row_number() OVER (PARTITION BY doc_id, {FAMILY} ORDER BY n) AS value_preview, raw FROM every)"


F_CTE = found(TEXTS)


def decided(intent: str, extra: str = "", docs: str = TEXTS) -> str:
    """CTEs up to `g`: f with decision."""
    return f"{found(docs)}, m AS (SELECT * FROM {MATRIX}), g AS (SELECT f.*, CASE WHEN {q(intent)} = 'legal_hold' AND action = 'REMOVE' THEN 'KEEP' ELSE coalesce(action, 'WARN') END AS decision FROM f LEFT JOIN m ON f.type = m.type AND m.intent = {q(intent)}){extra}"


MASK = f"""SELECT v, CASE WHEN s = '' THEN '' WHEN contains(s, '@') AND NOT contains(s, ' ') THEN CASE WHEN strpos(s, '@') > 1 THEN s[1] || repeat('*', strpos(s, '@') - 2) ELSE '' END || substr(s, strpos(s, '@'))
 WHEN len(p) > 1 THEN array_to_string(list_transform(p, lambda w: w[1] || repeat('*', length(w) - 1)), ' ') WHEN length(s) <= 2 THEN repeat('*', length(s)) ELSE s[1] || repeat('*', length(s) - 2) || s[length(s)] END AS masked
FROM (SELECT v, s, list_filter(regexp_split_to_array(s, '\\s+'), lambda w: w <> '') AS p FROM (SELECT v, {strip('v')} AS s FROM {values([(v,) for v in VALUES], 'v')}))"""

OVERRIDDEN = "CASE WHEN n > 0 THEN decision WHEN doc_id % 3 = 0 THEN 'KEEP' WHEN doc_id % 5 = 0 THEN {remove} ELSE decision END"
#: values one after the other: by type, then as they were found
REPLACED = """, due AS (SELECT doc_id, list(struct_pack(raw := raw, repl := {repl}) ORDER BY list_position(['EMAIL', 'PHONE', 'PAN', 'AADHAAR', 'CARD', 'PERSON_NAME', 'ADDRESS', 'USER_SPECIFIED'], type), n) AS r FROM g WHERE decision = 'REMOVE' GROUP BY doc_id),
compiled AS (SELECT d.doc_id, d.text, CASE WHEN r IS NULL THEN d.text ELSE list_reduce(list_transform(r, lambda x: struct_pack(t := CAST(NULL AS VARCHAR), raw := x.raw, repl := x.repl)), lambda a, x: struct_pack(t := replace(a.t, x.raw, x.repl), raw := '', repl := ''), struct_pack(t := d.text, raw := '', repl := '')).t END AS output FROM d LEFT JOIN due USING (doc_id))"""
TOKEN, BLACK = f"'[' || {LABEL} || ']'", "repeat('█', greatest(3, length(raw)))"
HELD = lambda x: f"(contains({x}, raw) OR contains({x}, value_hash))"

GRID = "SELECT item_id AS doc_id, unnest(w) AS text, generate_subscripts(w, 1) - 1 AS word_no FROM (SELECT item_id, regexp_split_to_array(text, '[ \\n]+') AS w FROM benchmark)"
SURE = f"SELECT *, word_no // 15 AS block, (word_no // 5) % 3 AS line FROM ({GRID}) WHERE word_no % 11 <> 10 AND trim(text) <> ''"


_STEP = "CASE WHEN (c < 5) <> (p < 5) THEN 5 ELSE 0 END + (CASE WHEN c < 5 THEN c + p ELSE c - p + 10 END) % 5"

NORM = lambda x: f"regexp_replace(lower({x}), '[^a-z0-9]', '', 'g')"
#: CTEs up to `hit`: each value's first run of words that spells it (i, k), else the first word that holds it (one)
_HIT = """spelled AS (SELECT v.doc_id, v.id, v.raw, w, i, (SELECT min(k) FROM range(1, 31) r(k) WHERE i + k - 1 <= len(w) AND array_to_string(list_transform(w[i:i + k - 1], lambda y: y.n), '') = target) AS k, CASE WHEN contains(w[i].n, target) THEN i END AS one
 FROM (SELECT v.*, w, target, unnest(range(1, len(w) + 1)) AS i FROM (SELECT *, {norm} AS target FROM v) v JOIN line_up USING (doc_id) WHERE target <> '') v),
runs AS (SELECT doc_id, id, any_value(w) AS w, min(CASE WHEN k IS NOT NULL THEN i END) AS i, arg_min(k, CASE WHEN k IS NOT NULL THEN i END) AS k, min(one) AS one FROM spelled GROUP BY doc_id, id),
hit AS (SELECT v.doc_id, v.id, v.raw, w, i, k, one FROM v LEFT JOIN runs ON runs.doc_id = v.doc_id AND runs.id = v.id)""".replace("{norm}", NORM("raw"))
OCR_RUNS = f"""WITH line_up AS (SELECT doc_id, list(struct_pack(n := {NORM('text')}, box := [CAST(word_no % 5 * 10 AS INTEGER), CAST(word_no // 5 AS INTEGER), 9, 1]) ORDER BY word_no) AS w FROM ({SURE}) GROUP BY doc_id),
own AS (SELECT doc_id, list(text ORDER BY word_no) AS l FROM ({GRID}) GROUP BY doc_id),
v AS (SELECT doc_id, 'f_01' AS id, array_to_string(list_filter([l[3], l[4]], lambda x: x IS NOT NULL), ' ') AS raw FROM own UNION ALL SELECT doc_id, 'f_02', substr(l[1], 2, 3) FROM own UNION ALL SELECT doc_id, 'f_03', 'no such value' FROM own),
{_HIT}"""
_GENERATED_LINES = f"SELECT doc_id, ln, t FROM (SELECT doc_id, unnest(l) AS t, generate_subscripts(l, 1) - 1 AS ln FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM ({MADE})))"
_GENERATED_WORDS = f"SELECT doc_id, ln, ln * 100 + k - 1 AS word_no, text FROM (SELECT doc_id, ln, unnest(l) AS text, generate_subscripts(l, 1) AS k FROM (SELECT doc_id, ln, regexp_split_to_array(t, ' +') AS l FROM ({_GENERATED_LINES}))) WHERE text <> ''"
_READ = "SELECT doc_id, string_agg(gap || trim(text), '' ORDER BY word_no) AS text FROM (SELECT *, CASE WHEN p IS NULL THEN '' WHEN p <> ln THEN chr(10) ELSE ' ' END AS gap FROM (SELECT *, lag(ln) OVER (PARTITION BY doc_id ORDER BY word_no) AS p FROM gw)) GROUP BY doc_id"
IMAGE = f"""WITH RECURSIVE gw AS MATERIALIZED ({_GENERATED_WORDS}), {found(_READ)},
line_up AS (SELECT doc_id, list(struct_pack(n := {NORM('text')}) ORDER BY word_no) AS w FROM gw GROUP BY doc_id), v AS (SELECT doc_id, id, raw FROM f), {_HIT},
boxed AS (SELECT f.*, coalesce(k, CASE WHEN one IS NOT NULL THEN 1 END, 0) AS n_boxes FROM f JOIN hit USING (doc_id, id))"""
_PAGES = f"SELECT c_custkey AS doc_id, {GENERATED} AS text FROM customer WHERE c_custkey IN (SELECT item_id FROM benchmark)"
_PAGE_WORDS = "SELECT doc_id, unnest(regexp_split_to_array(text, '[ \\n]+')) AS w FROM d"
_I = "SELECT item_id AS doc_id FROM benchmark"
PDF = f"""WITH RECURSIVE {found(_PAGES)}, own AS ({_I}), gw AS MATERIALIZED ({_PAGE_WORDS}),
placed AS (SELECT f.doc_id, f.n, count(CASE WHEN w <> '' AND (w = raw OR (length(w) >= 4 AND (contains(raw, w) OR contains(w, raw)))) THEN 1 END) AS n_rects FROM f JOIN gw USING (doc_id) GROUP BY f.doc_id, f.n),
rows_ AS (
 SELECT doc_id, 0 AS rank, NULL AS page, 0 AS part, 1 AS n, 'REVISION_AUTHOR' AS type, 'pdf:DocInfo/Author' AS location, 'hidden' AS visibility, 'MEDIUM' AS severity, 'A. Uthor ' || doc_id % 3 AS raw, NULL AS shown, NULL AS scrub, 0 AS n_rects FROM own
 UNION ALL SELECT doc_id, 0, NULL, 0, 2, 'SOFTWARE_FINGERPRINT', 'pdf:DocInfo/Creator', 'hidden', 'LOW', 'Maker', NULL, NULL, 0 FROM own
 UNION ALL SELECT doc_id, 0, NULL, 0, 3, 'SOFTWARE_FINGERPRINT', 'pdf:DocInfo/Producer', 'hidden', 'LOW', 'Maker', NULL, NULL, 0 FROM own WHERE doc_id % 2 = 1
 UNION ALL SELECT doc_id, 0, NULL, 0, 4, 'SOFTWARE_FINGERPRINT', 'pdf:XMP', 'hidden', 'LOW', 'packet ' || doc_id, NULL, NULL, 0 FROM own
 UNION ALL SELECT doc_id, 1, NULL, 0, 1, 'EMBEDDED_OBJECT', 'pdf:embfile/a' || doc_id || '.csv', 'recoverable', 'HIGH', 'a' || doc_id || '.csv', NULL, 'attached_files', 0 FROM own WHERE doc_id % 3 = 0
 UNION ALL SELECT doc_id, 2, NULL, 0, 0, 'JAVASCRIPT', 'pdf:catalog/Names/JavaScript', 'hidden', 'HIGH', 'app.alert(1)', NULL, 'javascript', 0 FROM own WHERE doc_id % 5 = 0
 UNION ALL SELECT doc_id, 3, doc_id % 2, 0, 1, 'COMMENT', 'pdf:page' || (doc_id % 2 + 1) || '/annot', 'hidden', 'MEDIUM', CASE doc_id % 4 WHEN 0 THEN 'look' WHEN 1 THEN 'Bob: ' ELSE 'Bob: look' END, NULL, NULL, 0 FROM own
 UNION ALL SELECT doc_id, 3, 0, 1, 0, 'COVERED_TEXT', 'pdf:page1/covered', 'recoverable', 'CRITICAL', string_agg(text, ' ' ORDER BY word_no), NULL, NULL, 1 FROM ({GRID}) WHERE word_no < 2 GROUP BY doc_id
 UNION ALL SELECT f.doc_id, 3, 1, 2, f.n, f.type, 'pdf:page2', 'visible', f.severity, f.raw, NULL, NULL, placed.n_rects FROM f JOIN placed ON placed.doc_id = f.doc_id AND placed.n = f.n
 UNION ALL SELECT doc_id, 3, 0, 3, 7, 'EMBEDDED_IMAGE', 'pdf:page1/image', 'visible', 'LOW', CASE WHEN doc_id % 2 = 0 THEN 'ÿØé' ELSE 'pdf-image-7' END, '<image 640x480px>', NULL, 1 FROM own
 UNION ALL SELECT doc_id, 3, 1, 4, doc_id, 'FORM_FIELD', 'pdf:page2/field:' || CASE WHEN doc_id % 2 = 0 THEN 'Name' ELSE '?' END, 'visible', 'MEDIUM', 'filled', NULL, 'reset_fields', 0 FROM own WHERE doc_id % 3 <> 0),
placed_at AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY rank, page NULLS FIRST, part, n) AS k, {FAMILY} AS kin FROM rows_),
named AS (SELECT *, min(k) OVER (PARTITION BY doc_id, kin, raw) AS first_k FROM placed_at),
shown AS (SELECT doc_id, printf('f_%02d', k) AS id, type, location, visibility, severity, sha256(raw) AS value_hash, coalesce(shown, kin || ' ' || dense_rank() OVER (PARTITION BY doc_id, kin ORDER BY first_k)) AS value_preview, CAST(page AS BIGINT) AS page, scrub, n_rects FROM named)"""

ORACLES: dict[str, str] = {
    "checksums": f"""WITH RECURSIVE n AS (SELECT o_orderkey, lpad(CAST(o_orderkey AS VARCHAR), 12, '3') AS d FROM orders),
 w AS (SELECT o_orderkey, d, 0 AS i, 0 AS c FROM n UNION ALL SELECT o_orderkey, d, i + 1, {_STEP} FROM (SELECT *, {_POWERS}[i % 8 + 1][CAST(substr(d, 12 - i, 1) AS INTEGER) + 1] AS p FROM w) WHERE i < 12)
 SELECT o_orderkey, {luhn('d')} AS luhn, c = 0 AS verhoeff FROM w WHERE i = 12""",
    "flagship": f"WITH RECURSIVE {decided('public_sharing', REPLACED.format(repl=TOKEN), DOCS)}, named AS (SELECT * FROM {values([(t, v[1], v[2]) for t, v in fixed.TYPES.items()], 'type', 'label', 'description')}) SELECT doc_id, n, id, g.type, location, visibility, value_hash, value_preview, severity, decision, CASE WHEN decision = 'REMOVE' THEN NOT {HELD('output')} END AS removed, CASE WHEN decision = 'REMOVE' THEN {HELD('text')} END AS evidence, label, description FROM g JOIN compiled USING (doc_id) JOIN named ON named.type = g.type",
    "all_findings": f"WITH RECURSIVE {found(DOCS)} SELECT doc_id, n, id, type, value_hash, value_preview, severity FROM f",
    **{f"detect_{t.lower()}": detected(f"{DOCS} UNION ALL {MADE}", t) for t in ALL},
    **{f"detect_{t.lower()}_pages": detected(PAGES, t) for t in ("EMAIL", "CARD")},
    **{f"samples_{t.lower()}": detected(OWN, t) for t in ALL},
    "detect_address_prefix": f"SELECT doc_id, line, raw FROM (SELECT doc_id, line, {strip(f'regexp_extract(s, {q(PREFIX)}, 1)')} AS raw FROM ({lines(TEXTS)}) WHERE regexp_matches(s, {q(PREFIX)})) WHERE length(raw) >= 5",
    "name_prefix": f"SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line) - 1 AS n, raw FROM (SELECT doc_id, line, {strip(f'regexp_extract(s, {q(NAME_PREFIX)}, 1)')} AS raw FROM ({lines(TEXTS)}) WHERE regexp_matches(s, {q(NAME_PREFIX)})) WHERE raw <> '' AND {valid_name('raw')}",
    **{f"detect_address_{k}": f"WITH {candidates(TEXTS, ('ADDRESS',))} SELECT doc_id, line, raw FROM c WHERE sub = {i}" for i, k in ((1, "street"), (2, "zip"), (3, "pin"))},
    "name_honorific": f"WITH d AS MATERIALIZED ({TEXTS}), {names()} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS n, raw FROM honorifics",
    "name_dedup": f"WITH d AS MATERIALIZED ({TEXTS}), {names()} SELECT doc_id, n, 'PERSON_NAME' AS type, 'MEDIUM' AS severity, raw FROM names",
    "name_toplines": f"SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line) - 1 AS n, s AS raw FROM ({lines(TEXTS)}) WHERE line < 6 AND {valid_name('s')}",
    "text_findings": f"WITH RECURSIVE {F_CTE} SELECT doc_id, n, id, type, location, visibility, severity, value_hash, value_preview FROM f",
    "mask": MASK,
    "hash": "SELECT doc_id, sha256(text) AS value_hash FROM documents",
    "tokenize": """SELECT doc_id, o_orderkey, family || ' ' || dense_rank() OVER (PARTITION BY doc_id, family ORDER BY first_at) AS value_preview FROM (SELECT *, min(o_orderkey) OVER (PARTITION BY doc_id, family, raw) AS first_at
 FROM (SELECT o_custkey AS doc_id, o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'Email' ELSE 'Phone' END AS family, o_orderpriority AS raw FROM orders))""",
    "renumber": "SELECT o_custkey AS doc_id, o_orderkey, printf('f_%02d', row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)) AS id FROM orders",
    "type_info": f"SELECT * FROM {values([(t, v[0] or 'REDACTED', v[1], v[3], '[' + (v[0] or 'REDACTED') + ']', '███') for t, v in fixed.TYPES.items()] + [('NEW_KIND', 'REDACTED', 'New Kind', None, '[REDACTED]', '███')], 'type', 'category', 'label', 'family', 'token', 'blackbox')}",
    "needles": f"WITH v AS (SELECT * FROM {values([(v,) for v in VALUES], 'v')}), x AS (SELECT v, list_filter([lower(hex(encode(v))), CASE WHEN regexp_matches(v, '^[\\x00-\\xff]*$') THEN array_to_string(list_transform(range(1, length(v) + 1), lambda i: lower(printf('%02x', unicode(substr(v, i, 1))))), '') END, lower(hex(encode(sha256(v))))], lambda y: y <> '') AS l FROM v) SELECT v, unnest(l) AS needle, generate_subscripts(l, 1) - 1 AS n FROM x",
    "policy_matrix": f"SELECT * FROM {MATRIX}",
    **{f"decide_{i}": f"WITH RECURSIVE {decided(i)} SELECT doc_id, id, type, decision FROM g" for i in fixed.INTENTS},
    "decide_all": f"WITH RECURSIVE {F_CTE}, m AS (SELECT * FROM {MATRIX}) SELECT f.type, m.intent, m.action AS decision, count(*) AS n_findings FROM f JOIN m USING (type) GROUP BY ALL",
    "overrides": f"WITH RECURSIVE {decided('public_sharing')} SELECT doc_id, id, type, {OVERRIDDEN.format(remove=q('REMOVE'))} AS decision FROM g",
    "overrides_legal_hold": f"WITH RECURSIVE {decided('legal_hold')} SELECT doc_id, id, type, {OVERRIDDEN.format(remove=q('KEEP'))} AS decision FROM g",
    "judge_payload": f"WITH RECURSIVE {decided('internal_sharing')} SELECT doc_id, id, type, location, visibility, severity, value_hash, decision FROM g",
    "judge_clamp": f"WITH RECURSIVE {decided('internal_sharing')} SELECT doc_id, id, type, CASE WHEN decision = 'KEEP' AND doc_id % 2 = 0 THEN 'WARN' ELSE decision END AS decision, CASE WHEN doc_id % 3 = 0 THEN 'look again' ELSE '' END AS note FROM g",
    "custom_terms": """WITH t AS (SELECT * FROM (VALUES (0, 'the'), (1, 'der'), (2, 'Ananya Sharma'), (3, 'no such thing')) AS t(k, term))
 SELECT doc_id, printf('u_%02d', k + 1) AS id, 'text' AS location, CASE WHEN contains(text, term) THEN 'visible' ELSE 'recoverable' END AS visibility, sha256(term) AS value_hash, 'Your item ' || (k + 1) AS value_preview FROM documents, t""",
    "custom_terms_corpus": "WITH t AS (SELECT * FROM (VALUES ('the'), ('der'), ('Ananya Sharma'), ('no such thing')) AS t(term)) SELECT sha256(term) AS value_hash, CASE WHEN contains(text, term) THEN 'visible' ELSE 'recoverable' END AS visibility, count(*) AS n_documents FROM documents, t GROUP BY ALL",
    **{f"compile_{s}": f"WITH RECURSIVE {decided('public_sharing', REPLACED.format(repl=x))} SELECT doc_id, sha256(output) AS output_sha256 FROM compiled" for s, x in (("token", TOKEN), ("blackbox", BLACK))},
    "verify": f"WITH RECURSIVE {decided('public_sharing', REPLACED.format(repl=TOKEN))} SELECT doc_id, id, type, decision, CASE WHEN decision = 'REMOVE' THEN NOT {HELD('output')} END AS removed, CASE WHEN decision = 'REMOVE' THEN {HELD('text')} END AS evidence FROM g JOIN compiled USING (doc_id)",
    "verify_relation": f"WITH RECURSIVE {decided('public_sharing')} SELECT doc_id, id, decision, CASE WHEN decision = 'REMOVE' THEN NOT {HELD('text')} END AS removed FROM g JOIN d USING (doc_id)",
    "coverage": f"SELECT * FROM {values([(k, f'{k}.{c}', ok) for k, x in fixed.COVERAGE.items() for c, ok, _ in x], 'kind', 'category', 'checked')}",
    "unchecked": f"SELECT * FROM {values([(k, f'{k}.{c}') for k, x in fixed.COVERAGE.items() for c, ok, _ in x if not ok], 'kind', 'category')}",
    "own_coverage": f"SELECT * FROM {values([(k, f'{k}.{c}', ok and c not in fixed.OWN_COVERAGE[k]) for k, x in fixed.COVERAGE.items() for c, ok, _ in x], 'kind', 'category', 'checked')}",
    "report_by_type": f"WITH RECURSIVE {decided('public_sharing')} SELECT type, severity, decision, count(*) AS n_findings, count(DISTINCT doc_id) AS n_documents FROM g GROUP BY ALL",
    "report_cube": f"WITH RECURSIVE {decided('public_sharing')} SELECT type, severity, decision, count(*) AS n_findings, CAST(grouping(type, severity, decision) AS BIGINT) AS level FROM g GROUP BY CUBE (type, severity, decision)",
    "exif_diff": "SELECT * FROM (VALUES (1, '0th/Make', 'A', 'A', false), (1, 'GPS/GPSLatitude', '((1, 1),)', NULL, true), (1, '0th/Artist', '', NULL, false), (2, '0th/Model', NULL, 'B', true), (2, '0th/Software', 'x', 'y', true)) AS t(doc_id, tag, original, sanitized, changed)",
    "badges": "SELECT * FROM (VALUES ('REMOVE', true, false, '✓ byte-verified removed'), ('REMOVE', true, true, '✓ OCR-verified (visual)'), ('REMOVE', false, false, '✗ still present'), ('REMOVE', false, true, '✗ still legible'), ('REMOVE', NULL, NULL, '— not verified'), ('KEEP', NULL, NULL, '')) AS t(decision, removed, ocr, badge)",
    # the first dark box covers the first two words of a text, the second less than 60 % of the fourth
    "covered_text": f"SELECT doc_id, 0 AS page, 0 AS rect_no, string_agg(text, ' ' ORDER BY word_no) AS raw FROM ({GRID}) WHERE word_no < 2 GROUP BY doc_id",
    "locate": f"WITH w AS ({GRID}), v AS (SELECT doc_id, text AS raw FROM w WHERE word_no = 0) SELECT doc_id, raw, sum(CASE WHEN text <> '' AND (text = raw OR (length(text) >= 4 AND (contains(raw, text) OR contains(text, raw)))) THEN 1 ELSE 0 END) AS n_rects FROM v JOIN w USING (doc_id) GROUP BY doc_id, raw",
    "ocr_full_text": f"SELECT doc_id, string_agg(CASE WHEN p IS NULL THEN '' WHEN p <> (block, line) THEN chr(10) ELSE ' ' END || trim(text), '' ORDER BY word_no) AS text FROM (SELECT *, lag((block, line)) OVER (PARTITION BY doc_id ORDER BY word_no) AS p FROM ({SURE})) GROUP BY doc_id",
    "override_all": f"""WITH RECURSIVE {decided('public_sharing')} SELECT * FROM (SELECT 'REMOVE' AS choice, 'public_sharing' AS intent, 'REMOVE' AS decision, count(*) AS n_findings FROM g UNION ALL SELECT 'REMOVE', 'legal_hold', 'KEEP', count(*) FROM g
 UNION ALL SELECT 'KEEP', 'public_sharing', 'KEEP', count(*) FROM g UNION ALL SELECT 'SHRED', 'public_sharing', decision, count(*) FROM g GROUP BY decision)""",
    "pdf_plan": "SELECT * FROM (VALUES (1, '2 scrub javascript', NULL, NULL), (1, '3 delete comments', NULL, NULL), (1, '4 redact', 0, '[CARD NUMBER]')) AS t(doc_id, step, page, fill)",
    "ocr_boxes": f"""{OCR_RUNS} SELECT doc_id, id, raw, coalesce(CASE WHEN i IS NOT NULL THEN to_json(list_transform(w[i:i + k - 1], lambda y: y.box)) WHEN one IS NOT NULL THEN to_json([w[one].box]) END, '[]')::VARCHAR AS boxes FROM hit""",
    "ocr_verify": f"""{OCR_RUNS}, seen AS (SELECT doc_id, string_agg(n, '' ORDER BY word_no) AS s FROM (SELECT doc_id, word_no, {NORM('text')} AS n FROM ({SURE}) WHERE word_no % 3 = 0) GROUP BY doc_id)
 SELECT hit.doc_id, id, raw, CASE WHEN s IS NULL THEN NULL ELSE {NORM('raw')} <> '' AND NOT contains(s, {NORM('raw')}) END AS removed FROM hit LEFT JOIN seen USING (doc_id)""",
    "pdf_findings": f"{PDF} SELECT doc_id, id, type, location, visibility, severity, value_hash, value_preview, page, scrub, n_rects FROM shown",
    "pdf_drawable": f"{PDF} SELECT type, n_rects > 0 AS drawable, CASE WHEN n_rects > 0 THEN NULL WHEN page IS NOT NULL THEN 'region could not be located' ELSE 'metadata — not on the page' END AS reason, count(*) AS n_findings FROM shown GROUP BY ALL",
    "image_findings": f"{IMAGE} SELECT doc_id, n, id, type, severity, value_hash, value_preview, n_boxes FROM boxed",
    "image_plan": f"{IMAGE} SELECT doc_id, false AS strip_metadata, sum(n_boxes) AS n_boxes FROM boxed JOIN (SELECT * FROM {MATRIX}) m USING (type) WHERE intent = 'public_sharing' AND action = 'REMOVE' GROUP BY doc_id",
    "file_routing": """WITH x AS (SELECT page_id AS doc_id, lower(['.docx', '.PDF', '.jpg', '.jpeg', '.png', '.txt', ''][page_id % 7 + 1]) AS ext, 'a' || page_id || ['.docx', '.PDF', '.jpg', '.jpeg', '.png', '.txt', ''][page_id % 7 + 1] AS name FROM pages)
 SELECT doc_id, ext, CASE ext WHEN '.docx' THEN 'docx' WHEN '.pdf' THEN 'pdf' WHEN '.txt' THEN NULL WHEN '' THEN NULL ELSE 'image' END AS kind, CASE ext WHEN '.pdf' THEN 'application/pdf' WHEN '.jpg' THEN 'image/jpeg' WHEN '.jpeg' THEN 'image/jpeg' WHEN '.png' THEN 'image/png' ELSE 'application/octet-stream' END AS media_type, 'sanitized_' || name AS output_name FROM x""",
}

