"""The driver queries as SQL for DuckDB, written as relations: joins, windows and recursion in place of array expressions."""

from __future__ import annotations

from quillframe.functions.geometry import CROP_ERRORS
from quillframe.functions.text import CARD_LABEL_WORDS, MONTHS, PASSPORT_LABEL_WORDS
from quillframe.operators.passport import COLUMNS, ZONE_FLAGS
from quillframe.operators.signatures import CARD_TYPES, PASSPORT, Block, DocumentType, Signature
from quillframe.plans import fixtures
from quillframe.plans.fixtures import ALPHABET, check_sum

#: Printed dates of orders in several forms, read by both engines.
PRINTED = """
SELECT o_orderkey, CASE o_orderkey % 6
    WHEN 0 THEN lpad(CAST(day(o_orderdate) AS STRING), 2, '0') || ' ' || m || ' ' || CAST(year(o_orderdate) AS STRING)
    WHEN 1 THEN CAST(day(o_orderdate) AS STRING) || ' noise/' || lower(m) || ' ' || substr(CAST(year(o_orderdate) AS STRING), 3, 2)
    WHEN 2 THEN '123 ' || m || ' 2001' WHEN 3 THEN CAST(day(o_orderdate) AS STRING) || ' ' || CAST(year(o_orderdate) AS STRING)
    WHEN 4 THEN '99 x ' || m || ' ' || m || ' 20' ELSE o_orderpriority || ' ' || m || ' 2001' END AS printed
FROM (SELECT *, substr('JANFEBMARAPRMAYJUNJULAUGSEPOCTNOVDEC', CAST(month(o_orderdate) * 3 - 2 AS INT), 3) AS m FROM {table}) o"""

#: Responses of a recognizer made from events: good, rejected, without a result, with uneven arrays.
BODIES = """
SELECT event_id AS doc_id, CASE event_id % 7
    WHEN 0 THEN '{"errorCode": 500, "errorMsg": "busy"}'
    WHEN 1 THEN '{"errorCode": 0}'
    WHEN 2 THEN '{"errorCode": 0, "result": {"ocrResults": [{"prunedResult": {"rec_texts": ["a", "b"], "rec_scores": [0.9], "rec_polys": [[[1, 2], [3, 2], [3, 4], [1, 4]]]}}]}}'
    ELSE '{"errorCode": 0, "result": {"ocrResults": [{"prunedResult": {"rec_texts": [" ' || event_type || ' ", "", "u' || CAST(user_id AS STRING) || '"], "rec_scores": [0.9' || CAST(event_id % 10 AS STRING) ||
         ', 0.99, 0.4' || CAST(event_id % 10 AS STRING) || '], "rec_polys": [[[1, 2], [30, 2], [' || CAST(event_id % 90 AS STRING) || ', 4], [1, 4]], [[0, 0], [1, 0], [1, 1], [0, 1]], [[1, 12], [30, 12], [31, 14], [1, 14]]]}}]}}' END AS body
FROM events"""


def _words(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _labelish(s: str, words) -> str:
    cleaned = f"list_filter(list_transform(string_split({s}, ' '), lambda w: regexp_replace(w, '[^A-Za-z]', '', 'g')), lambda w: w <> '')"
    return f"""(len(list_filter({cleaned}, lambda w: regexp_matches(w, '[a-z]') OR (len(w) > 1 AND NOT list_contains({_words(words)}, w)))) = 0
        AND len(list_filter({cleaned}, lambda w: len(w) > 1)) > 0)"""


def _groups(s: str) -> str:
    parts = f"list_filter(regexp_split_to_array(trim({s}), '[-./ ]'), lambda g: g <> '')"
    return f"(CASE WHEN len(list_filter({parts}, lambda g: NOT regexp_full_match(g, '\\p{{N}}+'))) = 0 THEN list_transform({parts}, lambda g: len(g)) ELSE [] END)"


def _shape(s: str, shape: str, options=()) -> str:
    g = _groups(s)
    return {
        "devanagari": f"(regexp_matches({s}, '[ऀ-ॿ]') AND NOT regexp_matches({s}, '\\p{{N}}'))",
        "lowercase": f"regexp_matches({s}, '[a-z]')",
        "identity_number": f"(len({g}) BETWEEN 3 AND 5 AND len(list_filter({g}, lambda x: x NOT BETWEEN 1 AND 4)) = 0 AND list_sum({g}) >= 6 AND {g} <> [4, 2, 2])",
        "date": f"({g} = [4, 2, 2])",
        "enum": f"list_contains({_words(options)}, trim({s}))",
    }[shape]


def _clean(s: str) -> str:
    return f"trim(trim(trim({s}), '*'))"


#: 500 pages below each other as one.
WIDE = "wide_lines AS (SELECT doc_id // 500 AS doc_id, kind, doc_id % 500 * 100 + det_no AS det_no, text, conf, lft, top + doc_id % 500 * 1000 AS top, wid FROM ocr_lines)"


def _pages(words, lines: str = "ocr_lines") -> str:
    """Lines, label groups, anchors, value rows and generic fields of all pages."""
    return f"""WITH RECURSIVE {fixtures.PAGES}, {WIDE},
usable AS (SELECT doc_id, kind, det_no, trim(text) AS text, CAST(conf / 1000.0 AS FLOAT) AS confidence, lft, top, lft + wid AS rgt, top + 20 AS bottom, 20 AS height FROM {lines} WHERE trim(text) <> '' AND conf >= 450),
flagged AS (SELECT *, {_labelish("text", words)} AS labelish, upper(text) AS up FROM usable),
l AS (
    SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY top, lft, det_no) - 1 AS n, labelish AND confidence >= 0.9::FLOAT AS is_label,
           confidence >= 0.75::FLOAT AND NOT (labelish AND confidence >= 0.9::FLOAT) AS is_value FROM flagged
),
touch AS (
    SELECT a.doc_id, a.n AS a, b.n AS b FROM l a JOIN l b USING (doc_id) WHERE a.is_label AND b.is_label AND a.top < b.bottom AND b.top < a.bottom
    AND greatest(b.lft - a.rgt, a.lft - b.rgt, 0) <= 2 * greatest(a.height, b.height)
),
reach AS (SELECT doc_id, n AS a, n AS b FROM l WHERE is_label UNION SELECT r.doc_id, r.a, t.b FROM reach r JOIN touch t ON r.doc_id = t.doc_id AND r.b = t.a),
member AS (SELECT doc_id, a AS n, min(b) AS g FROM reach GROUP BY doc_id, a),
box AS (
    SELECT doc_id, g, min(lft) AS lft, min(top) AS top, max(rgt) AS rgt, max(bottom) AS bottom, greatest(max(bottom) - min(top), 1) AS height, string_agg(text, ' ' ORDER BY lft, n) AS label
    FROM member JOIN l USING (doc_id, n) GROUP BY doc_id, g
),
anchor AS (
    SELECT b.doc_id, b.g, v.n, v.top - b.bottom AS gap, abs(v.lft - b.lft) AS distance, row_number() OVER (PARTITION BY b.doc_id, b.g ORDER BY v.top - b.bottom, abs(v.lft - b.lft), v.n) AS r
    FROM box b JOIN l v USING (doc_id) WHERE v.is_value AND v.top >= b.bottom - b.height // 2 AND v.top - b.bottom <= 4 * b.height AND abs(v.lft - b.lft) <= 120
),
vrow AS (
    SELECT a.doc_id, a.n AS anchor, string_agg(b.text, ' ' ORDER BY b.lft, b.n) AS value FROM l a JOIN l b USING (doc_id)
    WHERE a.is_value AND b.is_value AND abs(a.top + a.bottom - b.top - b.bottom) // 2 <= greatest(a.height, b.height) // 2
      AND greatest(b.lft - a.rgt, a.lft - b.rgt, 0) <= greatest(a.height, b.height) GROUP BY a.doc_id, a.n
),
made AS (
    SELECT doc_id, n AS pos, 0 AS k, {_clean("substr(text, 1, instr(text, ':') - 1)")} AS label, {_clean("substr(text, instr(text, ':') + 1)")} AS value FROM l WHERE instr(text, ':') > 0
    UNION ALL
    SELECT b.doc_id, b.g, 1, {_clean("b.label")}, {_clean("v.value")} FROM anchor a JOIN box b USING (doc_id, g) JOIN vrow v ON v.doc_id = a.doc_id AND v.anchor = a.n WHERE a.r = 1
),
generic AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos, k) - 1 AS field_no, label, value FROM made WHERE label <> '' AND value <> '')"""


def _values(rows) -> str:
    cell = lambda x: "NULL" if x is None else str(x) if isinstance(x, int) else f"'{x}'"
    return ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows)


def _types(types) -> str:
    """Types of pages, and the value that each keyword finds by its own line or the one below it, and by generic fields."""
    kinds = [(i, t.name, t.least) for i, t in enumerate(types)]
    keys = [(i, k) for i, t in enumerate(types) for k in t.keywords]
    fields = [(i, f, s.label) for i, t in enumerate(types) for f, s in enumerate(t.fields)]
    words = [(i, f, n, k) for i, t in enumerate(types) for f, s in enumerate(t.fields) for n, k in enumerate(s.keywords)]
    return f""",
kinds(ty, name, least) AS (VALUES {_values(kinds)}), keys(ty, kw) AS (VALUES {_values(keys)}), fields(ty, f, label) AS (VALUES {_values(fields)}), words(ty, f, k, kw) AS (VALUES {_values(words)}),
hits AS (SELECT doc_id, ty, count(DISTINCT kw) AS hits FROM l JOIN keys ON contains(up, upper(kw)) GROUP BY doc_id, ty),
typed AS (SELECT doc_id, min(ty) AS ty FROM hits JOIN kinds USING (ty) WHERE hits >= least GROUP BY doc_id),
lab AS (SELECT doc_id, ty, f, k, kw, min(n) AS n FROM typed JOIN words USING (ty) JOIN l USING (doc_id) WHERE contains(up, kw) GROUP BY ALL),
labl AS (SELECT lab.*, text, lft, bottom, height, CASE WHEN instr(text, ':') > 0 THEN trim(substr(text, instr(text, ':') + 1)) ELSE '' END AS after FROM lab JOIN l USING (doc_id, n)),
below AS (
    SELECT b.doc_id, b.ty, b.f, b.k, v.text, row_number() OVER (PARTITION BY b.doc_id, b.ty, b.f, b.k ORDER BY v.top - b.bottom, v.n) AS r
    FROM labl b JOIN l v ON v.doc_id = b.doc_id AND v.n <> b.n AND v.top >= b.bottom - b.height // 2 AND NOT v.labelish AND abs(v.lft - b.lft) <= 240
),
relaxed AS (SELECT b.doc_id, b.ty, b.f, b.k, CASE WHEN b.after <> '' THEN b.after ELSE w.text END AS value FROM labl b LEFT JOIN below w ON w.doc_id = b.doc_id AND w.ty = b.ty AND w.f = b.f AND w.k = b.k AND w.r = 1),
strict AS (SELECT doc_id, ty, f, k, arg_min(value, field_no) AS value FROM typed JOIN words USING (ty) JOIN generic USING (doc_id) WHERE contains(label, kw) GROUP BY ALL)"""


def _blocks(types) -> str:
    rows = [(i, f, s.block.label, s.block.stop, s.block.shape, s.block.join, s.label) for i, t in enumerate(types) for f, s in enumerate(t.fields) if s.block]
    shape = " ".join(f"WHEN '{x}' THEN {_shape('text', x)}" for x in ("devanagari", "lowercase", "identity_number", "date"))
    return f""",
blocks(ty, f, a, z, shape, how, label) AS (VALUES {_values(rows)}),
start AS (SELECT doc_id, b.ty, b.f, min(n) AS s FROM blocks b JOIN l ON contains(text, a) GROUP BY ALL),
stop AS (SELECT s.doc_id, s.ty, s.f, any_value(s.s) AS s, coalesce(min(l.n), 1000000) AS e FROM start s JOIN blocks b USING (ty, f) LEFT JOIN l ON l.doc_id = s.doc_id AND l.n > s.s AND contains(l.text, b.z) GROUP BY ALL),
inside AS (SELECT p.doc_id, p.ty, p.f, l.n, l.lft, l.text, b.how FROM stop p JOIN blocks b USING (ty, f) JOIN l ON l.doc_id = p.doc_id AND l.n > p.s AND l.n < p.e WHERE CASE b.shape {shape} END),
firsts AS (SELECT doc_id, ty, f, how, text, min(n) AS n, min(lft) AS lft FROM inside WHERE how = 'unique' GROUP BY ALL),
block AS (
    SELECT doc_id, ty, f, string_agg(text, ' / ' ORDER BY n) AS text FROM firsts GROUP BY ALL
    UNION ALL SELECT doc_id, ty, f, string_agg(text, ' ' ORDER BY lft, n) FROM inside WHERE how = 'concat' GROUP BY ALL
)"""


#: A type that callers bring.
INVOICE = DocumentType("invoice", ("invoice", "Total"), 2, (Signature("SUM", ("TOTAL",)), Signature("TO", ("NAME",)), Signature("DAY", (), None, "date"), Signature("BLOCK", (), Block("NUMBER", "DATE OF BIRTH", "lowercase", "concat"))))


def _card_fields(types=CARD_TYPES) -> str:
    shapes = [(i, f, s) for i, t in enumerate(types) for f, s in enumerate(t.fields) if s.shape]
    scans = " UNION ALL ".join(f"SELECT doc_id, {i} AS ty, {f} AS f, n, text FROM typed JOIN l USING (doc_id) WHERE ty = {i} AND {_shape('text', s.shape, s.options)}" for i, f, s in shapes)
    return f"""{_pages(CARD_LABEL_WORDS)}{_types(types)}{_blocks(types)},
keyed AS (SELECT doc_id, ty, f, k, coalesce(s.value, r.value) AS value FROM strict s FULL JOIN relaxed r USING (doc_id, ty, f, k)),
used AS (SELECT doc_id, ty, f, text FROM inside UNION SELECT doc_id, ty, f, value FROM keyed WHERE value IS NOT NULL),
scans AS ({scans}),
free AS (SELECT doc_id, ty, f, text, min(n) AS n FROM scans s WHERE NOT EXISTS (SELECT 1 FROM used u WHERE u.doc_id = s.doc_id AND u.ty = s.ty AND u.f <= s.f AND u.text = s.text) GROUP BY ALL),
parts AS (
    SELECT b.doc_id, b.ty, b.f, 0 AS k, b.text FROM block b JOIN typed t ON t.doc_id = b.doc_id AND t.ty = b.ty
    UNION ALL SELECT doc_id, ty, f, 1 + k, value FROM keyed WHERE value IS NOT NULL
    UNION ALL SELECT doc_id, ty, f, 99, string_agg(text, ' / ' ORDER BY n) FROM free GROUP BY doc_id, ty, f
),
once AS (SELECT doc_id, ty, f, trim(text) AS text, min((CASE WHEN regexp_matches(text, '[ऀ-ॿ]') THEN 0 ELSE 1000 END) + k) AS k FROM parts WHERE trim(text) <> '' GROUP BY ALL),
joined AS (SELECT doc_id, ty, f, {_clean("string_agg(text, ' / ' ORDER BY k)")} AS value FROM once GROUP BY doc_id, ty, f)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY f) - 1)::INT AS field_no, label, value FROM joined JOIN fields USING (ty, f) WHERE value <> ''
UNION ALL SELECT doc_id, field_no::INT, label, value FROM generic WHERE doc_id NOT IN (SELECT doc_id FROM typed)"""


def _passport_rows() -> str:
    return f"""{_pages(PASSPORT_LABEL_WORDS)}{_types((PASSPORT,))},
keyed AS (SELECT doc_id, f, {_clean("coalesce(r.value, s.value)")} AS value FROM relaxed r FULL JOIN strict s USING (doc_id, ty, f, k)),
printed AS (
    SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY f) - 1)::INT AS field_no, label, value FROM keyed JOIN fields USING (f) WHERE value <> ''
    UNION ALL SELECT doc_id, field_no::INT, label, value FROM generic WHERE doc_id NOT IN (SELECT doc_id FROM typed)
)"""


def _date_parts(s: str) -> str:
    t = f"list_filter(regexp_split_to_array({s}, '[\\s/]+'), lambda w: w <> '')"
    months = _words(MONTHS)
    found = f"list_filter(list_transform({t}[2:len({t}) - 1], lambda w: list_position({months}, upper(w))), lambda m: m > 0)"
    ok = f"(len({t}) >= 3 AND regexp_full_match({t}[1], '[0-9]{{1,2}}') AND regexp_full_match({t}[len({t})], '[0-9]{{2}}|[0-9]{{4}}') AND len({found}) > 0)"
    year = f"(CASE WHEN len({t}[len({t})]) = 2 THEN '20' ELSE '' END || {t}[len({t})])"
    iso = f"({year} || '-' || lpad(({found}[1])::VARCHAR, 2, '0') || '-' || lpad({t}[1], 2, '0'))"
    return f"coalesce({ok}, false)", iso


def _zone_date(s: str) -> str:
    good = f"regexp_full_match({s}, '[0-9]{{2}}(0[1-9]|1[0-2])(0[1-9]|[12][0-9]|3[01])')"
    year = f"(CASE WHEN 2000 + substr({s}, 1, 2)::INT > 2035 THEN 1900 ELSE 2000 END + substr({s}, 1, 2)::INT)"
    return f"(CASE WHEN {good} THEN {year} || '-' || substr({s}, 3, 2) || '-' || substr({s}, 5, 2) ELSE {s} END)"


def _past(iso: str) -> str:
    return f"(regexp_full_match({iso}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') AND {iso} < '2025-01-01')"


def _name(s: str) -> str:
    return f"array_to_string(list_filter(string_split(split_part({s}, '<<', 1), '<'), lambda x: trim(x) <> ''), ' ')"


def _verify(field: str, check: str, n: int) -> str:
    return f"({check} = '<' OR {check} = {check_sum(field, n)}::VARCHAR)"


_NAMES = "substr(line1, 6)"
_SURNAME = f"CASE WHEN instr({_NAMES}, '<<') > 0 THEN substr({_NAMES}, 1, instr({_NAMES}, '<<') - 1) ELSE {_NAMES} END"
_GIVEN = f"CASE WHEN instr({_NAMES}, '<<') > 0 THEN substr({_NAMES}, instr({_NAMES}, '<<') + 2) ELSE '' END"
_ZONE = {
    "document_type": "trim(substr(line1, 1, 2), '<')",
    "issuing_country": "trim(substr(line1, 3, 3), '<')",
    "surname": _name(f"({_SURNAME})"),
    "given_names": _name(f"({_GIVEN})"),
    "passport_number": "trim(substr(line2, 1, 9), '<')",
    "nationality": "trim(substr(line2, 11, 3), '<')",
    "date_of_birth": _zone_date("substr(line2, 14, 6)"),
    "sex": "CASE WHEN substr(line2, 21, 1) IN ('M', 'F') THEN substr(line2, 21, 1) ELSE 'X' END",
    "date_of_expiry": _zone_date("substr(line2, 22, 6)"),
    "personal_number": "trim(substr(line2, 29, 14), '<')",
    "expired": _past(_zone_date("substr(line2, 22, 6)")),
    "passport_number_check_ok": _verify("line2", "substr(line2, 10, 1)", 9),
    "date_of_birth_check_ok": _verify("substr(line2, 14, 6)", "substr(line2, 20, 1)", 6),
    "date_of_expiry_check_ok": _verify("substr(line2, 22, 6)", "substr(line2, 28, 1)", 6),
    "personal_number_check_ok": _verify("substr(line2, 29, 14)", "substr(line2, 43, 1)", 14),
    "composite_check_ok": _verify("(substr(line2, 1, 10) || substr(line2, 14, 7) || substr(line2, 22, 22))", "substr(line2, 44, 1)", 39),
}


def _zones(*columns: str) -> str:
    return f"WITH {fixtures.ZONES} SELECT doc_id, " + ", ".join(f"{_ZONE[c]} AS {c}" for c in columns) + " FROM zones"


def _normalized(s: str) -> str:
    return f"regexp_replace(translate({s}, 'abcdefghijklmnopqrstuvwxyz _«‹', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ<<<<'), '[^A-Z0-9<]', '', 'g')"


def _passport_document() -> str:
    texts = ("document_type", "issuing_country", "surname", "given_names", "passport_number", "nationality", "date_of_birth", "sex", "date_of_expiry")
    flags = [c for c in _ZONE if c == "expired" or c.endswith("_ok")]
    is_date, iso = _date_parts("text")
    _, issued = _date_parts("issue")
    ok, _ = _date_parts("issue")
    return f"""{_passport_rows()},
cand AS (SELECT doc_id, {_normalized("text")} AS z, row_number() OVER (PARTITION BY doc_id ORDER BY top DESC, n DESC) AS r FROM l WHERE len({_normalized("text")}) BETWEEN 38 AND 50),
two AS (SELECT a.doc_id, rpad(a.z, 44, '<') AS line1, rpad(b.z, 44, '<') AS line2 FROM cand a JOIN cand b ON a.doc_id = b.doc_id AND a.r = 2 AND b.r = 1),
zone AS (SELECT doc_id, {", ".join(f"{e} AS {c}" for c, e in _ZONE.items())} FROM two),
dates AS (SELECT doc_id, list(trim(text) ORDER BY n) AS d FROM l WHERE {is_date} GROUP BY doc_id),
doc AS (SELECT DISTINCT doc_id FROM ocr_lines),
issue AS (
    SELECT doc.doc_id, coalesce((SELECT first(value ORDER BY field_no) FROM printed p WHERE p.doc_id = doc.doc_id AND label = 'DATE OF ISSUE'), CASE WHEN len(d) = 3 THEN d[2] END) AS issue,
           (SELECT first(value ORDER BY field_no) FROM printed p WHERE p.doc_id = doc.doc_id AND label = 'CITIZENSHIP NUMBER') AS citizen
    FROM doc LEFT JOIN dates USING (doc_id)
)
SELECT doc_id, {", ".join(f"coalesce({c}, '') AS {c}" for c in texts)}, coalesce(array_to_string(list_filter([given_names, surname], lambda x: x <> ''), ' '), '') AS full_name,
       coalesce(CASE WHEN {ok} THEN {issued} ELSE issue END, '') AS date_of_issue, coalesce(citizen, personal_number, '') AS personal_number, {", ".join(f"coalesce({c}, false) AS {c}" for c in flags)}
FROM issue LEFT JOIN zone USING (doc_id)"""


_IS_DATE, _ISO = _date_parts("printed")


def _dist(a: int, b: int) -> str:
    return f"sqrt(((x{a} - x{b}) * (x{a} - x{b}) + (y{a} - y{b}) * (y{a} - y{b}))::DOUBLE)"


_W, _H = f"greatest({_dist(2, 3)}, {_dist(1, 0)})", f"greatest({_dist(1, 2)}, {_dist(0, 3)})"
_AREA = "abs(" + " + ".join(f"(x{i} * y{(i + 1) % 4} - x{(i + 1) % 4} * y{i})" for i in range(4)) + ")"
_OUTSIDE = " OR ".join(f"x{i} < 0 OR y{i} < 0 OR x{i} > (width - 1)::FLOAT OR y{i} > (height - 1)::FLOAT" for i in range(4))


def _corner(key: str, last: bool) -> str:
    """The number of the corner with the least (first) or greatest (last) key."""
    keys = [f"({key.format(i)})" for i in range(4)]
    if last:
        return f"(CASE greatest({', '.join(keys)}) " + " ".join(f"WHEN {keys[i]} THEN {i}" for i in (3, 2, 1, 0)) + " END)"
    return f"(CASE least({', '.join(keys)}) " + " ".join(f"WHEN {keys[i]} THEN {i}" for i in range(4)) + " END)"


def _quad_order() -> str:
    picks = [_corner("x{0} + y{0}", False), _corner("x{0} - y{0}", True), _corner("x{0} + y{0}", True), _corner("x{0} - y{0}", False)]
    cells = ", ".join(f"round(([{a}0, {a}1, {a}2, {a}3])[{p} + 1]::DOUBLE * 1000)::BIGINT AS {a}{i}" for i, p in enumerate(picks) for a in "xy")
    return f"WITH {fixtures.QUADS} SELECT doc_id, {cells} FROM quads"


def _quad_expand() -> str:
    def cell(a: str, i: int, size: str) -> str:
        c = f"(({a}0 + {a}1 + {a}2 + {a}3) / 4::FLOAT)::FLOAT"
        return f"round(least(greatest(({c} + ({a}{i} - {c}) * (1::FLOAT + 0.025::FLOAT))::FLOAT, 0::FLOAT), {size}::FLOAT - 1::FLOAT)::DOUBLE * 10)::BIGINT AS {a}{i}"

    return f"WITH {fixtures.QUADS} SELECT doc_id, " + ", ".join(cell(a, i, s) for i in range(4) for a, s in (("x", "width"), ("y", "height"))) + " FROM quads"


def _detector(most: int, name: str) -> str:
    ratio = "(CASE WHEN least(h, w) < 64 THEN 64.0::DOUBLE / least(h, w) ELSE 1.0::DOUBLE END)"
    g = lambda v: f"trunc({v} * {ratio})::INT"
    top = f"greatest({g('h')}, {g('w')})"
    cut = lambda v: f"(CASE WHEN {top} > {most} THEN trunc({g(v)} * ({most}::DOUBLE / {top}))::INT ELSE {g(v)} END)"
    return ", ".join(f"greatest((floor({cut(v)} / 32.0::DOUBLE + 0.5) * 32)::INT, 32) AS {name}_{v}" for v in "hw")


def _passport_json() -> str:
    cells = " || ',' || ".join(f"""'"{c}":' || """ + (f"to_json({c})::VARCHAR" if c not in ZONE_FLAGS else f"{c}::VARCHAR") for c in COLUMNS)
    return f"SELECT doc_id, '{{' || {cells} || '}}' AS body FROM ({_passport_document()})"


def _fields_json() -> str:
    one = """'{"label":' || to_json(label)::VARCHAR || ',"value":' || to_json(value)::VARCHAR || '}'"""
    return f"""WITH f AS ({_card_fields()}), {fixtures.PAGES}, d AS (SELECT DISTINCT doc_id FROM ocr_lines)
        SELECT doc_id, '{{"fields":[' || coalesce(string_agg({one}, ',' ORDER BY field_no) FILTER (label IS NOT NULL), '') || ']}}' AS body FROM d LEFT JOIN f USING (doc_id) GROUP BY doc_id"""


#: Multipart requests, of which some have no part, an empty one, or parts of any name; crops with ties; an image's bytes as text.
PARTS = """SELECT l_orderkey AS request_id, CASE WHEN l_orderkey % 23 <> 0 THEN CAST(l_linenumber * 2 AS INT) END AS part_no, CASE WHEN l_partkey % 4 = 0 THEN 'image' ELSE 'part' || CAST(l_partkey % 3 AS STRING) END AS name,
    CASE WHEN l_suppkey % 5 = 0 THEN '' WHEN l_orderkey % 23 <> 0 THEN CAST(l_partkey AS STRING) || l_returnflag END AS body FROM lineitem"""
#: The same, with lines in some parts that merely begin like a delimiter.
PARTS_SENT = f"SELECT request_id, part_no, name, CASE WHEN part_no % 3 = 1 AND body <> '' THEN body || chr(13) || chr(10) || '--B' || CAST(request_id % 7 AS STRING) || 'x' ELSE coalesce(body, '') END AS body FROM ({PARTS}) p"
CROPS = "SELECT user_id AS id, CAST(event_id * 7 % 40 AS INT) AS crop_no, event_type || CAST(event_id % 5 AS STRING) AS body FROM events"

_GROW = "(CASE WHEN w + h > 0 THEN (w * h * 1.5::FLOAT / (2::FLOAT * (w + h)))::FLOAT ELSE 0::FLOAT END)"
_LINES = f"WITH {fixtures.PAGES}"

ORACLE = {
    "mrz_roundtrip": _zones("document_type", "issuing_country", "passport_number", "nationality", "sex", "personal_number", *(c for c in _ZONE if c.endswith("_ok"))),
    "mrz_names": _zones("surname", "given_names"),
    "mrz_dates": _zones("date_of_birth", "date_of_expiry", "expired"),
    "check_digits": f"WITH {fixtures.ZONES} SELECT doc_id, {check_sum('line2', 44)}::INT AS digit, {check_sum('line2', 9)}::INT AS number_digit FROM zones",
    "mrz_candidates": f"""
        WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents), e AS (SELECT doc_id, unnest(range(0, len(x))) AS line_no, unnest(x) AS line FROM d),
        n AS (SELECT doc_id, line_no, {_normalized("line")} AS z FROM e)
        SELECT doc_id, line_no, rpad(z, 44, '<') AS zone_line FROM n WHERE len(z) BETWEEN 38 AND 50""",
    "shape_profile": f"{_LINES} SELECT kind, det_no, "
    + ", ".join(f"sum({_shape('text', s)}::INT)::BIGINT AS {s}" for s in ("devanagari", "lowercase", "identity_number", "date"))
    + f", sum({_shape('text', 'enum', CARD_TYPES[0].fields[5].options)}::INT)::BIGINT AS sex_marker FROM ocr_lines GROUP BY ALL",
    "label_words": f"{_LINES} SELECT doc_id, det_no, {_labelish('text', CARD_LABEL_WORDS)} AS labelish, {_labelish('text', CARD_LABEL_WORDS)} AND conf >= 900 AS is_label, {_labelish('text', PASSPORT_LABEL_WORDS)} AS passport_labelish FROM ocr_lines",
    "inline_fields": f"{_LINES}, f AS (SELECT doc_id, det_no, {_clean(chr(115) + 'ubstr(text, 1, instr(text, chr(58)) - 1)')} AS label, {_clean('substr(text, instr(text, chr(58)) + 1)')} AS value FROM ocr_lines WHERE instr(text, chr(58)) > 0) SELECT * FROM f WHERE label <> '' AND value <> ''",
    "reading_order": f"{_pages(CARD_LABEL_WORDS)} SELECT doc_id, n::INT AS line_no, text, lft AS left, top, rgt AS right, bottom, height FROM l",
    "label_components": f"{_pages(CARD_LABEL_WORDS)} SELECT doc_id, n::INT AS line_no, g::INT AS group_no FROM member",
    "nearest_below": f"{_pages(CARD_LABEL_WORDS)} SELECT doc_id, g::INT AS group_no, n::INT AS anchor, gap, distance FROM anchor WHERE r = 1",
    "same_row_values": f"{_pages(CARD_LABEL_WORDS)} SELECT doc_id, anchor::INT AS anchor, value FROM vrow",
    "generic_fields": f"{_pages(CARD_LABEL_WORDS)} SELECT doc_id, field_no::INT AS field_no, label, value FROM generic",
    "detect_type": f"""{_pages(CARD_LABEL_WORDS)}{_types((*CARD_TYPES, PASSPORT))},
        h AS (SELECT doc_id, {", ".join(f"coalesce(max(hits) FILTER (ty = {i}), 0)::INT AS {t.name}_hits" for i, t in enumerate((*CARD_TYPES, PASSPORT)))} FROM (SELECT DISTINCT doc_id FROM ocr_lines) LEFT JOIN hits USING (doc_id) GROUP BY doc_id)
        SELECT doc_id, CASE {" ".join(f"WHEN {t.name}_hits >= {t.least} THEN '{t.name}'" for t in CARD_TYPES)} ELSE 'none' END AS type, * EXCLUDE (doc_id) FROM h""",
    "block_scan": f"{_pages(CARD_LABEL_WORDS)}{_blocks(CARD_TYPES)} SELECT doc_id, label, block.text AS value FROM block JOIN blocks USING (ty, f) WHERE block.text <> ''",
    "card_fields": _card_fields(),
    "typed_fields": _card_fields((*CARD_TYPES, INVOICE)),
    "typed_fields_joined": _card_fields((*CARD_TYPES, INVOICE)),
    "passport_fields": f"{_passport_rows()} SELECT * FROM printed",
    "passport_document": _passport_document(),
    "print_dates": f"WITH p AS ({PRINTED.format(table='orders')}) SELECT o_orderkey, {_IS_DATE} AS is_date, CASE WHEN {_IS_DATE} THEN {_ISO} ELSE printed END AS iso FROM p",
    "quad_order": _quad_order(),
    "quad_expand": _quad_expand(),
    "crop_validate": f"""WITH {fixtures.QUADS} SELECT doc_id, CASE WHEN {_OUTSIDE} THEN '{CROP_ERRORS[0]}' WHEN {_W} < 2 OR {_H} < 2 THEN '{CROP_ERRORS[1]}'
        WHEN {_W} > 16384 OR {_H} > 16384 THEN '{CROP_ERRORS[2]}' WHEN {_AREA} < 4::FLOAT THEN '{CROP_ERRORS[3]}' ELSE 'ok' END AS verdict,
        greatest(floor({_W} + 0.5)::INT, 1) AS crop_width, greatest(floor({_H} + 0.5)::INT, 1) AS crop_height, trunc({_AREA})::BIGINT AS twice_area FROM quads""",
    "det_resize": f"WITH s AS (SELECT p_partkey, (p_partkey * 37 % 5000 + 20)::INT AS h, (p_size * 131 % 6000 + 20)::INT AS w FROM part) SELECT p_partkey, {_detector(4000, 'card')}, {_detector(1600, 'passport')}, least(greatest(floor(w * 48.0::DOUBLE / h + 0.5), 1), 2000)::INT AS line_w FROM s",
    "unclip_boxes": f"""WITH s AS (SELECT l_orderkey, l_linenumber, l_quantity::FLOAT AS w, (l_suppkey % 9)::FLOAT AS h, (l_discount * 10)::FLOAT AS score FROM lineitem),
        g AS (SELECT *, (w + 2::FLOAT * {_GROW})::FLOAT AS gw, (h + 2::FLOAT * {_GROW})::FLOAT AS gh FROM s)
        SELECT l_orderkey, l_linenumber, round(gw::DOUBLE * 100)::BIGINT AS w100, round(gh::DOUBLE * 100)::BIGINT AS h100, least(w, h) >= 3 AND score >= 0.6::FLOAT AND least(gw, gh) >= 3 AS passes FROM g""",
    "ctc_decode": """
        WITH s AS (SELECT vec_id, unnest(range(0, 16)) AS i, embedding FROM embeddings), b AS (SELECT vec_id, i, embedding[i * 4 + 1:i * 4 + 4] AS v FROM s),
        m AS (SELECT vec_id, i, list_max(v) AS best, list_position(v, list_max(v)) - 1 AS sym FROM b),
        p AS (SELECT *, coalesce(lag(sym) OVER (PARTITION BY vec_id ORDER BY i), -1) AS was FROM m),
        k AS (SELECT vec_id, coalesce(string_agg((['', 'a', 'b', ' '])[sym + 1], '' ORDER BY i) FILTER (sym <> 0 AND sym <> was), '') AS text, list(best ORDER BY i) FILTER (sym <> 0 AND sym <> was) AS bests FROM p GROUP BY vec_id)
        SELECT vec_id, text, CASE WHEN bests IS NULL THEN 0 ELSE round((list_reduce(list_prepend(0::FLOAT, bests), lambda a, x: (a + x)::FLOAT) / len(bests)::FLOAT)::FLOAT::DOUBLE * 10000)::BIGINT END AS confidence FROM k""",
    "dictionary_lines": """
        WITH d AS (SELECT list_concat([''], list(n_name ORDER BY n_nationkey), [' ']) AS symbols FROM nation), v AS (SELECT vec_id, embedding[1:27] AS a, embedding[28:54] AS b FROM embeddings),
        m AS (SELECT vec_id, list_max(a) AS ma, list_position(a, list_max(a)) - 1 AS sa, list_max(b) AS mb, list_position(b, list_max(b)) - 1 AS sb FROM v)
        SELECT vec_id, CASE WHEN sa <> 0 THEN symbols[sa + 1] ELSE '' END || CASE WHEN sb <> 0 AND sb <> sa THEN symbols[sb + 1] ELSE '' END AS text,
            CASE WHEN sa <> 0 AND sb <> 0 AND sb <> sa THEN round(((ma + mb)::FLOAT / 2::FLOAT)::FLOAT::DOUBLE * 10000) WHEN sa <> 0 THEN round(ma::DOUBLE * 10000) WHEN sb <> 0 THEN round(mb::DOUBLE * 10000) ELSE 0 END::BIGINT AS confidence FROM m, d""",
    "heatmap_peak": """
        WITH c AS (SELECT vec_id, unnest(range(0, 64)) AS i, unnest(embedding) AS v FROM embeddings)
        SELECT vec_id, round(sum(i % 8)::DOUBLE / count(*) * 1000)::BIGINT AS x, round(sum(i // 8)::DOUBLE / count(*) * 1000)::BIGINT AS y FROM c WHERE v > 0.1::FLOAT GROUP BY vec_id""",
    "largest_blob": """
        WITH RECURSIVE c AS (SELECT vec_id, unnest(range(0, 64)) AS i, unnest(embedding) AS v FROM embeddings), o AS (SELECT vec_id, i, i % 8 AS x, i // 8 AS y FROM c WHERE v > 0.1::FLOAT),
        reach AS (SELECT vec_id, i AS a, i AS b FROM o UNION SELECT r.vec_id, r.a, n.i FROM reach r JOIN o m ON m.vec_id = r.vec_id AND m.i = r.b JOIN o n ON n.vec_id = m.vec_id AND abs(n.x - m.x) <= 1 AND abs(n.y - m.y) <= 1),
        g AS (SELECT vec_id, a AS i, min(b) AS g FROM reach GROUP BY vec_id, a),
        s AS (SELECT vec_id, g, sum(x)::DOUBLE / count(*) AS x, sum(y)::DOUBLE / count(*) AS y, row_number() OVER (PARTITION BY vec_id ORDER BY count(*) DESC, g) AS r FROM g JOIN o USING (vec_id, i) GROUP BY vec_id, g)
        SELECT vec_id, round(x * 1000)::BIGINT AS x, round(y * 1000)::BIGINT AS y FROM s WHERE r = 1""",
    "masked_mean": """
        WITH q AS (SELECT vec_id, embedding, vec_id % 9 - 2 AS a, vec_id % 7 - 2 AS b, vec_id % 2 AS t FROM embeddings),
        c AS (SELECT vec_id, a, b, t, unnest(range(0, 64)) % 8 - a AS x, unnest(range(0, 64)) // 8 - b AS y, unnest(embedding)::DOUBLE AS v FROM q),
        i AS (SELECT vec_id, avg(v) AS mean FROM c WHERE x BETWEEN 0 AND 3 AND 3 * y >= t * x AND 3 * (y - 3) <= x GROUP BY vec_id)
        SELECT vec_id, coalesce(round(mean * 1000), 0)::BIGINT AS mean FROM embeddings LEFT JOIN i USING (vec_id)""",
    "planes": f"""
        WITH e AS (SELECT vec_id, unnest(range(0, 12)) AS i, (floor(abs(unnest(embedding[1:12])::DOUBLE) * 1000) % 256)::INT AS v FROM embeddings),
        m AS (SELECT * FROM (VALUES (0, 0.485, 0.229), (1, 0.456, 0.224), (2, 0.406, 0.225)) AS m(c, mean, dev))
        SELECT vec_id, (c * 4 + i // 3)::INT AS place, round(((v::FLOAT / 255::FLOAT - mean::FLOAT) / dev::FLOAT)::FLOAT::DOUBLE * 10000)::BIGINT AS value FROM e JOIN m ON c = i % 3
        UNION ALL SELECT vec_id, (12 + i % 3 * 4 + i // 3)::INT, round(((v::FLOAT - 127.5::FLOAT) / 127.5::FLOAT)::FLOAT::DOUBLE * 10000)::BIGINT FROM e""",
    "homography": f"""
        WITH {fixtures.QUADS}, s AS (SELECT doc_id, greatest(floor({_W} + 0.5)::BIGINT, 1) - 1 AS w, greatest(floor({_H} + 0.5)::BIGINT, 1) - 1 AS h FROM quads
            WHERE NOT ({_OUTSIDE}) AND {_W} BETWEEN 2 AND 16384 AND {_H} BETWEEN 2 AND 16384 AND {_AREA} >= 4::FLOAT)
        SELECT doc_id, 0::BIGINT AS x0, 0::BIGINT AS y0, w AS x1, 0::BIGINT AS y1, w AS x2, h AS y2, 0::BIGINT AS x3, h AS y3 FROM s""",
    "first_upload": f"""
        WITH p AS ({PARTS}), b AS (SELECT request_id, min(struct_pack(n := part_no, b := body)).b AS first, (max(struct_pack(n := part_no, b := body)) FILTER (name = 'image')).b AS image FROM p WHERE part_no IS NOT NULL GROUP BY request_id)
        SELECT request_id, coalesce(image, first) AS body, CASE WHEN first IS NULL THEN 'missing_image' WHEN coalesce(image, first) = '' THEN 'empty_image' END AS error_kind FROM (SELECT DISTINCT request_id FROM p) LEFT JOIN b USING (request_id)""",
    "multipart_uploads": f"""
        WITH p AS ({PARTS_SENT}), b AS (SELECT request_id, min(struct_pack(n := part_no, b := body)).b AS first, (max(struct_pack(n := part_no, b := body)) FILTER (name = 'image')).b AS image FROM p WHERE part_no IS NOT NULL GROUP BY request_id)
        SELECT request_id, CASE WHEN request_id % 17 <> 0 AND request_id % 19 <> 0 THEN coalesce(image, first) END AS body,
               CASE WHEN request_id % 17 = 0 OR request_id % 19 = 0 THEN 'multipart' WHEN first IS NULL THEN 'missing_image' WHEN coalesce(image, first) = '' THEN 'empty_image' END AS error_kind
        FROM (SELECT DISTINCT request_id FROM p) LEFT JOIN b USING (request_id)""",
    "stored_crops": f"""WITH c AS ({CROPS}) SELECT id, crop_no, body, 1::BIGINT AS n_stored FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY crop_no DESC, sha256(body) DESC) AS r FROM c) WHERE r = 1""",
    "quarantined": "SELECT CASE event_id % 7 WHEN 0 THEN 'rejected' WHEN 1 THEN 'protocol' WHEN 2 THEN 'protocol' ELSE 'good' END AS kind, count(*) AS n, min(event_id) AS first_id, count(*) AS n_observed FROM events GROUP BY 1",
    "sql_zones": f"SELECT * EXCLUDE (doc_id), doc_id FROM ({_zones('surname', 'given_names', 'passport_number', 'nationality', 'date_of_birth', 'date_of_expiry', 'composite_check_ok')}) JOIN (WITH {fixtures.ZONES} SELECT doc_id, {check_sum('line2', 44)}::INT AS digit FROM zones) USING (doc_id)",
    "sql_dates": f"WITH p AS ({PRINTED.format(table='orders')}) SELECT o_orderkey, CASE WHEN {_IS_DATE} THEN {_ISO} ELSE printed END AS iso FROM p",
    "look_up": "SELECT o_orderkey, c_name, CASE WHEN c_custkey IS NULL THEN 'not_found' END AS error_kind FROM orders LEFT JOIN customer ON c_custkey = o_custkey * 2",
    "latest_crops": f"""WITH c AS ({CROPS}) SELECT id, crop_no, body FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY crop_no DESC, sha256(body) DESC) AS r FROM c) WHERE r = 1""",
    "request_body": """SELECT doc_id, '{"file":"' || to_base64(encode(coalesce(text, ''))) || '","fileType":1,"useDocOrientationClassify":false,"useDocUnwarping":false,"useTextlineOrientation":true,"textRecScoreThresh":0.45,"visualize":false}' AS body FROM documents""",
    "rescale_box": f"WITH {fixtures.QUADS} SELECT doc_id, "
    + ", ".join(f"round(least(greatest(({a}{i} / ((2 + doc_id % {m}) / 4.0)::FLOAT)::FLOAT, 0::FLOAT), {s}::FLOAT - 1::FLOAT)::DOUBLE * 10)::BIGINT AS {a}{i}" for i in range(4) for a, s, m in (("x", "width", 7), ("y", "height", 5)))
    + " FROM quads",
    "full_frame": f"WITH {fixtures.QUADS} SELECT doc_id, 0::BIGINT AS x0, 0::BIGINT AS y0, (width - 1)::BIGINT AS x1, 0::BIGINT AS y1, (width - 1)::BIGINT AS x2, (height - 1)::BIGINT AS y2, 0::BIGINT AS x3, (height - 1)::BIGINT AS y3 FROM quads",
    "upside_down": "SELECT vec_id, embedding[2] > embedding[1] AS upside_down FROM embeddings",
    "stream_fields": f"{_pages(CARD_LABEL_WORDS)} SELECT doc_id, field_no::INT AS field_no, label, value FROM generic",
    "sql_fields": f"{_pages(CARD_LABEL_WORDS)} SELECT doc_id, field_no::INT AS field_no, label, value FROM generic",
    "stream_assembly": f"""{_pages(CARD_LABEL_WORDS)}, extra AS (SELECT doc_id, count(*) AS n FROM ocr_lines WHERE doc_id % 11 = 0 AND det_no % 5 = 0 GROUP BY doc_id)
        SELECT doc_id, field_no::INT AS field_no, label, value, coalesce(n, 0)::BIGINT AS n_extra FROM generic LEFT JOIN extra USING (doc_id)""",
    "wide_label_rows": f"{_pages(CARD_LABEL_WORDS, 'wide_lines')} SELECT doc_id, n AS line_no, g AS group_no FROM member",
    "wide_nearest_below": f"{_pages(CARD_LABEL_WORDS, 'wide_lines')} SELECT doc_id, g AS group_no, n AS anchor, gap::INT AS gap, distance::INT AS distance FROM anchor WHERE r = 1",
    "wide_value_rows": f"{_pages(CARD_LABEL_WORDS, 'wide_lines')} SELECT doc_id, anchor, value FROM vrow",
    "wide_fields": f"{_pages(CARD_LABEL_WORDS, 'wide_lines')} SELECT doc_id, field_no::INT AS field_no, label, value FROM generic",
    "fields_json": _fields_json(),
    "passport_json": _passport_json(),
    "sidecar_flatten": f"""
        WITH b AS ({BODIES}), g AS (SELECT doc_id, body->'$.result.ocrResults[0].prunedResult' AS p FROM b WHERE doc_id % 7 > 2),
        e AS (SELECT doc_id, unnest(range(0, 3)) AS i, p FROM g),
        x AS (SELECT doc_id, i::INT AS det_no, trim(p->>('$.rec_texts[' || i || ']')) AS text, (p->>('$.rec_scores[' || i || ']'))::FLOAT AS c, (p->>('$.rec_polys[' || i || '][2][0]'))::INT AS "right" FROM e)
        SELECT doc_id, det_no, text, round(c::DOUBLE * 1000)::BIGINT AS confidence, "right" FROM x WHERE text <> '' AND c >= 0.45::FLOAT""",
    "error_status": """SELECT event_id AS doc_id, CASE event_id % 7 WHEN 0 THEN 'rejected' WHEN 1 THEN 'protocol' WHEN 2 THEN 'protocol' ELSE 'none' END AS error_kind,
        CASE WHEN event_id % 7 < 3 THEN 502 ELSE 200 END AS status, CASE WHEN event_id % 7 < 3 THEN 'OCR service is unavailable' ELSE '' END AS message FROM events""",
}
