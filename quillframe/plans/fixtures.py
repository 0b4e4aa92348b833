"""Input views over the driver's tables, as SQL that Spark and DuckDB read alike: zones, and pages of recognized lines."""

from __future__ import annotations

ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def check_sum(s: str, length: int) -> str:
    """SQL of a zone's check digit over ``length`` characters of the expression ``s``."""
    terms = (f"greatest(instr('{ALPHABET}', substr({s}, {i + 1}, 1)) - 1, 0) * {(7, 3, 1)[i % 3]}" for i in range(length))
    return f"(({' + '.join(terms)}) % 10)"


#: The hints, comments to DuckDB, keep the generated code of a stage small.
#: doc_id, line1, line2: a zone for each customer. Every tenth has a wrong character, every thirteenth a month 13.
ZONES = f"""
zone_parts AS (
    SELECT c_custkey AS doc_id,
           'L' || lpad(CAST(c_custkey * 7919 % 100000000 AS STRING), 8, '0') AS num,
           chr(CAST(65 + c_nationkey % 26 AS INT)) || chr(CAST(65 + c_nationkey * 7 % 26 AS INT)) || 'O' AS nat,
           lpad(CAST(c_custkey * 11 % 100 AS STRING), 2, '0') || lpad(CAST(c_custkey % 13 + 1 AS STRING), 2, '0') || lpad(CAST(c_custkey * 3 % 31 + 1 AS STRING), 2, '0') AS birth,
           lpad(CAST(c_custkey * 3 % 60 AS STRING), 2, '0') || lpad(CAST(c_custkey % 12 + 1 AS STRING), 2, '0') || lpad(CAST(c_custkey * 5 % 31 + 1 AS STRING), 2, '0') AS expiry,
           CASE WHEN c_custkey % 5 = 0 THEN '<<<<<<<<<<<<<<' ELSE rpad('ZE' || CAST(c_custkey * 31 AS STRING), 14, '<') END AS personal,
           CASE WHEN c_custkey % 3 = 0 THEN 'M' WHEN c_custkey % 3 = 1 THEN 'F' ELSE '<' END AS sex,
           'ERIK' || chr(CAST(65 + c_custkey % 26 AS INT)) || 'SON' ||
               CASE WHEN c_custkey % 7 = 0 THEN '' WHEN c_custkey % 7 = 1 THEN '<<ANNA<MARIA' WHEN c_custkey % 7 = 2 THEN '<VON<<JO<<E<SS<' ELSE '<<OLE' END AS names
    FROM customer JOIN nation ON c_nationkey = n_nationkey
),
zone_checked AS (
    SELECT *, num || CAST({check_sum("num", 9)} AS STRING) AS numc, birth || CAST({check_sum("birth", 6)} AS STRING) AS birthc,
           expiry || CAST({check_sum("expiry", 6)} AS STRING) AS expiryc,
           personal || CASE WHEN doc_id % 5 = 0 THEN '<' ELSE CAST({check_sum("personal", 14)} AS STRING) END AS personalc
    FROM zone_parts
),
zone_whole AS (SELECT *, numc || birthc || expiryc || personalc AS comp FROM zone_checked),
zones AS (
    SELECT /*+ REPARTITION(doc_id) */ doc_id, rpad('P<' || nat || names, 44, '<') AS line1,
           CASE WHEN doc_id % 10 = 0 THEN substr(numc, 1, 3) || 'X' || substr(numc, 5, 6) ELSE numc END
               || nat || birthc || sex || expiryc || personalc || CAST({check_sum("comp", 39)} AS STRING) AS line2
    FROM zone_whole
)"""

#: Page templates: kind, detection number, text, confidence, left, top, width. Braces stand for values of the document.
_CARD = [
    ("NATIONAL IDENTITY CARD", 97, 300, 10, 300), ("राष्ट्रिय परिचयपत्र", 93, 300, 40, 250), ("परिचय नं.", 92, 10, 80, 90), ("{idn}", 96, 12, 110, 140), ("{id}", 95, 10, 140, 140),
    ("नाम", 91, 300, 80, 60), ("{dev}", 94, 302, 110, 60), ("थर", 94, 370, 110, 60), ("FULL NAME", 98, 300, 150, 90), ("{first}", 96, 302, 180, 70), ("{last}", 96, 380, 182, 80),
    ("NATIONALITY", 97, 300, 230, 110), ("Nepali", 95, 304, 260, 60), ("DATE", 96, 10, 230, 40), ("OF", 96, 60, 230, 20), ("ISSUE", 96, 90, 231, 50), ("{doi}", 95, 12, 260, 100),
    ("{dob}", 95, 300, 320, 100), ("{dobn}", 94, 300, 350, 100), ("SEX", 96, 10, 310, 40), ("{sex}", 95, 12, 340, 20), ("{sexn}", 93, 60, 340, 40), ("faint", 40, 500, 500, 50),
]
_CITIZEN = [
    ("PERMANENT ADDRESS", 96, 10, 10, 180), ("{town}, ward 4", 95, 12, 40, 110), ("{street} street", 94, 140, 41, 110), ("CITIZENSHIP TYPE", 96, 10, 90, 160), ("Descent", 95, 14, 120, 70),
    ("नागरिकता नं. | CC NUMBER", 95, 300, 10, 200), ("{id}", 94, 305, 40, 130), ("NICIN", 97, 300, 90, 60), ("{idn}", 92, 301, 120, 130), ("ID NO: {id}", 90, 10, 180, 150),
    ("A NOTE", 91, 10, 230, 70), ("lower case", 80, 10, 260, 90),
]
_PASSPORT = [
    ("PASSPORT", 96, 10, 10, 100), ("TYPE", 95, 150, 10, 50), ("P", 94, 152, 40, 12), ("COUNTRY CODE", 95, 260, 10, 130), ("NPL", 94, 262, 40, 40), ("PASSPORT NO", 96, 500, 10, 120), ("{num}", 95, 503, 40, 110),
    ("SURNAME", 96, 10, 90, 90), ("{last}", 95, 12, 120, 80), ("GIVEN NAMES", 95, 10, 160, 120), ("{first}", 95, 12, 190, 80), ("NATIONALITY", 95, 500, 160, 120), ("NEPALESE", 94, 502, 190, 90),
    ("DATE OF BIRTH", 94, 10, 230, 140), ("{bday}", 93, 12, 260, 110), ("SEX", 96, 300, 230, 40), ("{sex}", 95, 303, 260, 16), ("DATE OF {iss}", 92, 500, 230, 140), ("{iday}", 94, 505, 260, 110),
    ("DATE OF EXPIRY", 95, 500, 300, 150), ("{eday}", 94, 501, 330, 110), ("CITIZENSHIP NO", 93, 10, 300, 150), ("{id}", 92, 14, 330, 130), ("{line1}", 88, 10, 700, 880), ("{line2}", 87, 10, 730, 880),
]
_OTHER = [
    ("INVOICE", 97, 10, 10, 90), ("NAME", 95, 10, 60, 60), ("{first}", 96, 12, 90, 60), ("{last}", 75, 76, 92, 60), ("TOTAL: {total}", 96, 10, 150, 120), ("*ADDRESS*", 93, 10, 200, 90), ("{street} street 5", 80, 40, 230, 130),
    ("TYPE", 90, 300, 60, 50), ("NUMBER", 91, 352, 64, 80), ("{id}", 74, 302, 90, 120), ("{num}", 76, 302, 130, 120), (": empty", 96, 500, 60, 60), ("DATE OF BIRTH", 89, 500, 150, 120), ("{dob}", 96, 500, 180, 100), ("SEX", 95, 500, 250, 40), ("{sex}", 94, 500, 351, 20),
]
_ROWS = ",\n        ".join(f"({kind}, {i}, '{text}', {confidence}, {left}, {top}, {width})" for kind, lines in enumerate((_CARD, _CITIZEN, _PASSPORT, _OTHER)) for i, (text, confidence, left, top, width) in enumerate(lines))
_DEVANAGARI = "'0123456789', '०१२३४५६७८९'"
_MONTH = "substr('JANFEBMARAPRMAYJUNJULAUGSEPOCTNOVDEC', CAST({} % 12 * 3 + 1 AS INT), 3)"


def _fill(pairs: dict[str, str]) -> str:
    out = "t"
    for name in pairs:
        out = f"replace({out}, '{{{name}}}', w_{name})"
    return out


_VALUES = {
    "idn": f"translate(v_id, {_DEVANAGARI})",
    "id": "v_id",
    "dobn": f"translate(v_dob, {_DEVANAGARI})",
    "dob": "v_dob",
    "doi": "v_doi",
    "dev": "CASE WHEN doc_id % 2 = 0 THEN 'राम' ELSE 'सीता' END",
    "first": "'AS' || chr(CAST(65 + doc_id % 26 AS INT)) || 'A'",
    "last": "'TEST' || chr(CAST(65 + doc_id * 7 % 26 AS INT))",
    "sexn": "CASE WHEN doc_id % 2 = 0 THEN 'पुरुष' ELSE 'महिला' END",
    "sex": "CASE WHEN doc_id % 2 = 0 THEN 'M' ELSE 'F' END",
    "town": "'Town' || CAST(doc_id % 90 AS STRING)",
    "street": "'Lake' || CAST(doc_id % 40 AS STRING)",
    "num": "'L' || lpad(CAST(doc_id * 7919 % 100000000 AS STRING), 8, '0')",
    "iss": "CASE WHEN doc_id % 3 = 0 THEN 'lSSUE' ELSE 'ISSUE' END",
    "bday": f"lpad(CAST(doc_id % 28 + 1 AS STRING), 2, '0') || ' ' || {_MONTH.format('doc_id')} || ' 19' || CAST(doc_id % 50 + 50 AS STRING)",
    "iday": f"CAST(doc_id % 9 + 1 AS STRING) || ' xx/' || {_MONTH.format('doc_id')} || ' ' || CAST(doc_id % 13 + 10 AS STRING)",
    "eday": f"CAST(doc_id % 19 + 10 AS STRING) || ' ' || {_MONTH.format('(doc_id + 5)')} || ' 2031'",
    "total": "CAST(doc_id * 3 AS STRING)",
    "line1": "line1",
    "line2": "line2",
}
_YEARS = "CAST(1970 + doc_id % 35 AS STRING)"
_DAY = "lpad(CAST(doc_id % 12 + 1 AS STRING), 2, '0') || '{0}' || lpad(CAST(doc_id * 5 % 28 + 1 AS STRING), 2, '0')"

#: doc_id, kind, det_no, text, conf (in thousandths), lft, top, wid. Columns drift to both sides of each limit by document; every 29th page has no line that is sure enough.
TEMPLATE = f"""template(k, det_no, t, c, l, p, w) AS (
    SELECT * FROM (VALUES
        {_ROWS}) AS v(k, det_no, t, c, l, p, w)
)"""
#: doc_id, kind and the values of each document.
WORDED = f"""filled AS (
    SELECT doc_id, line1, line2, CAST(doc_id % 4 AS INT) AS kind,
           lpad(CAST(doc_id % 1000 AS STRING), 3, '0') || CASE WHEN doc_id % 8 < 4 THEN '-' ELSE '.' END || lpad(CAST(doc_id * 7 % 1000 AS STRING), 3, '0') || '-' || lpad(CAST(doc_id * 13 % 10000 AS STRING), 4, '0') AS v_id,
           {_YEARS} || '-' || {_DAY.format("-")} AS v_dob, '20' || lpad(CAST(doc_id % 20 AS STRING), 2, '0') || '.' || {_DAY.format(".")} AS v_doi
    FROM zones
),
worded AS (SELECT /*+ REPARTITION(doc_id) */ doc_id, kind, {", ".join(f"{v} AS w_{n}" for n, v in _VALUES.items())} FROM filled)"""
OCR_LINES = f"""ocr_lines AS (
    SELECT doc_id, kind, det_no, {_fill(_VALUES)} AS text,
           CAST(CASE WHEN doc_id % 29 = 0 THEN 300 ELSE c * 10 END - CASE WHEN doc_id % 29 = 0 THEN 0 WHEN doc_id % 5 = 0 AND det_no % 4 = 2 THEN 100 WHEN doc_id % 9 = 0 AND det_no % 5 = 1 THEN 45 ELSE 0 END AS INT) AS conf,
           CAST(l + doc_id * det_no % 7 + CASE WHEN doc_id % 6 = 0 AND det_no % 3 = 1 THEN 118 ELSE 0 END AS INT) AS lft,
           CAST(p + (doc_id + det_no) % 4 - CASE WHEN doc_id % 7 = 0 AND det_no % 4 = 3 THEN 12 ELSE 0 END AS INT) AS top, CAST(w AS INT) AS wid
    FROM template JOIN worded ON k = kind
)"""
PAGES = f"{ZONES},\n{TEMPLATE},\n{WORDED},\n{OCR_LINES}"

#: Quads from four numbers of an order line; some are not finite, outside, tiny or flat.
QUADS = """
quads AS (
    SELECT l_orderkey * 10 + l_linenumber AS doc_id, CAST(800 + l_partkey % 300 AS INT) AS width, CAST(600 + l_suppkey % 200 AS INT) AS height,
           CAST(l_partkey * 7 % 40 AS FLOAT) AS x0, CAST(l_suppkey * 11 % 40 AS FLOAT) AS y0,
           CAST(CASE WHEN l_orderkey % 11 = 0 THEN 1500 ELSE 500 + l_partkey * 3 % 300 END AS FLOAT) AS x1, CAST(l_suppkey * 5 % 50 AS FLOAT) AS y1,
           CAST(CASE WHEN l_orderkey % 13 = 0 THEN l_partkey * 7 % 40 ELSE 480 + l_partkey * 5 % 300 END AS FLOAT) AS x2, CAST(CASE WHEN l_orderkey % 13 = 0 THEN l_suppkey * 11 % 40 ELSE 400 + l_suppkey % 150 END AS FLOAT) AS y2,
           CAST(CASE WHEN l_orderkey % 17 = 0 THEN -1 ELSE l_partkey * 13 % 50 END AS FLOAT) AS x3, CAST(390 + l_suppkey * 3 % 160 AS FLOAT) AS y3
    FROM lineitem
)"""
