"""Multipart request bodies as parts, by built-in functions over bytes.

A body is read as ISO 8859-1, where every byte is one character, cut at its delimiters and turned back into bytes, so images come
out as they went in. Rows are requests, and Spark splits them as it splits any table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.functions.text import let
from quillframe.sources.images import LIMIT, first_upload

BYTES = "ISO-8859-1"
BREAK = "\r\n"


def boundary(content_type: Column) -> Column:
    """The boundary of ``multipart/form-data``, quoted or not; null for other types, without one, or over 70 characters."""
    form = r'(?i)^\s*multipart/form-data\s*;(?:[^"]|"[^"]*")*?\bboundary=("[^"]{1,70}"|[^\s;"]{1,70}(?=[\s;]|$))'
    return let(F.regexp_extract(content_type, form, 1), lambda m: F.when(m.startswith('"'), F.substring(m, F.lit(2), F.length(m) - 2)).when(m != "", m))


def _has(text: Column, word: str) -> Column:
    """Whether a regular expression that asks for ``word`` in any letter case need be tried."""
    return F.contains(F.lower(text), F.lit(word))


def _parameter(line: Column, name: str) -> Column:
    """A parameter of the part's Content-Disposition; null without it."""
    found = F.regexp_extract(line, rf'(?i);\s*{name}=(?:"(?:[^"\\]++|\\.)*+"|[^\s;"]+)', 0)

    def value(m: Column) -> Column:
        given = F.substring(m, F.instr(m, "=") + 1, F.length(m))
        bare = let(given, lambda v: F.when(v.startswith('"'), F.substring(v, F.lit(2), F.length(v) - 2)).otherwise(v))
        plain = let(bare, lambda v: F.when(F.contains(v, F.lit("\\")), F.regexp_replace(v, r"\\(.)", "$1")).otherwise(v))
        return F.when(m != "", plain).when(line.rlike(rf'(?i);\s*{name}='), "")

    return F.when(_has(line, f"{name}="), let(found, value))


def _parts(text: Column, mark: Column) -> Column:
    """array<struct<name, filename, type, content>> of a body; null if it is cut short or a part has no end of its head."""
    sign = F.concat(F.lit(BREAK + "--"), F.regexp_replace(mark, "([^A-Za-z0-9])", r"\\$1"), F.lit(r"(?:[ \t]*(?=\r\n)|--)"))

    def part(piece: Column) -> Column:
        def made(head: Column, at: Column) -> Column:
            line = F.when(_has(head, "content-disposition:"), F.regexp_extract(head, r"(?i)(?:^|\r\n)content-disposition:([^\r\n]*)", 1))
            kind = F.when(_has(head, "content-type:"), F.nullif(F.trim(F.regexp_extract(head, r"(?i)(?:^|\r\n)content-type:([^\r\n]*)", 1)), F.lit("")))
            content = F.encode(F.substring(piece, at + 4, F.length(piece)), BYTES)
            return let(line, lambda x: F.struct(_parameter(x, "name").alias("name"), _parameter(x, "filename").alias("filename"), kind.alias("type"), content.alias("content")))

        return let(F.instr(piece, BREAK * 2), lambda at: F.when(at > 0, let(F.substring(piece, F.lit(1), at - 1), lambda head: made(head, at))))

    def cut(s: Column) -> Column:
        # The text before the first sign is a preamble, what follows the closing one an epilogue.
        whole = F.struct(F.split(s["text"], s["sign"], -1).alias("pieces"), F.transform(F.regexp_extract_all(s["text"], s["sign"], F.lit(0)), lambda d: d.endswith("--")).alias("ends"))
        return let(whole, lambda w: let(F.array_position(w["ends"], F.lit(True)).cast("int"), lambda end: F.when(end > 0, F.transform(F.slice(w["pieces"], F.lit(2), end - 1), part))))

    found = let(F.struct(F.concat(F.lit(BREAK), text).alias("text"), sign.alias("sign")), cut)
    return let(found, lambda p: F.when(~F.exists(p, lambda x: x.isNull()), p))


def parse_multipart(requests: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(request_id, part_no, name, filename, type, content, error_kind) of requests (request_id, content_type, body).

    Parts are numbered from 0; a request without any part is a row without a number. A delimiter is a line of ``--``, the boundary, and
    ``--`` or white space only; any other line, such as one that merely begins so or the boundary of a message within a part, is
    content. Requests of another type, without a boundary or a body, over ``limit`` bytes, without a closing delimiter, or with
    a part whose head doesn't end are one row of ``error_kind`` 'multipart': a request fails as a whole. A part may have no name.
    Names are the bytes sent, read as UTF-8.
    """
    fits = F.col("body").isNotNull() & (F.octet_length("body") <= limit)
    known = requests.select("request_id", boundary(F.col("content_type")).alias("mark"), F.when(fits, F.col("body")).alias("body"))
    parts = F.when(F.col("mark").isNotNull() & F.col("body").isNotNull(), _parts(F.decode("body", BYTES), F.col("mark")))
    read = known.select("request_id", parts.alias("parts"))
    rows = read.select("request_id", F.col("parts").isNull().alias("bad"), F.posexplode_outer("parts").alias("part_no", "p"))
    utf8 = lambda c: F.decode(F.encode(c, BYTES), "UTF-8")
    return rows.select("request_id", "part_no", utf8(F.col("p.name")).alias("name"), utf8(F.col("p.filename")).alias("filename"), "p.type", "p.content", F.when(F.col("bad"), "multipart").alias("error_kind"))


def uploads(requests: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(request_id, content, error_kind): the image of each request, or why there is none."""
    # A request that fails as a whole is a group of its own, so that all requests are read once.
    parts = parse_multipart(requests, limit).withColumn("failed", F.when(F.col("error_kind").isNotNull(), F.monotonically_increasing_id()))
    return first_upload(parts, "failed").select("request_id", "content", F.when(F.col("failed").isNotNull(), "multipart").otherwise(F.col("error_kind")).alias("error_kind"))
