"""One flat record per passport page: machine-readable zone and printed fields together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.functions import mrz
from quillframe.functions.text import printed_date_iso, printed_dates
from quillframe.operators.signatures import passport_fields

ZONE_TEXT = ("document_type", "issuing_country", "surname", "given_names", "passport_number", "nationality", "date_of_birth", "sex", "date_of_expiry", "personal_number")
ZONE_FLAGS = ("expired", "passport_number_check_ok", "date_of_birth_check_ok", "date_of_expiry_check_ok", "personal_number_check_ok", "composite_check_ok")
COLUMNS = (
    "document_type", "issuing_country", "surname", "given_names", "full_name", "passport_number", "nationality", "date_of_birth", "sex",
    "date_of_issue", "date_of_expiry", "personal_number", *ZONE_FLAGS,
)


def _printed(label: str) -> Column:
    return F.get(F.filter("fields", lambda f: f["label"] == label), F.lit(0))["value"]


def today_in_utc() -> Column:
    return F.to_date(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()))


def passport_json(documents: DataFrame) -> DataFrame:
    """(doc_id, body): passport records as the JSON of a response, fields in their order."""
    return documents.select("doc_id", F.to_json(F.struct(*COLUMNS)).alias("body"))


def passport_documents(pages: DataFrame, as_of: Column | None = None) -> DataFrame:
    """(doc_id, 12 texts, 6 flags). Without a zone its texts are empty and its flags false; so they are for a page without lines.

    Dates are judged as of ``as_of``, by default today's date in UTC, whatever the session's time zone.

    The zone's values count whatever its checks say. The personal number is the printed one where there is one. The date
    of issue is printed only: under its label, else the second of exactly three dates on the page. Names are the zone's.
    Both branches read the same page row, so nothing is joined or shuffled.
    """
    today = today_in_utc() if as_of is None else as_of
    frame = passport_fields(pages).withColumns({"zone": mrz.extract(F.col("lines"), today), "dates": printed_dates(F.transform("lines", lambda x: x["text"]))})
    text = {c: F.coalesce(F.col("zone")[c], F.lit("")) for c in ZONE_TEXT}
    text["personal_number"] = F.coalesce(_printed("CITIZENSHIP NUMBER"), text["personal_number"])
    issued = F.coalesce(_printed("DATE OF ISSUE"), F.when(F.size("dates") == 3, F.get("dates", F.lit(1))))
    text["date_of_issue"] = F.coalesce(printed_date_iso(issued), F.lit(""))
    text["full_name"] = F.array_join(F.filter(F.array(text["given_names"], text["surname"]), lambda x: x != ""), " ")
    flags = {c: F.coalesce(F.col("zone")[c], F.lit(False)) for c in ZONE_FLAGS}
    return frame.select("doc_id", *((text | flags)[c].alias(c) for c in COLUMNS))
