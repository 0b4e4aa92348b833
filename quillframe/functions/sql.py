"""The expressions that users of SQL ask for, as functions of the session (``CREATE TEMPORARY FUNCTION``): no Python runs in them."""

from __future__ import annotations

from pyspark.sql import SparkSession

from quillframe.functions.mrz import ALPHABET, LINE, LONGEST, SHORTEST
from quillframe.functions.text import MONTHS

_MONTHS = ", ".join(f"'{m}'" for m in MONTHS)
_TOKENS = r"filter(split(s, '(?U)[\\s/]+'), w -> w <> '')"
_NUMBERS = f"filter(transform(slice(t, 2, greatest(size(t) - 2, 0)), w -> array_position(array({_MONTHS}), upper(w))), m -> m > 0)"

#: Name, parameters, result, body; later ones use earlier ones.
FUNCTIONS = (
    ("mrz_check_digit", "s STRING", "INT", f"CAST(aggregate(transform(split(s, ''), (c, i) -> greatest(locate(c, '{ALPHABET}') - 1, 0) * element_at(array(7, 3, 1), i % 3 + 1)), 0, (a, x) -> a + x) % 10 AS INT)"),
    ("mrz_verify", "field STRING, digit STRING", "BOOLEAN", "digit = '<' OR (digit RLIKE '^[0-9]$' AND CAST(mrz_check_digit(field) AS STRING) = digit)"),
    ("mrz_name", "s STRING", "STRING", "array_join(filter(transform(split(substring_index(s, '<<', 1), '<'), p -> trim(p)), p -> p <> ''), ' ')"),
    ("mrz_normalize", "s STRING", "STRING", "upper(regexp_replace(regexp_replace(s, '[ _«‹]', '<'), '[^A-Za-z0-9<]+', ''))"),
    ("mrz_line", "s STRING", "STRING", f"CASE WHEN length(mrz_normalize(s)) BETWEEN {SHORTEST} AND {LONGEST} THEN rpad(mrz_normalize(s), {LINE}, '<') END"),
    (
        "mrz_date",
        "s STRING, as_of DATE",
        "STRING",
        """CASE WHEN s RLIKE '^[0-9]{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12][0-9]|3[01])$' THEN
            concat_ws('-', CAST(year(as_of) - year(as_of) % 100 + try_to_number(substr(s, 1, 2), '99')
                - CASE WHEN try_to_number(substr(s, 1, 2), '99') > year(as_of) % 100 + 10 THEN 100 ELSE 0 END AS STRING), substr(s, 3, 2), substr(s, 5, 2)) ELSE s END""",
    ),
    (
        "mrz_parse",
        "line1 STRING, line2 STRING, as_of DATE",
        "STRUCT<surname: STRING, given_names: STRING, passport_number: STRING, nationality: STRING, date_of_birth: STRING, date_of_expiry: STRING, composite_check_ok: BOOLEAN>",
        f"""CASE WHEN length(line1) = {LINE} AND length(line2) = {LINE} THEN named_struct(
            'surname', mrz_name(substr(line1, 6)), 'given_names', CASE WHEN instr(substr(line1, 6), '<<') > 0 THEN mrz_name(substr(substr(line1, 6), instr(substr(line1, 6), '<<') + 2)) ELSE '' END,
            'passport_number', trim(BOTH '<' FROM substr(line2, 1, 9)), 'nationality', trim(BOTH '<' FROM substr(line2, 11, 3)),
            'date_of_birth', mrz_date(substr(line2, 14, 6), as_of), 'date_of_expiry', mrz_date(substr(line2, 22, 6), as_of),
            'composite_check_ok', mrz_verify(concat(substr(line2, 1, 10), substr(line2, 14, 7), substr(line2, 22, 22)), substr(line2, 44, 1))) END""",
    ),
    (
        "printed_date",
        "s STRING",
        "STRING",
        f"""element_at(transform(array({_TOKENS}), t -> CASE
            WHEN size(t) >= 3 AND t[0] RLIKE '^[0-9]{{1,2}}$' AND element_at(t, -1) RLIKE '^(?:[0-9]{{2}}|[0-9]{{4}})$' AND size({_NUMBERS}) > 0
            THEN concat_ws('-', CASE WHEN length(element_at(t, -1)) = 2 THEN concat('20', element_at(t, -1)) ELSE element_at(t, -1) END, lpad(CAST(({_NUMBERS})[0] AS STRING), 2, '0'), lpad(t[0], 2, '0'))
            ELSE s END), 1)""",
    ),
    ("label_value", "s STRING", "STRUCT<label: STRING, value: STRING>", "CASE WHEN instr(s, ':') > 1 AND trim(substr(s, instr(s, ':') + 1)) <> '' THEN named_struct('label', trim(BOTH '* ' FROM substr(s, 1, instr(s, ':') - 1)), 'value', trim(BOTH '* ' FROM substr(s, instr(s, ':') + 1))) END"),
)


def register(spark: SparkSession) -> None:
    """Makes the functions known to the session; again where they are known already."""
    for name, parameters, result, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
