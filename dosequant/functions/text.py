"""Text, number and rounding expressions shared by the operators.

Rules are written as SQL expressions: a rule reads as a whole, and a plan is
built with one call per rule instead of one per operator in it.
"""

from pyspark.sql import Column, functions as F

from dosequant.fixed_values import NULL_TOKENS, RUN_DATE_FORMAT, WHITESPACE


def sql_text(value: str) -> str:
    """A text as a SQL literal."""
    escaped = value.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def sql_list(values) -> str:
    return ", ".join(sql_text(value) for value in values)


def stripped_sql(text: str) -> str:
    """The text without surrounding white space, Unicode spaces included."""
    spaces = "".join(f"\\u{ord(space):04x}" for space in WHITESPACE)
    return f"btrim({text}, '{spaces}')"


def null_if_token(text: str) -> Column:
    """NULL where the cell holds one of the usual spellings of a missing value."""
    return F.expr(f"CASE WHEN {text} NOT IN ({sql_list(NULL_TOKENS)}) THEN {text} END")


def number_sql(text: str) -> str:
    """A comma-grouped number as a double; NULL where the text is not a number.

    Java reads a trailing d or f as part of a number; sheets mean no such thing.
    """
    return (
        f"CASE WHEN NOT rlike({text}, r'[dDfF]\\s*$') "
        f"THEN {real_sql(f"try_cast(replace({text}, ',', '') AS double)")} END"
    )


def real_sql(number: str) -> str:
    """The number as a double, with not-a-number read as missing."""
    return f"nullif(cast({number} AS double), double('NaN'))"


def rounded_to_tenth(number: str) -> Column:
    """One decimal, ties to even on the scaled double.

    `round` rounds ties up, and `bround` works on the decimal text, so neither
    gives the same doubles.
    """
    return F.expr(f"rint({number} * 10D) / 10D")


def run_date_label(date: str) -> Column:
    return F.date_format(date, RUN_DATE_FORMAT)


def file_name_of_url(url: str) -> Column:
    """The last segment of the URL's path, with `%20` written as `_`.

    Splits the URL by its delimiters only, so that addresses `parse_url` rejects
    (spaces, stray brackets) still give a name.
    """
    path = rf"regexp_extract({url}, r'^(?:[^:/?#]+:)?(?://[^/?#]*)?([^?#]*)', 1)"
    segment = f"substring_index(substring_index({path}, '/', -1), ';', 1)"
    return F.expr(f"replace({segment}, '%20', '_')")
