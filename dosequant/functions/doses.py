"""Figures that are only found in the name of a presentation."""

from pyspark.sql import Column, functions as F

from dosequant.fixed_values import ADQ_UNITS, DOSE_PATTERN


def dose_from_name(name: str) -> Column:
    """Doses per pack as written in the name; 1.0 where it gives none."""
    return F.expr(f"""
        coalesce(try_cast(regexp_extract({name}, r'{DOSE_PATTERN}', 1) AS double),
                 try_cast(regexp_extract({name}, r'{DOSE_PATTERN}', 2) AS double),
                 1D)""")


def strength_sql(name: str, unit: str) -> str:
    """The last whole number written directly before `unit` in the name.

    A decimal fraction counts as its own number: `1.5g` gives 5. The pattern
    depends on the unit, and Spark compiles a pattern anew whenever it changes
    from one row to the next, so each usual unit has its own constant pattern.
    """
    usual = " ".join(
        rf"WHEN '{u}' THEN regexp_extract({name}, r'^.*\b(\d+){u}\b', 1)"
        for u in ADQ_UNITS
    )
    other = rf"concat(r'^.*\b(\d+)\Q', {unit}, r'\E\b')"
    return f"""
        try_cast(CASE {unit} {usual} ELSE regexp_extract({name}, {other}, 1) END
                 AS double)"""


def strength_from_name(name: str, unit: str) -> Column:
    return F.expr(strength_sql(name, unit))
