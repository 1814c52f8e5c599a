"""Unit normalisation: every measure in grammes, millilitres, units or doses."""

from pyspark.sql import Column, functions as F

from dosequant.fixed_values import UNIT_RULES
from dosequant.functions.text import sql_list, stripped_sql


def clean_unit_sql(unit: str) -> str:
    return stripped_sql(f"lower({unit})")


def normal_unit(cleaned: str) -> Column:
    """The unit a cleaned spelling stands for; unknown spellings stay as they are."""
    cases = [
        f"WHEN {cleaned} IN ({sql_list(spellings)}) THEN '{unit}'"
        for spellings, (unit, _, _) in UNIT_RULES.items()
    ]
    return F.expr(f"CASE {' '.join(cases)} ELSE {cleaned} END")


def scaled_number(number: str, cleaned: str) -> Column:
    """The number converted along with its unit."""
    cases = []
    for spellings, (_, divisors, multiplier) in UNIT_RULES.items():
        steps = "".join(f" / {divisor}D" for divisor in divisors)
        if multiplier is not None:
            steps += f" * {multiplier}D"
        if steps:
            cases.append(f"WHEN {cleaned} IN ({sql_list(spellings)}) THEN {number}{steps}")
    return F.expr(f"CASE {' '.join(cases)} ELSE {number} END")
