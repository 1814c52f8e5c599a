"""The two rule ladders: unit of a prescribed quantity, and ADQs per quantity.

In both, the first rule that applies decides.
"""

from pyspark.sql import Column, functions as F

from dosequant.fixed_values import SOLID_FORMS
from dosequant.functions.doses import strength_sql
from dosequant.functions.text import sql_list


def quantity_unit() -> Column:
    """The unit in which a product's quantity is recorded.

    Reads squ, form, form_indicator, form_units and unit_of_measure. A known
    standard quantity unit decides; otherwise the form of the product does. A
    discrete form without a unit of measure has no known unit.
    """
    return F.expr(f"""
        CASE
          WHEN squ <> '' THEN squ
          WHEN form_indicator = 'Not applicable' OR form = 'Not applicable' THEN NULL
          WHEN form IN ({sql_list(SOLID_FORMS)}) THEN 'g'
          WHEN form_units = 'litre' THEN 'ml'
          WHEN form_indicator = 'Discrete' AND NOT unit_of_measure <=> 'spoonful'
            THEN unit_of_measure
          ELSE 'ml'
        END""")


# ADQs given in doses mean units; a missing ADQ unit is blank.
ADQ_UNIT = "coalesce(adq_denominator, '')"
ADQ_UNIT_AS_UNIT = f"replace({ADQ_UNIT}, 'dose', 'unit')"

# Patches dosed per hour cannot be told from a weight. Blank ADQ units mean the
# quantity's own unit. For compounds, the strength that counts is only in the
# name, next to the unit as the sheet has it.
QUANTITY_IN_ADQ_UNITS = f"""
    CASE
      WHEN denominator_unit_of_measure = 'hour' AND {ADQ_UNIT} = 'g' THEN NULL
      WHEN {ADQ_UNIT_AS_UNIT} IN ('', quantity_denominator)
        THEN CASE WHEN unit_of_measure = 'unit dose' THEN form_size ELSE 1D END
      WHEN quantity_denominator = 'unit' AND ingredient_count = 1
        THEN CASE WHEN {ADQ_UNIT_AS_UNIT} = numerator_unit_of_measure
                  THEN coalesce(form_size, 1D) * numerator ELSE numerator END
      WHEN quantity_denominator = 'unit'
        THEN {strength_sql("bnf_name", ADQ_UNIT)}
      ELSE numerator
    END"""


def quantity_in_adq_units() -> Column:
    """How much of the ADQ's own unit one prescribed unit holds, before doses."""
    return F.expr(QUANTITY_IN_ADQ_UNITS)


def adq_per_quantity() -> Column:
    """Average daily quantities held by one unit of prescribed quantity.

    NULL where the rules give none, where the amount is 0 and where the sheet's
    ADQ value is 0.
    """
    return F.expr(f"""
        try_divide(nullif({QUANTITY_IN_ADQ_UNITS}, 0D) * try_cast(dose_multiplier AS double),
                   try_cast(adq_value AS double))""")
