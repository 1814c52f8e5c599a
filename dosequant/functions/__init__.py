"""Rules as Spark column expressions, given the names of the columns they read."""

from dosequant.functions.doses import dose_from_name, strength_from_name
from dosequant.functions.quantity import (
    adq_per_quantity,
    quantity_in_adq_units,
    quantity_unit,
)
from dosequant.functions.text import (
    file_name_of_url,
    null_if_token,
    rounded_to_tenth,
    run_date_label,
)
from dosequant.functions.units import normal_unit, scaled_number

__all__ = [
    "adq_per_quantity",
    "dose_from_name",
    "file_name_of_url",
    "normal_unit",
    "null_if_token",
    "quantity_in_adq_units",
    "quantity_unit",
    "rounded_to_tenth",
    "run_date_label",
    "scaled_number",
    "strength_from_name",
]
