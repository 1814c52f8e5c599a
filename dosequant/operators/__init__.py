"""Table operators: DataFrames in, DataFrame out, nothing run until an action."""

from dosequant.operators.collapse import field_values, first_non_null, preview
from dosequant.operators.dispensing import squ_latest, squ_of, squ_pairs
from dosequant.operators.links import link_file_names, page_links
from dosequant.operators.normalise import (
    normalise_units,
    normalised_adqs,
    normalised_products,
)
from dosequant.operators.prescribing import (
    back_computed,
    practice_usage,
    representative_presentation,
)
from dosequant.operators.products import ingredient_counts, product_details
from dosequant.operators.quality import (
    high_usage,
    qa_summary,
    reject_report,
    usage_comparison,
    usage_delta,
)
from dosequant.operators.skew import join_apart

__all__ = [
    "back_computed",
    "field_values",
    "first_non_null",
    "high_usage",
    "ingredient_counts",
    "join_apart",
    "link_file_names",
    "normalise_units",
    "normalised_adqs",
    "normalised_products",
    "page_links",
    "practice_usage",
    "preview",
    "product_details",
    "qa_summary",
    "reject_report",
    "representative_presentation",
    "squ_latest",
    "squ_of",
    "squ_pairs",
    "usage_comparison",
    "usage_delta",
]
