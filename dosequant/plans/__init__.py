"""Compositions of the operators into whole computations."""

from dosequant.plans.presentations import (
    adq_by_presentation,
    adq_inputs,
    computed_adqs,
)
from dosequant.plans.release import Release

__all__ = ["Release", "adq_by_presentation", "adq_inputs", "computed_adqs"]
