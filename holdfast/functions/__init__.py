"""Column expressions shared by the operators (all JVM-side built-ins)."""

from holdfast.functions.columns import (
    exact,
    exact_sum,
    falsy_to_null,
    map_lookup,
    signed_quantity,
    slug,
    strict,
    truncate_date,
    weighted_average,
)

__all__ = [
    "exact",
    "exact_sum",
    "falsy_to_null",
    "map_lookup",
    "signed_quantity",
    "slug",
    "strict",
    "truncate_date",
    "weighted_average",
]
