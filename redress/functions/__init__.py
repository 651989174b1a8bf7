"""Column-expression helpers and fixed lookup tables."""

from redress.functions.labels import (
    CLOSING_RESPONSES,
    ISSUE_ABBREVIATIONS,
    PRODUCT_ABBREVIATIONS,
    UNKNOWN,
    bool_text,
    map_labels,
    null_label,
)
from redress.functions.stats import chi2_p_value

__all__ = [
    "CLOSING_RESPONSES",
    "ISSUE_ABBREVIATIONS",
    "PRODUCT_ABBREVIATIONS",
    "UNKNOWN",
    "bool_text",
    "chi2_p_value",
    "map_labels",
    "null_label",
]
