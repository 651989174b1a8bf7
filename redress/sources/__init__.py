"""Readers: the complaints table, the view over the driver's tables, narratives."""

from redress.sources.complaints import (
    COMPLAINT_COLUMNS,
    COMPLAINT_SCHEMA,
    NULL_PROFILE_COLUMNS,
    read_complaints,
)
from redress.sources.tpch_view import VIEW_SQL, complaints_view

__all__ = [
    "COMPLAINT_COLUMNS",
    "COMPLAINT_SCHEMA",
    "NULL_PROFILE_COLUMNS",
    "VIEW_SQL",
    "complaints_view",
    "read_complaints",
]
