"""Data preparation on Spark: integrate, classify, corrupt, clean, encode, model, compare."""

from tablewright.operators.roles import ColumnRoles, classify_columns
from tablewright.session import build_session, configure

__all__ = ["ColumnRoles", "classify_columns", "build_session", "configure"]
