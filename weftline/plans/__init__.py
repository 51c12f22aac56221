"""Queries over the driver's tables and the SQL that they must agree with."""

from weftline.plans import columns, extras, histories, joining, mappers, sequences, texts  # noqa: F401
from weftline.plans.registry import NO_SQL, ORACLE, QUERIES

__all__ = ["NO_SQL", "ORACLE", "QUERIES"]
