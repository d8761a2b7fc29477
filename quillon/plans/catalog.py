"""All registered queries of the library, by name."""

from quillon.plans import queries_files, queries_images, queries_reads, queries_tables  # noqa: F401
from quillon.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
