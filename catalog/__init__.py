"""Named queries over the sample tables, each with its check in plain SQL."""

from catalog import fits, runs, inputs, records, scores  # noqa: F401  (each registers its queries)
from catalog.base import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES"]
