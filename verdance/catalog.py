"""The registered queries over the driver tables and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .plans import images, rows, studies  # noqa: F401  they register their queries
from .plans.sample import ORACLE_SQL, QUERIES
from .plans.studies import growth_by_user

__all__ = ["ORACLE_SQL", "QUERIES", "DataFrame", "SparkSession", "growth_by_user"]
