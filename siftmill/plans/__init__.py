"""Every registered query of the library and its DuckDB text."""

from . import analytics, files, flows, hygiene, reports, retrieval, tables, texts  # noqa: F401
from .registry import ORACLE_SQL, QUERIES  # noqa: F401
