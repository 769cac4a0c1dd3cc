"""Scans and sinks."""

from kairos.sources.tables import DRIVER_TABLES, load_table  # noqa: F401
