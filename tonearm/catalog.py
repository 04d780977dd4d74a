"""Every library query by name, with the SQL that gives the same rows."""

from .plans import analysis, device, export, ingest, jobs, library, surface
from .plans.base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "analysis", "device", "export", "ingest", "jobs", "library", "surface"]
