"""Queries on the driver tables, one module per family."""

from growthlens.queries import files, jobs, outlook, quality, schools, shaping, timeseries
from growthlens.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "files", "jobs", "outlook", "quality", "schools", "shaping", "timeseries"]
