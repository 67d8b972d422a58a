"""Registered queries of the library."""

from epispark.plans import folders, forecasts, records, reports, streams
from epispark.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "folders", "forecasts", "records", "reports", "streams"]
