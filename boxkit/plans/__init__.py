"""Registered queries: which operators run on which tables."""

from ..registry import ORACLES, QUERIES
from . import filters, fusion, joins, scoring, search, sources, stats, streams, survey, tracks, udfs
from . import folds  # the SQL of what the others have registered

__all__ = ["ORACLES", "QUERIES", "filters", "folds", "fusion", "joins", "scoring", "search", "sources", "stats", "streams", "survey", "tracks", "udfs"]
