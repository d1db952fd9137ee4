"""All registered queries of the library."""

from . import adverts, batches, feeds, ingestion, matches, places, state, upkeep
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "adverts", "batches", "feeds", "ingestion", "matches", "places", "state", "upkeep"]
