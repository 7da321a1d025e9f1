"""All registered queries. Importing a module registers its queries."""

from . import alerts, cycle, features, forecast, influence, ingest, prescribe, replies, serving, streams  # noqa: F401
from .common import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
