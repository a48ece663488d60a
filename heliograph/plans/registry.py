"""All registered telemetry queries, and their SQL."""

from . import nested, related  # noqa: F401  (register their queries)
from .queries import ORACLES, QUERIES, flagship_roundtrip

__all__ = ["ORACLES", "QUERIES", "flagship_roundtrip"]
