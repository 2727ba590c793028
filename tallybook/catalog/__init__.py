"""All registered queries."""

from . import accounts, commands, rates, read_side, reports, settlement, streams  # noqa: F401
from .registry import REGISTRY, Query

__all__ = ["REGISTRY", "Query"]
