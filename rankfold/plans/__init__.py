"""Registered queries and their SQL twins."""

from . import filters, joins, learning, sources, streams, vectors  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
