"""All registered queries and their SQL counterparts."""

from __future__ import annotations

from . import files, records, relational, texts  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
