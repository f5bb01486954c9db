"""All queries of the reference's own operators."""

from __future__ import annotations

from barograph.plans import adapters, checks, depth, guards, ingest, models, prices, scans, sentiments, texts, training  # noqa: F401
from barograph.plans.registry import ORACLES, QUERIES  # noqa: F401
