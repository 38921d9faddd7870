"""Importing this package registers every query."""

from matchspark.plans.catalog import intervals, ledger, linking, merges, moments, planning, quality, reviews, selection, sources, stories, streams, telemetry, text, tracks  # noqa: F401
from matchspark.plans.registry import ORACLES, QUERIES  # noqa: F401
