"""Structured Streaming jobs: archive, latency, live feed."""

from __future__ import annotations

# How often the jobs run a batch.
ARCHIVE_INTERVAL = {"processingTime": "10 seconds"}
LATENCY_INTERVAL = {"processingTime": "1 second"}
# Read what is there, then stop: the bounded run that replaces waiting for end markers.
DRAIN = {"availableNow": True}
