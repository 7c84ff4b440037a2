"""Where the tables and models of one warehouse live."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass


@dataclass(frozen=True)
class Warehouse:
    """All paths below one folder or bucket prefix.

    Tables keyed by trip are stored in ``buckets`` of the key, a number that
    stays the same for the life of the warehouse: enough that a day's bucket is
    a file of moderate size, and a task holds a bucket.
    """

    base: str
    buckets: int = 16

    def _at(self, name: str) -> str:
        return f"{self.base.rstrip('/')}/{name}"

    @property
    def raw_trips(self) -> str:
        return self._at("raw_trips")

    @property
    def raw_zone(self) -> str:
        return self._at("raw/trips")

    @property
    def trips_enriched(self) -> str:
        return self._at("trips_enriched")

    @property
    def zone_daily_stats(self) -> str:
        return self._at("zone_daily_stats")

    @property
    def predictions(self) -> str:
        return self._at("trip_predictions")

    @property
    def unscorable(self) -> str:
        return self._at("unscorable_trips")

    @property
    def metrics(self) -> str:
        return self._at("model_metrics")

    @property
    def registry(self) -> str:
        return self._at("model_registry")

    def run(self, version: str, run_ts: dt.datetime) -> str:
        """What one training run keeps: prepared rows, features and model. Runs of one version differ in their time."""
        return self._at(f"models/{version}/{run_ts:%Y%m%dT%H%M%S%f}")
