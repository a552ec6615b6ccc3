"""Parameters of the rules, kept in frozen dataclasses.

The defaults are the published rules for daily climate stations. Every operator
takes the dataclass, so the same code runs on other station-like series with a
shorter record.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

ELEMENTS = ("TMAX", "TMIN", "PRCP")

# Event types as written by detection, and the short names used
# in the station summary and the dashboard tables.
HEATWAVE = "HEATWAVE"
COLD_SNAP = "COLD_SNAP"
DRY_SPELL = "DRY_SPELL"
HEAVY_RAIN = "HEAVY_RAIN"
COMPOUND = "COMPOUND_HEATWAVE_DRY_SPELL"

SHORT_NAMES = {
    HEATWAVE: "heatwave",
    COLD_SNAP: "cold",
    HEAVY_RAIN: "heavy_rain",
    DRY_SPELL: "dry_spell",
    COMPOUND: "compound",
}

# Summary event type -> yearly measure its trend is computed on.
TREND_MEASURES = {
    "hot_days": "hot_days",
    "heatwave": "heatwave_days",
    "cold": "coldsnap_days",
    "heavy_rain": "heavy_rain_days",
    "dry_spell": "longest_dry_spell",
    "compound": "compound_days",
}

# Dashboard labels.
EVENT_LABELS = {
    "hot_days": "Warm days",
    "heatwave": "Warm spells",
    "cold": "Cold snaps",
    "heavy_rain": "Heavy rain",
    "dry_spell": "Dry spells",
    "compound": "Compound",
}

CALENDAR_DAYS = 366


@dataclass(frozen=True)
class ClimateConfig:
    """Baseline, completeness, threshold and event rules."""

    baseline_start: dt.date = dt.date(1991, 1, 1)
    baseline_end: dt.date = dt.date(2020, 12, 31)
    trend_first_year: int = 1991
    trend_last_year: int = 2025
    valid_year_pct: float = 90.0
    element_completeness: float = 0.80
    min_baseline_valid_years: int = 25
    min_trend_years: int = 30

    window_days: int = 7
    hot_percentile: float = 0.95
    cold_percentile: float = 0.05
    rain_percentile: float = 0.95
    percentile_accuracy: int = 10000
    wet_day_mm: float = 1.0

    heat_min_days: int = 3
    cold_min_days: int = 3
    dry_min_days: int = 10

    @property
    def baseline_days(self) -> int:
        """Number of calendar days in the baseline, both ends included."""
        return (self.baseline_end - self.baseline_start).days + 1

    @property
    def baseline_years(self) -> tuple[int, int]:
        return self.baseline_start.year, self.baseline_end.year

    def min_run_days(self) -> dict[str, int]:
        return {
            HEATWAVE: self.heat_min_days,
            COLD_SNAP: self.cold_min_days,
            DRY_SPELL: self.dry_min_days,
        }


@dataclass(frozen=True)
class SpatialConfig:
    """Neighbour graph and risk-score rules."""

    neighbours: int = 5
    min_stations: int = 10
    level_weight: float = 0.6
    trend_weight: float = 0.4
    earth_radius_km: float = 6371.0088


@dataclass(frozen=True)
class StormConfig:
    """State-day comparison with an external storm record.

    ``max_record_days`` cuts longer records; the published rule is 120 days. Off by default: no day is lost.
    """

    tolerance_days: int = 1
    max_record_days: int | None = None
    country: str = "United States"


# Comparison category -> (our event types, storm-record types).
STORM_CATEGORIES = {
    "heatwave": ([HEATWAVE], ["Excessive Heat", "Heat"]),
    "cold_snap": (
        [COLD_SNAP],
        ["Extreme Cold/Wind Chill", "Cold/Wind Chill", "Frost/Freeze"],
    ),
    "heavy_rain": (
        [HEAVY_RAIN, "EXTREME_RAIN"],
        ["Heavy Rain", "Flash Flood", "Flood"],
    ),
    "dry_spell": ([DRY_SPELL], ["Drought"]),
}


@dataclass(frozen=True)
class SelectionConfig:
    """Candidate choice and spread-out station selection.

    The limits are off by default. The published screening uses 5 candidates per cell, 1,000 in all and 120 stations.
    """

    first_year: int = 1991
    last_year: int = 2024
    cell_degrees: float = 10.0
    candidates_per_cell: int | None = None
    max_candidates: int | None = None
    per_cell: int = 2
    min_separation_km: float = 300.0
    max_stations: int | None = None
    earth_radius_km: float = 6371.0088
    required: tuple[str, ...] = ("USW00094728", "USW00023174")


# Third letter of a station id -> preference when candidates tie.
NETWORK_PRIOR = {"W": 2, "M": 2, "N": 2, "E": 2}

# Country code split by longitude -> (degrees east, west, east).
CONTINENT_SPLIT = {"RS": (60.0, "Europe", "Asia")}

# Countries whose region is the state or province name.
SUBDIVISION_COUNTRIES = ("US", "CA")
