"""The whole chain from raw files to dashboard tables.

Every step writes its table once and the next step starts from the files, so no
step is computed twice and a lost executor costs at most one step.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from stationwise.config import ClimateConfig, SpatialConfig, StormConfig
from stationwise.operators import checks, completeness, dashboard, events, geography, panel, risk, storms
from stationwise.operators import thresholds as thresholds_op
from stationwise.operators import trends
from stationwise.operators.observations import daily_wide
from stationwise.sinks import writers
from stationwise.sources import daily as daily_source
from stationwise.sources import stations as station_source
from stationwise.sources.storms import read_storm_events


@dataclass(frozen=True)
class RawInputs:
    """Paths of the raw files. ``storms`` may be empty."""

    daily: str | Sequence[str]
    stations: str
    station_ids: str
    countries: str
    subdivisions: str
    storms: str | Sequence[str] = ()


def climate_tables(
    observations: DataFrame, folder: str, config: ClimateConfig = ClimateConfig()
) -> dict[str, DataFrame]:
    """Observations to wide days, eligibility, thresholds, means, flags and events."""

    def keep(name: str, frame: DataFrame) -> DataFrame:
        return writers.write_parquet(frame, f"{folder}/{name}")

    wide = keep("daily_wide", daily_wide(observations))
    profile = keep("yearly_profile", completeness.yearly_profile(wide, config))
    report = keep("station_completeness", completeness.completeness_report(profile, config))
    eligibility = keep("station_eligibility", completeness.station_eligibility(profile, config, report))
    allowed = thresholds_op.eligible_stations(report, eligibility)
    baseline = thresholds_op.baseline_slice(wide, config)
    limits = keep(
        "extreme_thresholds",
        thresholds_op.threshold_table(baseline.join(allowed, "station_id", "left_semi"), config),
    )
    means = keep("baseline_means", thresholds_op.baseline_means(baseline, config))
    flagged = keep("daily_flags", events.flag_days(wide, limits, config, means))
    found = writers.write_events(events.detect_events(flagged, config), f"{folder}/extreme_events")
    return {
        "wide": wide,
        "completeness": report,
        "eligibility": eligibility,
        "thresholds": limits,
        "means": means,
        "flagged": flagged,
        "events": found,
    }


def summary_tables(
    tables: dict[str, DataFrame],
    metadata: DataFrame | None,
    places: DataFrame | None,
    folder: str,
    config: ClimateConfig = ClimateConfig(),
    spatial: SpatialConfig = SpatialConfig(),
) -> dict[str, DataFrame]:
    """Tables A, B, C and E, checked, as Parquet and ordered CSV."""
    a = panel.station_year_metrics(tables["flagged"], tables["thresholds"], tables["events"], metadata, places)
    a = writers.write_parquet(a, f"{folder}/station_year_metrics")
    if not checks.duplicate_keys(a, ["station_id", "year"]).isEmpty():
        raise ValueError("a station and year has more than one row")
    if not checks.out_of_range_percent(a).isEmpty():
        raise ValueError("completeness outside 0..100")
    writers.require_rows(a, "station-year table")
    e = writers.write_parquet(panel.station_events(tables["events"]), f"{folder}/station_events")
    b = writers.write_parquet(trends.station_summary(a, config), f"{folder}/station_trends")
    faults = [row["rule"] for row in checks.summary_faults(b, a, config).filter("broken > 0").collect()]
    if faults:
        raise ValueError(f"Table B breaks its rules: {faults}")
    filled, c = risk.risk_and_hotspots(a, b, config, spatial)
    filled = writers.write_parquet(filled, f"{folder}/station_summary")
    c = writers.write_parquet(c, f"{folder}/global_stats")
    for name, frame, order in (
        ("station_year_metrics", a, ["station_id", "year"]),
        ("station_summary", filled, ["station_id", "event_type"]),
        ("global_stats", c, ["event_type"]),
        ("station_events", e, ["station_id", "start_date", "event_type"]),
    ):
        writers.write_ordered_csv(frame, f"{folder}/csv/{name}", order)
    return {"table_a": a, "table_b": filled, "table_c": c, "table_e": e}


def dashboard_tables(
    tables: dict[str, DataFrame], folder: str, config: ClimateConfig = ClimateConfig()
) -> list[str]:
    """Write both dashboard tables, or nothing when the event days do not add up."""
    a = tables["table_a"]
    long = dashboard.long_table(a, tables["table_b"], tables["table_c"], config)
    seasons = dashboard.season_table(a, tables["table_e"], config)
    problems = dashboard.failing_event_types(dashboard.reconciliation(a, seasons, config))
    writers.gated_write(
        problems,
        {
            "long": lambda: writers.write_ordered_csv(
                long, f"{folder}/csv/dashboard_data", ["event_type", "station_id", "year"]
            ),
            "seasons": lambda: writers.write_ordered_csv(
                seasons, f"{folder}/csv/dashboard_season", ["event_type", "station_id", "year", "season"]
            ),
        },
    )
    return problems


def run_chain(
    spark: SparkSession,
    inputs: RawInputs,
    folder: str,
    config: ClimateConfig = ClimateConfig(),
    spatial: SpatialConfig = SpatialConfig(),
    storm: StormConfig = StormConfig(),
) -> dict[str, DataFrame]:
    """Raw files to all tables under ``folder``, a folder every executor can reach."""
    observations = writers.write_parquet(daily_source.read_daily(spark, inputs.daily), f"{folder}/observations")
    tables = climate_tables(observations, folder, config)
    listed = station_source.parse_station_lines(daily_source.read_lines(spark, inputs.stations))
    wanted = station_source.read_station_ids(spark, inputs.station_ids)
    metadata = station_source.require_metadata(station_source.station_metadata(listed, wanted), wanted)
    metadata = writers.write_parquet(metadata, f"{folder}/station_metadata")
    places = writers.write_parquet(
        geography.station_geography(
            metadata,
            listed.select("station_id", "state"),
            station_source.read_countries(spark, inputs.countries),
            station_source.read_subdivisions(spark, inputs.subdivisions),
        ),
        f"{folder}/station_geography",
    )
    tables |= summary_tables(tables, metadata, places, folder, config, spatial)
    tables["problems"] = dashboard_tables(tables, folder, config)
    if inputs.storms:
        records = writers.write_parquet(read_storm_events(spark, inputs.storms), f"{folder}/storm_events")
        tables["storm_validation"] = writers.write_parquet(
            storms.validate_events(tables["events"], records, places, storm), f"{folder}/storm_validation"
        )
    return tables
