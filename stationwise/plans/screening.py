"""Station screening from inventory text to a thinned selection, as a run that can be stopped and gone on with.

Each stage writes its table once and then puts a small entry into the manifest of the
run's folder: the path, the rows, and a digest of the rules and of the stages before
it. A later call with the same rules starts from the stored tables; a changed rule
changes its stage and all behind it. Scores live in a store of committed runs: only
candidates without a finished result are read again, so stations that failed are
tried once more and the others are not.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from stationwise.config import ClimateConfig, SelectionConfig
from stationwise.operators import completeness, selection
from stationwise.operators.daymaps import bitmap_profile, day_bitmaps
from stationwise.operators.geography import continent_of
from stationwise.sinks.files import Files
from stationwise.sinks.store import RunStore
from stationwise.sources import daily as daily_source
from stationwise.sources.stations import parse_inventory_lines

STAGES = ("inventory", "candidates", "results", "selected", "thinned", "report")
FINISHED = ("ok", "not_found")


@dataclass(frozen=True)
class ScreeningInputs:
    """``statuses`` gives candidates a ``status``; ``observations`` the long observations of some stations.

    ``mark`` names the state of the inventory and the lookups: a new one starts the run anew.
    """

    inventory: DataFrame
    countries: DataFrame
    statuses: Callable[[DataFrame], DataFrame]
    observations: Callable[[DataFrame], DataFrame]
    mark: str = ""


def file_inputs(spark: SparkSession, inventory: str, countries: DataFrame, folder: str) -> ScreeningInputs:
    """Inputs from an inventory file and a folder of daily station files."""

    def observations(stations: DataFrame) -> DataFrame:
        read = daily_source.read_daily(spark, f"{folder}/*.dly")
        return read.join(stations.select("station_id"), "station_id", "left_semi")

    return ScreeningInputs(
        daily_source.read_lines(spark, inventory),
        countries,
        lambda candidates: daily_source.station_file_status(spark, folder, candidates),
        observations,
        f"{inventory} {folder}",
    )


class StagedRun:
    """Stages stored in a folder with their manifest entries."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.files = spark, Files(spark, folder)
        self.built: list[str] = []

    def entry(self, stage: str) -> dict | None:
        name = f"manifest/{stage}.json"
        return self.files.get(name) if self.files.exists(name) else None

    def stage(self, name: str, rules: object, build: Callable[[], DataFrame]) -> tuple[DataFrame, str]:
        """The stage's stored table and its digest; built only where the manifest has no such entry."""
        digest = hashlib.sha256(json.dumps(rules, sort_keys=True, default=str).encode()).hexdigest()
        known = self.entry(name)
        if known is None or known["digest"] != digest:
            path, counted = f"stages/{name}-{uuid.uuid4().hex}", Observation()
            frame = build()
            frame.observe(counted, F.count(F.lit(1)).alias("rows")).write.parquet(self.files.at(path))
            self.files.delete(f"manifest/{name}.json")
            schema = frame.schema.json()
            entry = {"digest": digest, "path": path, "rows": counted.get["rows"], "schema": schema}
            if not self.files.put_new(f"manifest/{name}.json", entry):
                raise RuntimeError(f"another run has just stored stage {name}")
            if known is not None:
                self.files.delete(known["path"])
            known = entry
            self.built.append(name)
        schema = StructType.fromJson(json.loads(known["schema"]))
        return self.spark.read.schema(schema).parquet(self.files.at(known["path"])), digest


def result_schema(config: ClimateConfig) -> StructType:
    years = f"valid_years_{config.trend_first_year}_{config.trend_last_year}"
    return StructType.fromDDL(
        "station_id string, lat double, lon double, country string, continent string, status string, "
        f"baseline_valid_years long, {years} long, meets_80_all_variables boolean, baseline_eligible boolean, "
        "enough_years_for_trend boolean, baseline_days_tmax long, baseline_days_tmin long, baseline_days_prcp long"
    )


def located(candidates: DataFrame, countries: DataFrame) -> DataFrame:
    """Candidates with country and continent; NULL for an unknown country code."""
    code = F.substring("station_id", 1, 2)
    known = countries.select("country_code", "country", F.col("continent").alias("listed"))
    found = candidates.withColumn("country_code", code).join(known, "country_code", "left")
    continent = F.when(F.col("country").isNotNull(), continent_of(F.col("country_code"), F.col("listed"), F.col("lon")))
    return found.withColumn("continent", continent).drop("country_code", "listed")


def scored(todo: DataFrame, inputs: ScreeningInputs, config: ClimateConfig) -> DataFrame:
    """One result row per station: its status and, where it could be read, its scores."""
    with_status = inputs.statuses(todo)
    readable = with_status.filter(F.col("status") == "ok").select("station_id")
    profile = bitmap_profile(day_bitmaps(inputs.observations(readable)), config)
    scores = completeness.station_scores(profile, config)
    schema = result_schema(config)
    counted = [f for f in schema.fields if f.name in scores.columns and f.name != "station_id"]
    joined = with_status.join(scores, "station_id", "left")
    # A station that could be read but holds no usable day scores nothing; others have no score.
    zero = {"bigint": F.lit(0).cast("long"), "boolean": F.lit(False)}
    own = [
        F.when(F.col("status") == "ok", F.coalesce(f.name, zero[f.dataType.simpleString()])).alias(f.name) for f in counted
    ]
    rest = [c for c in schema.names if c not in {f.name for f in counted}]
    return joined.select(*rest, *own)


def run_screening(
    spark: SparkSession,
    inputs: ScreeningInputs,
    folder: str,
    config: ClimateConfig = ClimateConfig(),
    rules: SelectionConfig = SelectionConfig(),
    stop_after: str | None = None,
) -> tuple[dict[str, DataFrame], list[str]]:
    """(tables by stage, names of the stages that this call built) under a folder that all executors share."""
    run, tables = StagedRun(spark, folder), {}
    chosen = asdict(rules)
    # Scores under other rules are other scores: they have a store of their own.
    scoring = hashlib.sha256(json.dumps([asdict(config), inputs.mark], sort_keys=True, default=str).encode()).hexdigest()
    store = RunStore(spark, f"{folder}/results-{scoring[:16]}", result_schema(config), ["station_id"])

    def finished() -> bool:
        return stop_after in tables

    tables["inventory"], digest = run.stage("inventory", [inputs.mark], lambda: parse_inventory_lines(inputs.inventory))
    if finished():
        return tables, run.built
    tables["candidates"], digest = run.stage(
        "candidates", [digest, chosen],
        lambda: located(selection.choose_candidates(tables["inventory"], rules), inputs.countries),
    )
    if finished():
        return tables, run.built
    todo = selection.still_to_screen(tables["candidates"], store.latest())
    if not todo.isEmpty():
        store.append(scored(todo, inputs, config))
        run.built.append("scoring")
    last = max((c.version for c in store.visible()), default=0)
    tables["results"], digest = run.stage(
        "results", [digest, scoring, last],
        lambda: store.latest().join(tables["candidates"].select("station_id"), "station_id", "left_semi"),
    )
    if finished():
        return tables, run.built
    years = f"valid_years_{config.trend_first_year}_{config.trend_last_year}"
    tables["selected"], digest = run.stage(
        "selected", [digest, chosen],
        lambda: selection.select_stations(tables["results"], rules, (years, "baseline_valid_years")),
    )
    if finished():
        return tables, run.built
    tables["thinned"], digest = run.stage("thinned", [digest, chosen], lambda: selection.thin_selection(tables["selected"], rules))
    if finished():
        return tables, run.built
    tables["report"], digest = run.stage(
        "report", [digest], lambda: selection.screening_report(tables["results"], tables["thinned"])
    )
    return tables, run.built
