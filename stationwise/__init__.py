"""Station-relative extreme-event analytics expressed as Spark DataFrame operators."""

from stationwise.config import ClimateConfig, SelectionConfig, SpatialConfig, StormConfig

__all__ = ["ClimateConfig", "SelectionConfig", "SpatialConfig", "StormConfig"]
