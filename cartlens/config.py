"""The five analysis parameters, validated once and then used as plan literals."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping
from dataclasses import dataclass


class ConfigError(ValueError):
    """The analysis parameters are missing or contradict each other."""


_FIELDS = (
    "analysis_start",
    "analysis_end",
    "observation_end",
    "min_state_orders",
    "min_group_orders",
)


def _parse(kind, name, value):
    try:
        return kind.fromisoformat(str(value))
    except ValueError as error:
        raise ConfigError(f"{name} is not an ISO value: {value!r}") from error


@dataclass(frozen=True)
class AnalysisConfig:
    """Reporting window (inclusive), observation cut-off and sample thresholds.

    The values become literals in every plan, so Catalyst folds them and pushes
    the window down to the Parquet scan instead of joining a parameter table.
    """

    analysis_start: dt.date
    analysis_end: dt.date
    observation_end: dt.datetime
    min_state_orders: int
    min_group_orders: int

    def __post_init__(self):
        if self.analysis_start > self.analysis_end:
            raise ConfigError("analysis_start is after analysis_end")
        if self.observation_end.tzinfo is not None:
            raise ConfigError("observation_end must not carry a time zone")
        if self.observation_end.date() < self.analysis_end:
            raise ConfigError("observation_end is before analysis_end")
        for name in ("min_state_orders", "min_group_orders"):
            value = getattr(self, name)
            if isinstance(value, bool) or not isinstance(value, int) or value < 1:
                raise ConfigError(f"{name} must be a positive integer")

    @classmethod
    def from_mapping(cls, values: Mapping) -> AnalysisConfig:
        absent = [name for name in _FIELDS if name not in values]
        if absent:
            raise ConfigError("missing parameters: " + ", ".join(absent))
        return cls(
            _parse(dt.date, "analysis_start", values["analysis_start"]),
            _parse(dt.date, "analysis_end", values["analysis_end"]),
            _parse(dt.datetime, "observation_end", values["observation_end"]),
            values["min_state_orders"],
            values["min_group_orders"],
        )

    def as_dict(self) -> dict:
        return {
            "analysis_start": self.analysis_start.isoformat(),
            "analysis_end": self.analysis_end.isoformat(),
            "observation_end": self.observation_end.isoformat(sep=" "),
            "min_state_orders": self.min_state_orders,
            "min_group_orders": self.min_group_orders,
        }
