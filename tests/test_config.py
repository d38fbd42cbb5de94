import datetime as dt

import pytest

from cartlens.config import AnalysisConfig, ConfigError
from sample import CONFIG


def test_round_trip_and_types():
    assert CONFIG.analysis_start == dt.date(2020, 1, 1)
    assert CONFIG.observation_end == dt.datetime(2020, 4, 30, 23, 59, 59)
    assert AnalysisConfig.from_mapping(CONFIG.as_dict()) == CONFIG


@pytest.mark.parametrize(
    "values, message",
    [
        ({"analysis_end": "2019-12-31"}, "analysis_start"),
        ({"analysis_start": "soon"}, "analysis_start"),
        ({"observation_end": "2020-04-29 10:00:00"}, "observation_end"),
        ({"observation_end": "2020-05-01T00:00:00+00:00"}, "time zone"),
        ({"min_state_orders": True}, "min_state_orders"),
        ({"min_group_orders": 0}, "min_group_orders"),
        ({"min_group_orders": "5"}, "min_group_orders"),
    ],
)
def test_invalid_values_are_refused(values, message):
    with pytest.raises(ConfigError, match=message):
        AnalysisConfig.from_mapping(CONFIG.as_dict() | values)


def test_missing_parameter_is_named():
    values = CONFIG.as_dict()
    del values["observation_end"]
    with pytest.raises(ConfigError, match="observation_end"):
        AnalysisConfig.from_mapping(values)
