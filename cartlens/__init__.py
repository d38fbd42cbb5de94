"""Commerce and fulfilment analytics expressed as Spark DataFrame plans."""

from cartlens.config import AnalysisConfig, ConfigError

__all__ = ["AnalysisConfig", "ConfigError"]
