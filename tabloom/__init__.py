"""A Spark-native engine that turns spreadsheet-like tables into related tables."""

__version__ = "0.1.0"

from tabloom.config import Config, load_config, validate_config
from tabloom.plans.pipeline import Pipeline, Result

__all__ = ["Config", "Pipeline", "Result", "__version__", "load_config", "validate_config"]
