"""careflow: a PySpark-native data engine for a safety-gated assistant."""

__version__ = "0.1.0"
