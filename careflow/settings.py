"""Settings from the environment, read once, and the session."""

from __future__ import annotations

import os
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import SparkSession


def _env(name: str, default: str):
    return field(default_factory=lambda: os.getenv(name, default))


def _path(name: str, default: str):
    return field(default_factory=lambda: Path(os.getenv(name, default)))


@dataclass(frozen=True)
class Settings:
    """A variable that is set to the empty text is not replaced by the default."""

    environment: str = _env("CAREFLOW_ENV", "development")
    data_dir: Path = _path("CAREFLOW_DATA_DIR", "data")
    log_dir: Path = _path("CAREFLOW_LOG_DIR", "logs")
    database_path: Path = _path("CAREFLOW_DB_PATH", "data/processed/careflow.db")
    log_level: str = _env("LOG_LEVEL", "INFO")


settings = Settings()


def session(app: str = "careflow", master: str | None = None, **conf: str) -> SparkSession:
    """A session with what the engine's results depend on (UTC) and adaptive execution."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        builder = builder.master(master)
    for k, v in conf.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
