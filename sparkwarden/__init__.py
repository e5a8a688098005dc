"""Log threat analytics as Spark DataFrame operations."""

from sparkwarden.config import Config
from sparkwarden.plans.engine import Engine

__all__ = ["Config", "Engine"]
