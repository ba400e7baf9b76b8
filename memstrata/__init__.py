"""Provenance-aware memory analytics as Spark jobs."""

from .config import EngineConfig, ModelPrice, price_table
from .session import Workspace, utc_session

__all__ = ["EngineConfig", "ModelPrice", "Workspace", "price_table", "utc_session"]
