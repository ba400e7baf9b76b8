"""Engine parameters, passed explicitly to every job builder."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal


@dataclass(frozen=True)
class EngineConfig:
    root_base: int = 3
    max_raw_characters: int = 4000
    max_observations: int = 3
    max_memory_characters: int = 4000
    search_candidates: int = 30
    recall_limit: int = 10
    neighbourhood_size: int = 20
    meditation_graph_limit: int = 80
    meditation_source_limit: int = 12
    max_query_terms: int = 64
    page_size: int = 25
    preview_characters: int = 240
    time_zone: str = "Asia/Seoul"

    def __post_init__(self) -> None:
        for name in ("root_base", "max_raw_characters", "max_observations",
                     "max_memory_characters", "search_candidates", "recall_limit",
                     "neighbourhood_size", "meditation_graph_limit", "meditation_source_limit"):
            if getattr(self, name) < 1:
                raise ValueError(f"{name} must be positive")
        if self.root_base < 2:
            raise ValueError("root_base must be at least 2")

    @classmethod
    def evaluation(cls) -> "EngineConfig":
        return cls(recall_limit=5, time_zone="UTC", max_observations=128)


@dataclass(frozen=True)
class ModelPrice:
    """USD per million tokens; the long-context factors apply to the whole request."""

    model: str
    input: Decimal
    cached_input: Decimal
    cache_write: Decimal
    output: Decimal
    long_context_threshold: int | None = None
    long_input_factor: Decimal = Decimal(1)
    long_output_factor: Decimal = Decimal(1)


PRICE_SCHEMA = (
    "model string, input_price decimal(18,6), cached_price decimal(18,6), "
    "write_price decimal(18,6), output_price decimal(18,6), long_threshold long, "
    "long_input_factor decimal(9,3), long_output_factor decimal(9,3)"
)


def price_table(spark, prices: list[ModelPrice]):
    """The price list as a frame; it holds one row per configured model."""
    rows = [(p.model, p.input, p.cached_input, p.cache_write, p.output,
             p.long_context_threshold, p.long_input_factor, p.long_output_factor)
            for p in prices]
    return spark.createDataFrame(rows, PRICE_SCHEMA)
