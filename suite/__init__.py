"""The registered queries, one module per group of operators."""

from importlib import import_module

GROUPS = ("sources", "projections", "joins", "aggregates", "rankings", "scalars", "graphs",
          "retrieval", "proposals", "planning", "streams", "models")


def load() -> None:
    for group in GROUPS:
        import_module(f"suite.{group}")
