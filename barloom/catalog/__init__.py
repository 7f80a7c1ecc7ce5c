"""All registered queries."""

from importlib import import_module

from barloom.catalog.registry import ORACLES, QUERIES

for _part in ("bars", "features", "labels", "universe", "signals", "orders", "sources", "learning", "streams"):
    try:
        import_module(f"barloom.catalog.{_part}_queries")
    except ModuleNotFoundError as e:
        if "_queries" not in str(e):
            raise

__all__ = ["ORACLES", "QUERIES"]
