"""Intraday market-data analytics on Spark DataFrames."""

from barloom.schemas import SessionSpec

__all__ = ["SessionSpec"]
