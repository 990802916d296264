"""Retail analytics on Spark DataFrames."""

from tillroll.scope import Scope
from tillroll.tables import RetailTables

__all__ = ["RetailTables", "Scope"]
