"""Fleet inventory and policy audit on Spark DataFrames."""

from fleetlens.settings import Settings

__all__ = ["Settings"]
