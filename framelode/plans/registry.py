"""Every query by name, and the SQL that each must equal."""

from .queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
