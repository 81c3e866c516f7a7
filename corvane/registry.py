"""Every query of the engine, with the DuckDB SQL that returns the same rows where SQL can express it."""

from corvane.plans.oracle import ORACLE_SQL
from corvane.plans.queries import QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
