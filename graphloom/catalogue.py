"""Every query of the engine by name, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from graphloom.queries import graphs, patterns, project, relational, texts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = graphs.QUERIES | relational.QUERIES | texts.QUERIES | project.QUERIES | patterns.QUERIES
ORACLE_SQL: dict[str, str] = graphs.ORACLE_SQL | relational.ORACLE_SQL | texts.ORACLE_SQL | project.ORACLE_SQL | patterns.ORACLE_SQL
