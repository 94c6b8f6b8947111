"""Every query of the engine by name, with the SQL that checks it where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import adverts, boards, evidence, texts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = boards.Q | texts.Q | evidence.Q | adverts.Q
ORACLE_SQL: dict[str, str] = boards.S | texts.S | evidence.S | adverts.S
