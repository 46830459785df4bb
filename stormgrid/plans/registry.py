"""Every query by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stormgrid.plans import evaluation, fields, fitted, live, scans, stateful, tables, verification

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
for _m in (verification, fields, live, evaluation, scans, stateful, fitted, tables):
    QUERIES.update(_m.QUERIES)
    ORACLES.update(_m.ORACLES)
