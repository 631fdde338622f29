"""Every registered query of the library proper, with its DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallystone.plans import blocks, chains, claims, entities, fusion, graphs, mail, nested, placement, ranks, registers, relational, rules, stateful, telemetry, temporal

_FAMILIES = (fusion, relational, chains, telemetry, entities, temporal, claims, rules, placement, stateful, registers, graphs, blocks, nested, ranks, mail)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: v for m in _FAMILIES for k, v in m.QUERIES.items()}
ORACLES: dict[str, str] = {k: v for m in _FAMILIES for k, v in m.ORACLES.items()}
