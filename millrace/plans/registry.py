"""The registered queries and their SQL, gathered from the modules of this folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import alerts, behaviour, evaluate, graph, logs, mentions, parts, retrieval, streams, text

_MODULES = (behaviour, text, graph, retrieval, evaluate, streams, logs, mentions, alerts, parts)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLES: dict[str, str] = {k: v for m in _MODULES for k, v in m.ORACLES.items()}
FLAGSHIP = "d22_popular_top"
