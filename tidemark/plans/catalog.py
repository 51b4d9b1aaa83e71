"""All registered queries of the core with their SQL oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.operators import changes, filters, hierarchy, indexing, lanes, store, sync
from tidemark.sources import drive, history, mail
from tidemark.streaming import sync as streams

_MODULES = (hierarchy, changes, indexing, lanes, filters, store, sync, mail, history, drive, streams)
QUERIES: dict = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLES: dict[str, str] = {k: s for m in _MODULES for k, s in m.ORACLES.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid search over all four lanes."""
    return lanes.hybrid_search(spark, sf_dir)
