"""Connectors as Spark data sources: contract, registry, change-stream checks and retries.

A connector is a Python Data Source. A full sync is its batch reader (a page is a partition), an
incremental sync its stream reader (the provider's cursor is the stream's offset).
"""

from __future__ import annotations

import hashlib
import json
import random
from collections.abc import Callable, Iterator
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

CHANGE = "type string, provider string, change_id string, seq int, external_id string, title string, content string, cursor string"
UPSERT, DELETE, PERMISSION, CURSOR = "UPSERT", "DELETE", "PERMISSION_CHANGED", "CURSOR_ADVANCED"


class ConnectorError(Exception):
    """A provider's failure; ``retryable`` ones are tried again, others fail the sync."""

    retryable = False


class RateLimited(ConnectorError):
    retryable = True


class Unavailable(ConnectorError):
    retryable = True


class Unauthorized(ConnectorError):
    """The connection needs a new authorisation."""


class CursorInvalid(ConnectorError):
    """The provider forgot the cursor: a full sync must follow."""


def change_id(provider: str, external_id: str, version: str) -> str:
    """Identity of a change: the digest of its canonical JSON."""
    body = {"external_id": external_id, "provider": provider, "version": version}
    return hashlib.sha256(json.dumps(body, ensure_ascii=False, separators=(",", ":"), sort_keys=True).encode()).hexdigest()


def with_retry(call: Callable, attempts: int = 5, sleep: Callable[[float], None] = lambda s: None, draw: Callable[[], float] = random.random, most: float = 30.0):
    """Runs ``call`` with full jitter between tries; a provider's own waiting time wins."""
    for n in range(1, attempts + 1):
        try:
            return call()
        except ConnectorError as e:
            if not e.retryable or n == attempts:
                raise
            told = getattr(e, "retry_after", None)
            sleep(min(most, told) if told is not None else min(most, 0.5 * 2 ** (n - 1)) * draw())


class Registry:
    """Providers and their data sources; a provider is registered once."""

    def __init__(self) -> None:
        self._known: dict[str, type[DataSource]] = {}

    def register(self, provider: str, source: type[DataSource]) -> None:
        if provider in self._known:
            raise ValueError(f"{provider} is registered already")
        if source.name() != provider:
            raise ValueError(f"{source.name()} does not serve {provider}")
        self._known[provider] = source

    @property
    def providers(self) -> list[str]:
        return sorted(self._known)

    def install(self, spark: SparkSession) -> None:
        for source in self._known.values():
            spark.dataSource.register(source)


def check_changes(changes: DataFrame, provider: str) -> DataFrame:
    """(rule, rows) of what is wrong with a change stream: foreign provider, repeated change id,
    rows behind the cursor, no or more than one cursor. Empty if the stream keeps the contract."""
    ends = changes.agg(F.count_if(F.col("type") == CURSOR).alias("cursors"), F.max(F.when(F.col("type") == CURSOR, F.col("seq"))).alias("at"), F.max("seq").alias("last"))
    whole = ends.select(
        F.explode(
            F.array(
                F.struct(F.lit("cursor").alias("rule"), F.when(F.col("cursors") != 1, F.greatest(F.lit(1), F.col("cursors"))).otherwise(0).cast("long").alias("rows")),
                F.struct(F.lit("after cursor").alias("rule"), F.when(F.col("at") < F.col("last"), F.col("last") - F.col("at")).otherwise(0).cast("long").alias("rows")),
            )
        ).alias("x")
    ).select("x.*")
    foreign = changes.agg(F.lit("provider").alias("rule"), F.count_if(~F.col("provider").eqNullSafe(F.lit(provider))).alias("rows"))
    twice = changes.where(F.col("change_id").isNotNull()).groupBy("change_id").count().where("count > 1").agg(F.lit("change id").alias("rule"), F.count("*").alias("rows"))
    return whole.unionByName(foreign).unionByName(twice.select("rule", "rows")).where("rows > 0")


# --- an in-memory connector ---------------------------------------------------------------------
class _Page(InputPartition):
    def __init__(self, rows: list[tuple]):
        super().__init__(rows)
        self.rows = rows


def demo_changes(start: int) -> list[tuple]:
    """What the in-memory provider has to tell from position ``start`` (0 to 2) on."""
    if not 0 <= start <= 2:
        raise CursorInvalid(f"position {start}")
    story = [(UPSERT, "a", "First", "hello"), (PERMISSION, "a", None, None), (DELETE, "a", None, None)]
    rows = [(kind, "demo", change_id("demo", x, f"{n}"), n, x, title, text, None) for n, (kind, x, title, text) in enumerate(story) if n >= start]
    return [*rows, (CURSOR, "demo", change_id("demo", "cursor", "3"), 3, None, None, None, json.dumps({"position": 3}))]


class _DemoReader(DataSourceReader):
    def __init__(self, options: dict):
        self.start = int(options.get("position", 0))

    def partitions(self) -> list[InputPartition]:
        rows = demo_changes(self.start)
        return [_Page(rows[i : i + 2]) for i in range(0, len(rows), 2)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from partition.rows


class _DemoStream(SimpleDataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"position": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        at = start["position"]
        return iter(demo_changes(at) if at < 3 else []), {"position": 3}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter(demo_changes(start["position"]) if start["position"] < end["position"] else [])


class DemoSource(DataSource):
    """The in-memory connector; ``spark.read.format("demo")``."""

    @classmethod
    def name(cls) -> str:
        return "demo"

    def schema(self) -> str:
        return CHANGE

    def reader(self, schema) -> DataSourceReader:
        return _DemoReader(self.options)

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _DemoStream()


def utc(text: str) -> datetime:
    """A provider's ISO timestamp; anything without a zone is refused."""
    at = datetime.fromisoformat(text)
    if at.tzinfo is None:
        raise ValueError(f"{text} has no zone")
    return at.astimezone(UTC)
