"""Sync bookkeeping: cursors, seen marks, leases, outbox and search logs, as frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.operators.indexing import NAMESPACE, sql_uuid5
from tidemark.operators.store import insert_absent, newest, upsert
from tidemark.session import table


def commit_cursors(present: DataFrame, pages: DataFrame) -> DataFrame:
    """The highest history id of every connection as its cursor; the version counts the commits."""
    top = pages.withColumn("h", F.expr("try_cast(history_id AS decimal(38,0))")).where("h IS NOT NULL AND connection_id IS NOT NULL").groupBy("connection_id").agg(F.max_by("history_id", F.struct("h", "history_id")).alias("cursor"))
    return upsert(present, top, ["connection_id"], "version")


def mark_seen(sources: DataFrame, listing: DataFrame, marker: str, keys: list[str]) -> DataFrame:
    """Sources with the marker of the run that named them; others keep theirs."""
    named = listing.select(*keys).distinct().withColumn("_new", F.lit(marker))
    return sources.join(named, keys, "left").withColumn("marker", F.coalesce("_new", "marker")).drop("_new")


def not_marked(sources: DataFrame, marker: str) -> DataFrame:
    """Sources whose marker differs from the run's; a missing one differs too."""
    return sources.where(~F.col("marker").eqNullSafe(F.lit(marker)))


def claimable(jobs: DataFrame, now, attempts: int = 5) -> DataFrame:
    """Jobs with what a claim would find: open, with a lease that ran out, leased, or given up."""
    spent = F.col("attempts") >= attempts
    expired = F.col("lease_until").isNull() | (F.col("lease_until") <= now)
    state = F.when(expired & spent, "dead_letter").when(expired & (F.col("available_at") <= now), "claimable").when(expired, "waiting").otherwise("leased")
    return jobs.withColumn("claim", state)


def event_rows(changes: DataFrame, kind: str, name: list[str]) -> DataFrame:
    """Outbox rows with ids made from their content, so that a replay appends nothing new."""
    key = F.concat_ws(":", F.lit(kind), *[F.col(c).cast("string") for c in name])
    return changes.select(X.uuid5(F.lit(NAMESPACE), key).alias("event_id"), F.lit(kind).alias("event_type"), *name)


# --- registered queries -------------------------------------------------------------------------
def cursor_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cursors after the pages of 2024 and then those since."""
    p = table(spark, sf_dir, "gmail_history_pages").select("connection_id", "history_id", "received_at")
    year = F.year("received_at")
    none = spark.createDataFrame([], "connection_id string, cursor string, version int")
    return commit_cursors(commit_cursors(none, p.where(year < 2025)), p.where(year >= 2025))


def seen_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items per connection that the last listing of 2025 did not mark."""
    i = table(spark, sf_dir, "drive_items").select("connection_id", "item_id", "fetched_at")
    keys = ["connection_id", "item_id"]
    s = mark_seen(i.select(*keys).distinct().withColumn("marker", F.lit(None).cast("string")), i.where(F.year("fetched_at") == 2025), "run-2025", keys)
    return s.groupBy("connection_id").agg(F.count("*").alias("items"), F.count_if(~F.col("marker").eqNullSafe(F.lit("run-2025"))).alias("unmarked"))


def lease_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs of the event log by claim state: errors are attempts, a view takes a lease of two minutes."""
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.count_if(F.col("event_type") == "error").alias("attempts"),
        (F.max(F.when(F.col("event_type") == "view", F.col("ts"))) + F.expr("INTERVAL '2' MINUTE")).alias("lease_until"),
        F.min("ts").alias("available_at"),
    )
    return claimable(e, F.lit("2024-01-29").cast("timestamp_ntz")).groupBy("claim").agg(F.count("*").alias("jobs"), F.max("attempts").alias("attempts"))


def outbox_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of deliveries; pages delivered again append nothing."""
    p = table(spark, sf_dir, "gmail_history_pages").where("history_id <> ''").select("connection_id", "history_id", "page_no")
    rows = event_rows(p, "page", ["connection_id", "history_id", "page_no"])
    return insert_absent(rows.limit(0), rows, ["event_id"])


def search_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log entry per title searched: results, whether there was evidence, and its purge date."""
    d = table(spark, sf_dir, "documents").where("title <> ''").select(F.lower("title").alias("query"), "modified_at")
    g = d.groupBy("query").agg(F.count("*").alias("results"), F.max("modified_at").alias("asked_at"))
    return g.select("query", "results", F.when(F.col("results") > 1, "completed").otherwise("insufficient_evidence").alias("status"), (F.col("asked_at") + F.expr("INTERVAL '30' DAY")).alias("purge_after"))


def previous_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each listing of an item with the one it supersedes."""
    i = table(spark, sf_dir, "drive_items").select("connection_id", "item_id", "modified_at", "fetched_at").distinct()
    w = Window.partitionBy("connection_id", "item_id").orderBy("modified_at", "fetched_at")
    return i.withColumn("previous", F.lag("modified_at").over(w))


def scope_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of documents that a connection lost or won between 2024 and 2025."""
    d = table(spark, sf_dir, "documents").where("source IS NOT NULL").withColumn("y", F.year("modified_at"))
    g = d.groupBy("connection_id").agg(F.collect_set(F.when(F.col("y") == 2024, F.col("source"))).alias("a"), F.collect_set(F.when(F.col("y") == 2025, F.col("source"))).alias("b"))
    show = lambda x, y: F.array_join(F.array_sort(F.array_except(x, y)), ",")
    return g.select("connection_id", show("a", "b").alias("lost"), show("b", "a").alias("won"))


def membership_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Workspaces with their connections in order of label."""
    c = table(spark, sf_dir, "connections")
    rows = F.transform(F.array_sort(F.collect_list(F.struct("display_label", "connection_id"))), lambda x: x["connection_id"])
    return c.groupBy("workspace_id").agg(F.array_join(rows, ",").alias("connections"), F.count_if(F.col("status") == "active").alias("active"))


def save_connection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connections saved again by label: the newest identity per workspace and label, with one job each."""
    c = table(spark, sf_dir, "connections")
    kept = newest(c, ["workspace_id", "provider", "display_label"], F.desc("connection_id"))
    return kept.select("connection_id", "provider", X.uuid5(F.lit(NAMESPACE), F.concat(F.lit("initial:"), "connection_id")).alias("job_id"), F.lit(0).alias("attempts"))


_H = "SELECT connection_id, history_id, CAST(history_id AS HUGEINT) AS h, year(received_at) AS y FROM gmail_history_pages WHERE history_id <> ''"
ORACLES = {
    "outbox_append": f"SELECT DISTINCT {sql_uuid5(f"'{NAMESPACE}'", "'page:' || connection_id || ':' || history_id || ':' || page_no")} AS event_id, 'page' AS event_type, connection_id, history_id, page_no FROM gmail_history_pages WHERE history_id <> ''",
    "save_connection": f"SELECT connection_id, provider, {sql_uuid5(f"'{NAMESPACE}'", "'initial:' || connection_id")} AS job_id, 0 AS attempts FROM (SELECT *, row_number() OVER (PARTITION BY workspace_id, provider, display_label ORDER BY connection_id DESC) AS n FROM connections) WHERE n = 1",
    "cursor_upsert": f"""WITH p AS ({_H}), a AS (SELECT connection_id, max_by(history_id, h) AS c FROM p WHERE y < 2025 GROUP BY 1), b AS (SELECT connection_id, max_by(history_id, h) AS c FROM p WHERE y >= 2025 GROUP BY 1)
SELECT coalesce(b.connection_id, a.connection_id) AS connection_id, coalesce(b.c, a.c) AS cursor, CASE WHEN a.c IS NOT NULL AND b.c IS NOT NULL THEN 2 ELSE 1 END AS version FROM a FULL JOIN b ON a.connection_id = b.connection_id""",
    "seen_marks": "SELECT connection_id, count(*) AS items, count(*) FILTER (NOT seen) AS unmarked FROM (SELECT connection_id, item_id, bool_or(coalesce(year(fetched_at) = 2025, false)) AS seen FROM drive_items GROUP BY 1, 2) GROUP BY 1",
    "lease_claims": """
WITH j AS (SELECT user_id, count(*) FILTER (event_type = 'error') AS attempts, max(ts) FILTER (event_type = 'view') + INTERVAL 2 MINUTE AS lease_until, min(ts) AS available_at FROM events GROUP BY 1)
SELECT CASE WHEN lease_until IS NULL OR lease_until <= TIMESTAMP '2024-01-29' THEN CASE WHEN attempts >= 5 THEN 'dead_letter' WHEN available_at <= TIMESTAMP '2024-01-29' THEN 'claimable' ELSE 'waiting' END ELSE 'leased' END AS claim,
count(*) AS jobs, max(attempts) AS attempts FROM j GROUP BY 1""",
    "search_log": """
SELECT query, results, CASE WHEN results > 1 THEN 'completed' ELSE 'insufficient_evidence' END AS status, asked_at + INTERVAL 30 DAY AS purge_after
FROM (SELECT lower(title) AS query, count(*) AS results, max(modified_at) AS asked_at FROM documents WHERE title <> '' GROUP BY 1)""",
    "previous_version": "SELECT *, lag(modified_at) OVER (PARTITION BY connection_id, item_id ORDER BY modified_at NULLS FIRST, fetched_at NULLS FIRST) AS previous FROM (SELECT DISTINCT connection_id, item_id, modified_at, fetched_at FROM drive_items)",
    "scope_difference": """
WITH s AS (SELECT DISTINCT connection_id, source, year(modified_at) AS y FROM documents WHERE source IS NOT NULL),
g AS (SELECT connection_id, source, bool_or(coalesce(y = 2024, false)) AS a, bool_or(coalesce(y = 2025, false)) AS b FROM s GROUP BY 1, 2)
SELECT connection_id, coalesce(string_agg(source, ',' ORDER BY source) FILTER (a AND NOT b), '') AS lost, coalesce(string_agg(source, ',' ORDER BY source) FILTER (b AND NOT a), '') AS won FROM g GROUP BY 1""",
    "membership_order": "SELECT workspace_id, string_agg(connection_id, ',' ORDER BY display_label NULLS FIRST, connection_id) AS connections, count(*) FILTER (status = 'active') AS active FROM connections GROUP BY 1",
}
QUERIES = {f.__name__: f for f in (cursor_upsert, seen_marks, lease_claims, outbox_append, search_log, previous_version, scope_difference, membership_order, save_connection)}
