"""The versioned store: upserts, child rows, tombstones, promotion and the sync log.

Tables are frames; a write makes the next state of a table from the present one and a batch, so
every operation is a join or a window and can be repeated without effect.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import hierarchy
from tidemark.session import table


def newest(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of every key in the given order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def upsert(present: DataFrame, batch: DataFrame, keys: list[str], version: str = "lock_version") -> DataFrame:
    """Rows of the batch replace those with their key; the version counts the writes."""
    old = present.select(*keys, F.col(version).alias("_v"))
    written = batch.join(old, keys, "left").withColumn(version, F.coalesce(F.col("_v") + 1, F.lit(1))).drop("_v")
    return present.join(batch.select(*keys), keys, "left_anti").unionByName(written)


def replace_children(present: DataFrame, batch: DataFrame, parent: list[str]) -> DataFrame:
    """All children of the batch's parents are exchanged for those in the batch."""
    return present.join(batch.select(*parent).distinct(), parent, "left_anti").unionByName(batch.distinct())


def insert_absent(present: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new keys are added, each key once; a replay adds nothing."""
    return present.unionByName(batch.dropDuplicates(keys).join(present.select(*keys), keys, "left_anti"))


def tombstone(sources: DataFrame, gone: DataFrame, key: str, at: Column) -> DataFrame:
    """Marks sources as deleted and blanks their title; those already deleted stay as they are."""
    marked = sources.join(gone.select(key).distinct().withColumn("_gone", F.lit(True)), key, "left")
    now = F.col("_gone").isNotNull() & (F.col("state") != "deleted")
    out = marked.withColumn("title", F.when(now, F.lit(None)).otherwise(F.col("title"))).withColumn("deleted_at", F.when(now, at).otherwise(F.col("deleted_at")))
    return out.withColumn("state", F.when(now, "deleted").otherwise(F.col("state"))).drop("_gone")


def usage_after(usage: DataFrame, removed: DataFrame, key: str) -> DataFrame:
    """Counts and bytes less what was removed, never below zero."""
    less = removed.groupBy(key).agg(F.count("*").alias("_n"), F.sum(F.coalesce("bytes", F.lit(0))).alias("_b"))
    u = usage.join(less, key, "left").fillna(0, ["_n", "_b"])
    return u.withColumn("sources", F.greatest(F.col("sources") - F.col("_n"), F.lit(0))).withColumn("bytes", F.greatest(F.col("bytes") - F.col("_b"), F.lit(0))).drop("_n", "_b")


def reconcile_gone(sources: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """Active sources that a full listing no longer named."""
    return sources.where("state = 'active'").join(seen.select(*keys), keys, "left_anti")


def promote(versions: DataFrame, finished: DataFrame) -> DataFrame:
    """Pending versions whose fingerprint the finished job repeats become ready, older ready ones superseded."""
    v = versions.join(finished.select("source_id", "version_no", F.col("fingerprint").alias("_f")), ["source_id", "version_no"], "left")
    v = v.withColumn("state", F.when((F.col("state") == "pending") & (F.col("_f") == F.col("fingerprint")), "ready").otherwise(F.col("state"))).drop("_f")
    last = F.max(F.when(F.col("state") == "ready", F.col("version_no"))).over(Window.partitionBy("source_id"))
    return v.withColumn("state", F.when((F.col("state") == "ready") & (F.col("version_no") < last), "superseded").otherwise(F.col("state")))


# --- registered queries -------------------------------------------------------------------------
def _order() -> list[Column]:
    """Newest listing first; equal times are told apart by name, first owner and size."""
    return [F.expr(e).desc_nulls_last() for e in ("fetched_at", "modified_at", "name", "get(owners, 0).normalized_identifier", "size_bytes")]


def _listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = table(spark, sf_dir, "drive_items")
    return i.select("connection_id", "item_id", "name", "size_bytes", "modified_at", "fetched_at", "owners")


def _cut_at(spark: SparkSession, sf_dir: str):
    """The instant that splits the listings into what is stored and what arrives."""
    return F.lit("2025-01-01").cast("timestamp_ntz")


def _sources(spark: SparkSession, sf_dir: str, before: bool) -> DataFrame:
    i = _listings(spark, sf_dir)
    i = i.where(F.col("fetched_at") < _cut_at(spark, sf_dir)) if before else i.where(F.col("fetched_at") >= _cut_at(spark, sf_dir))
    return newest(i, ["connection_id", "item_id"], *_order())


def upsert_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings of 2025 written over those before."""
    shown = ["connection_id", "item_id", "name", "fetched_at"]
    present = _sources(spark, sf_dir, True).select(*shown, F.lit(1).alias("lock_version"))
    return upsert(present, _sources(spark, sf_dir, False).select(*shown), ["connection_id", "item_id"])


def replace_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owners per item after the listings of 2025 replaced theirs."""
    def edges(before: bool) -> DataFrame:
        s = _sources(spark, sf_dir, before)
        return s.select("connection_id", "item_id", F.explode("owners").alias("o")).select("connection_id", "item_id", "o.identity_kind", "o.normalized_identifier").distinct()

    return replace_children(edges(True), edges(False), ["connection_id", "item_id"])


def insert_absent_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One version per distinct content of a chunk, the first insert wins."""
    c = table(spark, sf_dir, "chunks").where("content IS NOT NULL").select("source_id", F.hex("content_hash").alias("hash"), F.year("indexed_at").alias("year"))
    return insert_absent(c.where("year < 2025").select("source_id", "hash").distinct(), c.where("year >= 2025").select("source_id", "hash"), ["source_id", "hash"])


def tombstone_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of chunks' sources after paused or revoked connections were purged, with what remains in use."""
    c = table(spark, sf_dir, "chunks").groupBy("source_id", "connection_id").agg(F.max("modified_at").alias("modified_at"))
    s = c.select("source_id", "connection_id", F.lit("t").alias("title"), F.lit("active").alias("state"), F.lit(None).cast("timestamp_ntz").alias("deleted_at"))
    gone = s.join(table(spark, sf_dir, "connections").where("status <> 'active'"), "connection_id").select("source_id")
    t = tombstone(s, gone, "source_id", F.lit("2025-12-31").cast("timestamp_ntz"))
    return t.groupBy("connection_id", "state").agg(F.count("*").alias("sources"), F.count("title").alias("titles"))


def usage_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage per connection after the items modified before 2024-07 were removed twice: it stops at zero."""
    s = newest(_listings(spark, sf_dir), ["connection_id", "item_id"], *_order())
    usage = s.groupBy("connection_id").agg(F.count("*").alias("sources"), F.sum(F.coalesce("size_bytes", F.lit(0))).alias("bytes"))
    old = s.where("modified_at < TIMESTAMP_NTZ '2024-07-01'").select("connection_id", F.col("size_bytes").alias("bytes"))
    return usage_after(usage_after(usage, old, "connection_id"), old, "connection_id")


def cascade_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attachments that go with the messages deleted on some page: two equality joins instead of an OR."""
    p = table(spark, sf_dir, "gmail_history_pages")
    docs = p.select("connection_id", F.explode("documents").alias("d")).select("connection_id", F.col("d.external_id").alias("external_id")).where("external_id IS NOT NULL").distinct()
    gone = p.select("connection_id", F.explode("deleted_external_ids").alias("message_id")).distinct()
    own = docs.join(gone.withColumnRenamed("message_id", "external_id"), ["connection_id", "external_id"], "left_semi")
    part = docs.where(F.col("external_id").contains(":attachment:")).withColumn("message_id", F.substring_index("external_id", ":attachment:", 1))
    return own.unionByName(part.join(gone, ["connection_id", "message_id"], "left_semi").select("connection_id", "external_id")).distinct()


def left_current_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connections with their newest chunk, if any."""
    v = table(spark, sf_dir, "chunks").groupBy("connection_id").agg(F.max(F.struct("indexed_at", "chunk_id")).alias("m")).select("connection_id", F.col("m.chunk_id").alias("chunk_id"), F.col("m.indexed_at").alias("indexed_at"))
    return table(spark, sf_dir, "connections").select("connection_id", "status").join(v, "connection_id", "left")


def unchanged_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of 2025 whose fingerprint equals the stored one: no work for them."""
    f = lambda s: s.select("connection_id", "item_id", F.md5(F.concat_ws("|", "name", F.col("size_bytes").cast("string"), F.col("modified_at").cast("string"))).alias("fingerprint"))
    return f(_sources(spark, sf_dir, False)).join(f(_sources(spark, sf_dir, True)), ["connection_id", "item_id", "fingerprint"]).select("connection_id", "item_id")


def promotion_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions per state after jobs finished for every item listed twice or more."""
    i = _listings(spark, sf_dir).select("connection_id", "item_id", "fetched_at", F.md5(F.concat_ws("|", "name", F.col("modified_at").cast("string"))).alias("fingerprint")).distinct()
    w = Window.partitionBy("connection_id", "item_id").orderBy("fetched_at", "fingerprint")
    v = i.select(F.concat_ws("/", "connection_id", "item_id").alias("source_id"), F.row_number().over(w).alias("version_no"), "fingerprint", F.lit("pending").alias("state"))
    jobs = v.select("source_id", "version_no", F.when(F.pmod(F.col("version_no"), F.lit(3)) == 0, F.lit("stale")).otherwise(F.col("fingerprint")).alias("fingerprint"))
    return promote(v, jobs).groupBy("state").agg(F.count("*").alias("versions"), F.max("version_no").alias("last"))


def scalar_array_subquery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each connection with its sorted sources of documents and its newest document."""
    d = table(spark, sf_dir, "documents").groupBy("connection_id").agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"), F.max("modified_at").alias("newest"))
    return table(spark, sf_dir, "connections").select("connection_id").join(d, "connection_id", "left")


def history_last_action(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last action per message and day of events: later records win, a purchase closes its record."""
    e = table(spark, sf_dir, "events").where("event_type <> 'signup'")
    closes = (F.col("event_type") == "error").cast("int")
    last = F.max_by("event_type", F.struct(F.col("ts"), closes, F.col("event_id")))
    return e.groupBy("user_id", F.to_date("ts").alias("day")).agg(last.alias("action"), F.count("*").alias("records"))


def change_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per connection and history id: whether its pages form a whole stream (numbered from 0, one end, at the end)."""
    p = table(spark, sf_dir, "gmail_history_pages").where("history_id <> ''")
    g = p.groupBy("connection_id", "history_id").agg(
        F.countDistinct("page_no").alias("pages"),
        F.min("page_no").alias("first"),
        F.max("page_no").alias("last"),
        F.count("*").alias("deliveries"),
        F.max(F.when(F.col("next_page_token").isNull(), F.col("page_no"))).alias("end"),
    )
    ok = (F.col("first") == 0) & (F.col("pages") == F.col("last") + 1) & F.col("end").eqNullSafe(F.col("last")) & (F.col("deliveries") == F.col("pages"))
    return g.groupBy("connection_id").agg(F.count_if(ok).alias("whole"), F.count_if(~ok).alias("broken"))


def reconcile_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items stored before 2025 that no listing since has named."""
    present = _sources(spark, sf_dir, True).select("connection_id", "item_id", F.lit("active").alias("state"))
    return reconcile_gone(present, _sources(spark, sf_dir, False), ["connection_id", "item_id"]).select("connection_id", "item_id")


def run_barrier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per day: finished, open and failed jobs of a run, and whether it may be reconciled."""
    e = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg(
        F.count_if(F.col("event_type") == "purchase").alias("finished"), F.count_if(F.col("event_type").isin("click", "view")).alias("open"), F.count_if(F.col("event_type") == "error").alias("failed")
    )
    return e.withColumn("ready", (F.col("open") == 0) & (F.col("failed") == 0))


def exhausted_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' jobs by attempts: five errors or more are dead letters, else they may be claimed again."""
    e = table(spark, sf_dir, "events").where("event_type = 'error'").groupBy("user_id").agg(F.count("*").alias("attempts"), F.max("ts").alias("last"))
    return e.withColumn("state", F.when(F.col("attempts") >= 5, "dead_letter").otherwise("retry_wait"))


def queue_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten jobs to be claimed next: priority, then age, then key."""
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select("o_orderkey", F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"), "o_orderdate")
    return o.orderBy("priority", "o_orderdate", "o_orderkey").limit(10)


def folder_paths(spark: SparkSession, sf_dir: str, most: int = 100, longest: int = 8000) -> DataFrame:
    """Every way down to every Drive item, written in names as a listing does. Items with several
    parents have several; ways of more than ``most`` steps or ``longest`` characters are no listing
    paths, and items on loops have none beyond those that visit nothing twice."""
    items = table(spark, sf_dir, "drive_items")
    ways = hierarchy.hierarchy(items).where(F.col("depth").between(0, most)).select("c", "x", "root", "depth", F.split("path", hierarchy.SEP).alias("ids"))
    newest = F.max_by("name", F.struct("modified_at", "fetched_at", "is_folder", "parent_ids"))
    names = items.where("connection_id IS NOT NULL AND item_id IS NOT NULL").groupBy(F.col("connection_id").alias("c"), F.col("item_id").alias("id")).agg(newest.alias("name"))
    steps = ways.select("c", "x", "depth", F.xxhash64("ids").alias("way"), F.posexplode("ids").alias("at", "id")).join(names, ["c", "id"])
    each = steps.groupBy("c", "x", "depth", "way").agg(F.sort_array(F.collect_list(F.struct("at", F.coalesce("name", F.lit("")).alias("name")))).alias("steps"))  # at most ``most`` + 1
    path = F.array_join(F.transform("steps", lambda s: s["name"]), "/")
    return each.select(F.col("c").alias("connection_id"), F.col("x").alias("item_id"), "depth", path.alias("path")).where(F.length("path") <= longest)


_N = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY connection_id, item_id ORDER BY fetched_at DESC NULLS LAST, modified_at DESC NULLS LAST, name DESC NULLS LAST, owners[1].normalized_identifier DESC NULLS LAST, size_bytes DESC NULLS LAST) AS n FROM drive_items WHERE fetched_at {0} TIMESTAMP '2025-01-01') WHERE n = 1"
_PB = f"WITH p AS ({_N.format('<')}), b AS ({_N.format('>=')})"
_F = "md5(concat_ws('|', name, CAST(size_bytes AS VARCHAR), CAST(modified_at AS VARCHAR)))"
ORACLES = {
    "upsert_sources": f"""{_PB}
SELECT connection_id, item_id, name, fetched_at, 1 AS lock_version FROM p WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.connection_id = p.connection_id AND b.item_id = p.item_id)
UNION ALL SELECT b.connection_id, b.item_id, b.name, b.fetched_at, CASE WHEN p.item_id IS NULL THEN 1 ELSE 2 END FROM b LEFT JOIN p ON b.connection_id = p.connection_id AND b.item_id = p.item_id""",
    "replace_people": f"""{_PB}, pe AS (SELECT DISTINCT connection_id, item_id, o.identity_kind, o.normalized_identifier FROM (SELECT connection_id, item_id, unnest(owners) AS o FROM p)),
be AS (SELECT DISTINCT connection_id, item_id, o.identity_kind, o.normalized_identifier FROM (SELECT connection_id, item_id, unnest(owners) AS o FROM b))
SELECT * FROM be UNION ALL SELECT * FROM pe WHERE NOT EXISTS (SELECT 1 FROM be WHERE be.connection_id = pe.connection_id AND be.item_id = pe.item_id)""",
    "insert_absent_versions": "SELECT DISTINCT source_id, upper(hex(content_hash)) AS hash FROM chunks WHERE content IS NOT NULL AND indexed_at IS NOT NULL",
    "tombstone_purge": """
SELECT connection_id, CASE WHEN status <> 'active' THEN 'deleted' ELSE 'active' END AS state, count(*) AS sources, count(CASE WHEN status IS NULL OR status = 'active' THEN 1 END) AS titles
FROM (SELECT DISTINCT source_id, connection_id FROM chunks) LEFT JOIN connections USING (connection_id) GROUP BY 1, 2""",
    "usage_deltas": """
WITH s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY connection_id, item_id ORDER BY fetched_at DESC NULLS LAST, modified_at DESC NULLS LAST, name DESC NULLS LAST, owners[1].normalized_identifier DESC NULLS LAST, size_bytes DESC NULLS LAST) AS n FROM drive_items) WHERE n = 1),
u AS (SELECT connection_id, count(*) AS c, sum(coalesce(size_bytes, 0)) AS b, count(*) FILTER (modified_at < TIMESTAMP '2024-07-01') AS dc, coalesce(sum(coalesce(size_bytes, 0)) FILTER (modified_at < TIMESTAMP '2024-07-01'), 0) AS db FROM s GROUP BY 1)
SELECT connection_id, greatest(greatest(c - dc, 0) - dc, 0) AS sources, CAST(greatest(greatest(b - db, 0) - db, 0) AS BIGINT) AS bytes FROM u""",
    "cascade_children": """
WITH d AS (SELECT DISTINCT connection_id, doc.external_id AS external_id FROM (SELECT connection_id, unnest(documents) AS doc FROM gmail_history_pages) WHERE doc.external_id IS NOT NULL),
g AS (SELECT DISTINCT connection_id, unnest(deleted_external_ids) AS m FROM gmail_history_pages)
SELECT DISTINCT d.connection_id, external_id FROM d JOIN g ON d.connection_id = g.connection_id AND (external_id = m OR (contains(external_id, ':attachment:') AND split_part(external_id, ':attachment:', 1) = m))""",
    "left_current_version": "SELECT n.connection_id, n.status, m.chunk_id, m.indexed_at FROM connections n LEFT JOIN (SELECT * FROM (SELECT connection_id, chunk_id, indexed_at, row_number() OVER (PARTITION BY connection_id ORDER BY indexed_at DESC NULLS LAST, chunk_id DESC) AS r FROM chunks) WHERE r = 1) m USING (connection_id)",
    "unchanged_skip": f"{_PB} SELECT b.connection_id, b.item_id FROM (SELECT *, {_F} AS f FROM b) b JOIN (SELECT *, {_F} AS f FROM p) p USING (connection_id, item_id, f)",
    "promotion_guard": """
WITH v AS (SELECT connection_id, item_id, row_number() OVER (PARTITION BY connection_id, item_id ORDER BY fetched_at, f) AS no FROM (SELECT DISTINCT connection_id, item_id, fetched_at, md5(concat_ws('|', name, CAST(modified_at AS VARCHAR))) AS f FROM drive_items)),
r AS (SELECT *, no % 3 <> 0 AS ready FROM v), m AS (SELECT *, max(CASE WHEN ready THEN no END) OVER (PARTITION BY connection_id, item_id) AS top FROM r)
SELECT CASE WHEN NOT ready THEN 'pending' WHEN no < top THEN 'superseded' ELSE 'ready' END AS state, count(*) AS versions, CAST(max(no) AS INTEGER) AS last FROM m GROUP BY 1""",
    "scalar_array_subquery": "SELECT n.connection_id, d.sources, d.newest FROM connections n LEFT JOIN (SELECT connection_id, coalesce(string_agg(DISTINCT source, ',' ORDER BY source), '') AS sources, max(modified_at) AS newest FROM documents GROUP BY 1) d USING (connection_id)",
    "history_last_action": """
SELECT user_id, day, event_type AS action, records FROM (SELECT user_id, CAST(ts AS DATE) AS day, event_type, count(*) OVER (PARTITION BY user_id, CAST(ts AS DATE)) AS records,
row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts DESC, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END DESC, event_id DESC) AS n FROM events WHERE event_type <> 'signup') WHERE n = 1""",
    "change_contract": """
SELECT connection_id, count(*) FILTER (ok) AS whole, count(*) FILTER (NOT ok) AS broken FROM (
SELECT connection_id, history_id, min(page_no) = 0 AND count(DISTINCT page_no) = max(page_no) + 1 AND max(CASE WHEN next_page_token IS NULL THEN page_no END) IS NOT DISTINCT FROM max(page_no) AND count(*) = count(DISTINCT page_no) AS ok
FROM gmail_history_pages WHERE history_id <> '' GROUP BY 1, 2) GROUP BY 1""",
    "reconcile_absent": f"{_PB} SELECT connection_id, item_id FROM p WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.connection_id = p.connection_id AND b.item_id = p.item_id)",
    "run_barrier": """
SELECT day, finished, open, failed, open = 0 AND failed = 0 AS ready FROM (SELECT CAST(ts AS DATE) AS day, count(*) FILTER (event_type = 'purchase') AS finished, count(*) FILTER (event_type IN ('click', 'view')) AS open, count(*) FILTER (event_type = 'error') AS failed FROM events GROUP BY 1)""",
    "exhausted_jobs": "SELECT user_id, count(*) AS attempts, max(ts) AS last, CASE WHEN count(*) >= 5 THEN 'dead_letter' ELSE 'retry_wait' END AS state FROM events WHERE event_type = 'error' GROUP BY 1",
    "queue_head": "SELECT o_orderkey, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS priority, o_orderdate FROM orders WHERE o_orderstatus = 'O' ORDER BY 2, 3, 1 LIMIT 10",
    "folder_paths": hierarchy._WAYS + """
, step AS (SELECT c, x, depth, path, unnest(path) AS id, unnest(range(len(path))) AS at FROM way WHERE depth <= 100)
SELECT connection_id, item_id, depth, path FROM (
  SELECT s.c AS connection_id, s.x AS item_id, s.depth, string_agg(coalesce(k.name, ''), '/' ORDER BY s.at) AS path
  FROM step s JOIN cur k ON k.connection_id = s.c AND k.item_id = s.id GROUP BY s.c, s.x, s.depth, s.path) WHERE length(path) <= 8000""",
}
QUERIES = {f.__name__: f for f in (upsert_sources, replace_people, insert_absent_versions, tombstone_purge, usage_deltas, cascade_children, left_current_version, unchanged_skip, promotion_guard, scalar_array_subquery, history_last_action, change_contract, reconcile_absent, run_barrier, exhausted_jobs, queue_head, folder_paths)}
