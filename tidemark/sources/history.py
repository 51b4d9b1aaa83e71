"""Mail history pages as a source: what is to be done per message, documents, and labels as collections.

Defined results: deliveries count as in :mod:`tidemark.operators.changes` (of one page the last
received, pages without connection or numeric history id are left out); null arrays and null
elements hold nothing; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.changes import _LEFT, ATTACHMENT, KEY, last_deliveries
from tidemark.session import table

SEQ = ["hist", "page_no"]


def last_actions(pages: DataFrame) -> DataFrame:
    """(connection_id, external_id, action, records): within one record deletes come last, of several
    records the last one decides."""
    p = last_deliveries(pages)
    kept = p.select("connection_id", *SEQ, F.explode("documents.external_id").alias("external_id"), F.lit(False).alias("gone"))
    gone = p.select("connection_id", *SEQ, F.explode("deleted_external_ids").alias("external_id"), F.lit(True).alias("gone"))
    each = kept.unionByName(gone).where("external_id IS NOT NULL").groupBy(*KEY).agg(F.max(F.struct(*SEQ, "gone"))["gone"].alias("gone"), F.countDistinct(F.struct(*SEQ)).alias("records"))
    return each.select(*KEY, F.when(F.col("gone"), "delete").otherwise("upsert").alias("action"), "records")


def parts_of(pages: DataFrame) -> DataFrame:
    """Every message as 1 + N documents, each a source of its own: the message is part 0, attachments
    follow by their number. Of several images the last counts; contents travel as digests."""
    d = last_deliveries(pages).select("connection_id", *SEQ, F.posexplode("documents").alias("pos", "d")).where("d.external_id IS NOT NULL")
    d = d.select("connection_id", F.col("d.external_id").alias("external_id"), *SEQ, "pos", F.col("d.title").alias("title"), F.md5("d.content").alias("digest"), F.col("d.label_ids").alias("labels"))
    d = d.groupBy(*KEY).agg(F.max_by(F.struct("title", "digest", "labels"), F.struct(*SEQ, "pos")).alias("r")).select(*KEY, "r.*")
    number = F.expr(f"try_cast(substring_index(external_id, '{ATTACHMENT}', -1) AS int)")
    part = F.when(F.col("external_id").contains(ATTACHMENT), number).otherwise(0)
    return d.select("connection_id", F.substring_index("external_id", ATTACHMENT, 1).alias("message_id"), "external_id", part.alias("part"), "title", "digest", "labels")


def in_collections(rows: DataFrame, members: DataFrame, collections: DataFrame, keys: list[str], kind: str, ids: list[str]) -> DataFrame:
    """Rows with a membership in one of the collections of a kind: a semi join, rows stay single."""
    wanted = collections.where((F.col("kind") == kind) & F.col("collection_id").isin(ids)).select("collection_id")
    return rows.join(members.join(wanted, "collection_id", "left_semi"), keys, "left_semi")


# --- registered queries -------------------------------------------------------------------------
def history_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What all history pages leave to do per message."""
    return last_actions(table(spark, sf_dir, "gmail_history_pages"))


def message_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of all messages with their parts."""
    return parts_of(table(spark, sf_dir, "gmail_history_pages")).drop("labels")


def label_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages and attachments under one of two labels set by users."""
    parts = parts_of(table(spark, sf_dir, "gmail_history_pages")).select(*KEY, "labels")
    members = parts.select(*KEY, F.explode("labels").alias("collection_id"))
    collections = members.select("collection_id").distinct().withColumn("kind", F.when(F.col("collection_id").startswith("Label_"), "user").otherwise("system"))
    return in_collections(parts.select(*KEY), members, collections, list(KEY), "user", ["Label_7", "Label_12", "INBOX"])


ORACLES = {
    "history_scan": _LEFT + """
, a AS (SELECT connection_id, hist, page_no, unnest(documents).external_id AS external_id, false AS gone FROM p UNION ALL SELECT connection_id, hist, page_no, unnest(deleted_external_ids), true FROM p)
SELECT connection_id, external_id, CASE WHEN arg_max(gone, {'h': hist, 'p': page_no, 'g': gone}) THEN 'delete' ELSE 'upsert' END AS action, count(DISTINCT {'h': hist, 'p': page_no}) AS records
FROM a WHERE external_id IS NOT NULL GROUP BY 1, 2""",
    "message_documents": _LEFT + """
SELECT connection_id, split_part(external_id, ':attachment:', 1) AS message_id, external_id, CASE WHEN contains(external_id, ':attachment:') THEN TRY_CAST(split_part(external_id, ':attachment:', 2) AS INTEGER) ELSE 0 END AS part,
doc.title AS title, md5(doc.content) AS digest FROM w WHERE n = 1 AND external_id IS NOT NULL""",
    "label_members": _LEFT + """
SELECT connection_id, external_id FROM w WHERE n = 1 AND external_id IS NOT NULL AND (list_contains(doc.label_ids, 'Label_7') OR list_contains(doc.label_ids, 'Label_12'))""",
}
QUERIES = {f.__name__: f for f in (history_scan, message_documents, label_members)}
