"""A change feed applied to a table of Parquet images with delete vectors.

Images (inserts and updates) are only ever appended. A superseded or deleted image stays where it
is; the bit of its row position is set in the bitmap of its file. A batch is applied in four steps:
write the new images, look up the file positions of all images of the touched messages (the
key-to-position index is read from the key columns alone), decide which of them are dead, and
write the bitmaps anew. Readers join the bitmaps by file and bucket and drop the set positions.

Order: pages apply per connection by history id as a number, then by page number; within a page
all documents in array order, then the deletes. Of several deliveries of one page only the last
received counts, also when it comes in a later batch: images of the older delivery die and images
they had superseded live again. A delete of a message also removes its attachments.

Defined results: pages without connection, with a null or empty history id or one that is no
number are left out; a null page number counts as 0, a null receipt time as the earliest; null
arrays and null elements hold nothing; a delete of something unknown does nothing; repeated rows
are one delivery; of equal receipt times the larger delivery id counts; an empty feed gives an
empty table; columns not named here are ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidemark.session import cut, new_path, table

PAGE = ["connection_id", "hist", "page_no"]
KEY = ["connection_id", "external_id"]
#: What marks an attachment's id behind its message's id (fixed value).
ATTACHMENT = ":attachment:"
#: Hash buckets of the stored index; a batch reads those its messages fall into.
INDEX_BUCKETS = 64


def last_deliveries(pages: DataFrame) -> DataFrame:
    """One row per page: the delivery last received, with ``hist`` as a number."""
    p = pages.select("delivery_id", "connection_id", "history_id", F.coalesce("page_no", F.lit(0)).alias("page_no"), "documents", "deleted_external_ids", "received_at")
    p = p.withColumn("hist", F.expr("try_cast(trim(history_id) AS decimal(38,0))")).where("hist IS NOT NULL AND connection_id IS NOT NULL")
    order = Window.partitionBy(*PAGE).orderBy(F.desc_nulls_last("received_at"), F.desc_nulls_last("delivery_id"))
    return p.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def _message(column: str) -> F.Column:
    return F.substring_index(column, ATTACHMENT, 1)


@F.pandas_udf(T.BinaryType())
def _patch(old: pd.Series, touched: pd.Series, dead: pd.Series) -> pd.Series:
    """Bits of ``old`` outside ``touched``, those of ``dead`` inside."""

    def one(o, t, d):
        if o is None or t is None:
            return d if o is None else o
        bits = [np.frombuffer(x, dtype=np.uint8) for x in (o, t, d)]
        return ((bits[0] & ~bits[1]) | bits[2]).tobytes()

    return pd.Series([one(*x) for x in zip(old, touched, dead)])


class ChangeTable:
    """A table below ``root`` in shared storage; :meth:`apply` may be called with batch after batch."""

    def __init__(self, spark: SparkSession, root: str | None = None, files: int | None = None):
        self.spark, self.root, self.files = spark, root or new_path(spark, "changes"), files
        self.batches = 0

    def _paths(self, kind: str) -> list[str]:
        return [f"{self.root}/{kind}/b{i}" for i in range(self.batches)]

    def _read(self, kind: str) -> DataFrame:
        return self.spark.read.parquet(*self._paths(kind))

    def _vectors(self, batches: int) -> DataFrame:
        """(file, bucket, vector): the bitmap last written for every part of a file."""
        written = self.spark.read.schema("file string, bucket bigint, vector binary, batch int").parquet(*self._paths("vectors")[:batches])
        return written.groupBy("file", "bucket").agg(F.max_by("vector", "batch").alias("vector"))

    def apply(self, pages: DataFrame) -> None:
        """Append the batch and renew the delete vectors of what it touches."""
        b, first = self.batches, self.batches == 0
        pages = last_deliveries(pages)
        if not first:  # a batch that comes again after a failure adds nothing
            known = self._read("pages").select(*[F.col(c).alias(f"_{c}") for c in (*PAGE, "received_at", "delivery_id")])
            same = [F.col(c) == F.col(f"_{c}") for c in PAGE] + [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ("received_at", "delivery_id")]
            pages = pages.join(known, same, "left_anti")
        at = f"{self.root}/%s/b{b}"
        pages.write.parquet(at % "feed")
        feed = self.spark.read.schema(pages.schema).parquet(at % "feed")
        feed.select(*PAGE, "received_at", "delivery_id").write.parquet(at % "pages")
        images = feed.select(*PAGE, "history_id", "received_at", "delivery_id", F.posexplode("documents").alias("pos", "d")).where("d.external_id IS NOT NULL")
        images = images.withColumn("external_id", F.col("d.external_id")).withColumn("message_id", _message("external_id"))
        parts = [self.files] if self.files else []
        images.repartition(*parts, "connection_id", "message_id").write.parquet(at % "images")
        gone = feed.select(*PAGE, "received_at", "delivery_id", F.explode("deleted_external_ids").alias("external_id")).where("external_id IS NOT NULL")
        gone.withColumn("message_id", _message("external_id")).write.parquet(at % "deletes")
        self.batches += 1

        place = self.spark.read.schema(images.schema).parquet(at % "images")
        place = place.select(*KEY, "message_id", *PAGE[1:], "received_at", "delivery_id", "pos", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
        place = place.withColumn("kb", F.pmod(F.hash("connection_id", "message_id"), F.lit(INDEX_BUCKETS)))
        place.write.partitionBy("kb").parquet(f"{self.root}/index/batch={b}")
        index = self.spark.read.schema(place.schema).parquet(f"{self.root}/index")
        deletes = self._read("deletes")
        if not first:
            # touched: messages of this batch, and those of earlier deliveries of its pages
            again = cut(feed.select(*PAGE).join(known.select(*[F.col(f"_{c}").alias(c) for c in PAGE]), PAGE, "left_semi"))
            own = [self.spark.read.schema(d.schema).parquet(at % k).select("connection_id", "message_id") for k, d in (("images", images), ("deletes", deletes))]
            if not again.isEmpty():
                own += [f.join(again, PAGE, "left_semi").select("connection_id", "message_id") for f in (index, deletes)]
            touched = cut(reduce(DataFrame.union, own).distinct().withColumn("kb", F.pmod(F.hash("connection_id", "message_id"), F.lit(INDEX_BUCKETS))))
            buckets = [r.kb for r in touched.select("kb").distinct().collect()]  # at most INDEX_BUCKETS
            index = index.where(F.col("kb").isin(buckets)).join(touched, ["kb", "connection_id", "message_id"], "left_semi")
            deletes = deletes.join(touched, ["connection_id", "message_id"], "left_semi")
        dead = self._dead(index, deletes, None if first else self._read("pages"))
        dead = dead.withColumn("bucket", F.expr("bitmap_bucket_number(row + 1)")).withColumn("bit", F.expr("bitmap_bit_position(row + 1)"))
        vectors = dead.groupBy("file", "bucket").agg(F.expr("bitmap_construct_agg(bit)").alias("seen"), F.expr("bitmap_construct_agg(bit) FILTER (WHERE dead)").alias("dead"))
        if not first:
            old = self._vectors(b)
            vectors = vectors.join(old, ["file", "bucket"], "left").select("file", "bucket", _patch("vector", "seen", "dead").alias("vector"))
        else:
            vectors = vectors.select("file", "bucket", F.col("dead").alias("vector"))
        vectors.withColumn("batch", F.lit(b)).write.parquet(at % "vectors")

    @staticmethod
    def _dead(index: DataFrame, deletes: DataFrame, pages: DataFrame | None) -> DataFrame:
        """(file, row, dead) of the indexed images."""
        index, deletes = index.withColumn("valid", F.lit(True)), deletes.withColumn("valid", F.lit(True))
        if pages is not None:
            last = pages.groupBy(*PAGE).agg(F.max(F.struct("received_at", "delivery_id")).alias("last"))
            valid = F.struct("received_at", "delivery_id").eqNullSafe(F.col("last"))
            index = index.join(last, PAGE).withColumn("valid", valid).drop("last")
            deletes = deletes.join(last, PAGE).withColumn("valid", valid).drop("last")
        index = index.withColumn("seq", F.struct("hist", "page_no", F.lit(0).alias("phase"), "pos"))
        gone = deletes.where("valid").groupBy(*KEY).agg(F.max(F.struct("hist", "page_no", F.lit(1).alias("phase"), F.lit(0).alias("pos"))).alias("gone"))
        newest = index.where("valid").groupBy(*KEY).agg(F.max("seq").alias("newest"))
        rows = index.join(newest, KEY, "left").join(gone, KEY, "left")
        whole = gone.select("connection_id", F.col("external_id").alias("message_id"), F.col("gone").alias("whole"))
        rows = rows.join(whole, ["connection_id", "message_id"], "left")
        live = F.col("valid") & (F.col("seq") == F.col("newest")) & (F.col("gone").isNull() | (F.col("gone") < F.col("seq"))) & (F.col("whole").isNull() | (F.col("whole") < F.col("seq")))
        return rows.select("file", "row", (~live).alias("dead"))

    def read(self) -> DataFrame:
        """The current rows: (connection_id, external_id, history_id, document)."""
        images = self._read("images").select(*KEY, "history_id", F.col("d").alias("document"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
        images = images.withColumn("bucket", F.expr("bitmap_bucket_number(row + 1)")).withColumn("bit", F.expr("bitmap_bit_position(row + 1)"))
        vectors = self._vectors(self.batches)
        byte = F.expr("cast(conv(hex(substring(vector, cast(bit div 8 as int) + 1, 1)), 16, 10) as int)")
        is_set = F.coalesce(F.shiftright(byte, 0).bitwiseAND(F.expr("shiftleft(1, cast(bit % 8 as int))")) != 0, F.lit(False))
        return images.join(vectors, ["file", "bucket"], "left").where(~is_set).select(*KEY, "history_id", "document")


def apply_feed(pages: DataFrame) -> DataFrame:
    """The state of the table after a whole feed."""
    changes = ChangeTable(pages.sparkSession)
    changes.apply(pages)
    return changes.read()


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """External ids left in each mailbox with the history id that last wrote them."""
    return apply_feed(table(spark, sf_dir, "gmail_history_pages")).select("connection_id", "external_id", "history_id")


def p2_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The current documents of each mailbox."""
    s = apply_feed(table(spark, sf_dir, "gmail_history_pages"))
    return s.select("connection_id", "external_id", "history_id", "document.source_type", "document.title", "document.content", F.array_join("document.label_ids", ",").alias("labels"))


def p2_batches(spark: SparkSession, sf_dir: str, batches: int = 3) -> DataFrame:
    """The same state after the deliveries came in several batches and in another order."""
    pages, changes = table(spark, sf_dir, "gmail_history_pages"), ChangeTable(spark)
    for i in reversed(range(batches)):
        changes.apply(pages.where(F.pmod(F.xxhash64("delivery_id"), F.lit(batches)) == i))
    return changes.read().select("connection_id", "external_id", "history_id")


_LEFT = """
WITH p AS (
  SELECT *, CAST(history_id AS HUGEINT) AS hist FROM (
    SELECT *, row_number() OVER (PARTITION BY connection_id, history_id, page_no ORDER BY received_at DESC, delivery_id DESC) AS n
    FROM gmail_history_pages WHERE history_id IS NOT NULL AND history_id <> '') WHERE n = 1),
d AS (SELECT connection_id, hist, page_no, history_id, unnest(documents) AS doc, unnest(range(len(documents))) AS pos FROM p),
w AS (SELECT *, doc.external_id AS external_id, row_number() OVER (PARTITION BY connection_id, doc.external_id ORDER BY hist DESC, page_no DESC, pos DESC) AS n FROM d),
x AS (SELECT connection_id, external_id, max({'h': hist, 'p': page_no}) AS gone FROM (SELECT connection_id, hist, page_no, unnest(deleted_external_ids) AS external_id FROM p) GROUP BY ALL)
"""
_ALIVE = """
FROM w WHERE n = 1 AND NOT EXISTS (
  SELECT 1 FROM x WHERE x.connection_id = w.connection_id
  AND (x.external_id = w.external_id OR x.external_id = split_part(w.external_id, ':attachment:', 1))
  AND x.gone >= {'h': w.hist, 'p': w.page_no})
"""
ORACLES = {
    "p2_found": _LEFT + "SELECT connection_id, external_id, history_id" + _ALIVE,
    "p2_state": _LEFT + "SELECT connection_id, external_id, history_id, doc.source_type AS source_type, doc.title AS title, doc.content AS content, CASE WHEN doc.label_ids IS NOT NULL THEN coalesce(array_to_string(doc.label_ids, ','), '') END AS labels" + _ALIVE,
}
ORACLES["p2_batches"] = ORACLES["p2_found"]
QUERIES = {"p2_found": p2_found, "p2_state": p2_state, "p2_batches": p2_batches}
