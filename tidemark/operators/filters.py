"""Predicates of a search request, tenant scope, validation and keyset pages."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import table

UUID = r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"


@dataclass(frozen=True)
class Filters:
    """Values of a field are alternatives, fields are joined by and; at most twenty values a field."""

    providers: tuple[str, ...] = ()
    source_types: tuple[str, ...] = ()
    file_types: tuple[str, ...] = ()
    people: tuple[str, ...] = ()
    date_from: datetime | None = None
    date_to: datetime | None = None

    def __post_init__(self) -> None:
        if len(self.providers) > 4 or any(len(v) > 20 for v in (self.source_types, self.file_types, self.people)):
            raise ValueError("too many values in a filter")
        if self.date_from and self.date_to and self.date_from >= self.date_to:
            raise ValueError("date_from must be before date_to")


def any_of(column: str, values: tuple[str, ...]) -> Column:
    """Membership ignoring case."""
    return F.lower(column).isin([v.casefold() for v in values])


def file_type(extension: Column, mime: Column, value: str) -> Column:
    """Extension without dots, or a media type pattern with ``*``."""
    v = value.casefold().lstrip(".")
    same = F.lower(extension) == v
    return same | F.lower(mime).like(v.replace("*", "%")) if "/" in v else same


def between(column: str, start: datetime | None, end: datetime | None) -> Column:
    """Half-open range; null timestamps are outside of any."""
    c = F.lit(True)
    c = c & (F.col(column) >= F.lit(start)) if start else c
    return c & (F.col(column) < F.lit(end)) if end else c


def with_people(rows: DataFrame, people: DataFrame, key: str, wanted: tuple[str, ...], author: str | None = None) -> DataFrame:
    """Rows with a person whose identifier or name holds one of the wanted texts, or whose author does."""
    names = [v.casefold() for v in wanted]
    hit = lambda c: reduce(lambda a, b: a | b, [F.coalesce(F.lower(c).contains(n), F.lit(False)) for n in names], F.lit(False))
    found = people.where(hit("normalized_identifier") | hit("display_name")).select(key).distinct()
    by_edge = rows.join(found, key, "left_semi")
    if author is None:
        return by_edge
    return rows.where(hit(author)).unionByName(rows.where(~hit(author)).join(found, key, "left_semi"))


def apply_filters(rows: DataFrame, f: Filters) -> DataFrame:
    """All column predicates before any ranking, so that they reach the scan."""
    terms = []
    if f.providers:
        terms.append(any_of("provider", f.providers))
    if f.source_types:
        terms.append(any_of("source_type", f.source_types))
    if f.file_types:
        terms.append(reduce(lambda a, b: a | b, [file_type(F.col("extension"), F.col("mime_type"), v) for v in f.file_types]))
    if f.date_from or f.date_to:
        terms.append(between("modified_at", f.date_from, f.date_to))
    return rows.where(reduce(lambda a, b: a & b, terms, F.lit(True)))


class Scope:
    """The only reader of tenant tables: rows of one workspace, and only for its active members."""

    def __init__(self, members: DataFrame, workspace_id: str | None, user: str | None):
        self.valid = bool(workspace_id and re.match(UUID, workspace_id) and user)
        self.workspace_id = workspace_id
        self.member = members.where((F.col("workspace_id") == (workspace_id or "")) & (F.col("user") == (user or "")) & (F.col("status") == "active")).select("workspace_id").distinct()

    def read(self, rows: DataFrame) -> DataFrame:
        """Rows of the workspace; none with a missing or malformed context."""
        if not self.valid:
            return rows.where(F.lit(False))
        return rows.where(F.col("workspace_id") == self.workspace_id).join(self.member, "workspace_id", "left_semi")

    def write(self, rows: DataFrame) -> DataFrame:
        """Rows to be written, checked: a row of another workspace fails the job."""
        ok = F.col("workspace_id").eqNullSafe(F.lit(self.workspace_id if self.valid else None)) & F.lit(self.valid)
        return rows.where(F.when(ok, True).otherwise(F.raise_error(F.lit("row outside of the workspace")).cast("boolean")))


def keyset(rows: DataFrame, order: list[tuple[str, bool]], after: tuple | None, size: int = 25) -> DataFrame:
    """The next page in the order given as (column, descending): rows behind the cursor."""
    if not 1 <= size <= 100:
        raise ValueError("a page holds 1 to 100 rows")
    if after is not None:
        behind, equal = F.lit(False), F.lit(True)
        for (c, down), v in zip(order, after):
            behind = behind | (equal & ((F.col(c) < F.lit(v)) if down else (F.col(c) > F.lit(v))))
            equal = equal & (F.col(c) == F.lit(v))
        rows = rows.where(behind)
    return rows.orderBy(*[F.desc(c) if down else F.asc(c) for c, down in order]).limit(size)


# --- registered queries -------------------------------------------------------------------------
def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "connections").select("connection_id", "provider", "workspace_id", "status")
    return table(spark, sf_dir, "documents").join(c, "connection_id").withColumn("extension", F.regexp_extract("title", r"\.(\w+)$", 1))


def filter_providers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of given providers and source types."""
    return apply_filters(_docs(spark, sf_dir), Filters(providers=("Google_Drive",), source_types=("FILE",))).select("doc_id")


def filter_filetype(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of a media type family or an extension."""
    return apply_filters(_docs(spark, sf_dir), Filters(file_types=("text/*", ".pdf"))).select("doc_id")


def filter_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of one quarter."""
    return apply_filters(_docs(spark, sf_dir), Filters(date_from=datetime(2024, 4, 1), date_to=datetime(2024, 7, 1))).select("doc_id")


def filter_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drive items owned by a person."""
    i = table(spark, sf_dir, "drive_items").select("item_id", "owners").distinct()
    owners = i.select("item_id", F.explode("owners").alias("o")).select("item_id", "o.*")
    return with_people(i.select("item_id").distinct(), owners, "item_id", ("Mateo", "brightwick")).select("item_id")


def filter_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks whose source belongs to a collection: connections of one workspace with Drive."""
    c = table(spark, sf_dir, "connections").where("provider = 'google_drive' AND status = 'active'").select("connection_id")
    return table(spark, sf_dir, "chunks").select("chunk_id", "connection_id").distinct().join(c, "connection_id", "left_semi").select("chunk_id")


def tenant_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the owner of the first workspace may read, per source."""
    c = table(spark, sf_dir, "connections")
    first = c.agg(F.min("workspace_id").alias("w")).first().w
    members = c.select("workspace_id", F.lit("owner").alias("user"), F.lit("active").alias("status"))
    return Scope(members, first, "owner").read(_docs(spark, sf_dir)).groupBy("source").agg(F.count("*").alias("docs"))


def row_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents per first failed rule; sound ones count as 'ok'."""
    d = table(spark, sf_dir, "documents")
    rule = (
        F.when(F.col("text").isNull(), "no text")
        .when(~F.col("text").rlike(r"[^ \t\r\n]"), "blank text")
        .when(F.length("text") > 5_000_000, "too long")
        .when(F.coalesce(F.trim("title"), F.lit("")) == "", "no title")
        .when(F.length("title") > 2_000, "long title")
        .when(F.col("lang").isNull(), "no language")
        .otherwise("ok")
    )
    return d.groupBy(rule.alias("rule")).agg(F.count("*").alias("docs"))


def json_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose JSON property exceeds a bound, per type."""
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long")).where("k >= 50")
    return e.groupBy("event_type").agg(F.count("*").alias("events"), F.sum("k").alias("k"))


def keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of orders by price and key."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    order = [("o_totalprice", True), ("o_orderkey", False)]
    last = keyset(o, order, None).orderBy(F.asc("o_totalprice"), F.desc("o_orderkey")).first()
    return keyset(o, order, (last.o_totalprice, last.o_orderkey))


def star_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue per region and segment over a star of five tables; small sides are broadcast by their size."""
    t = lambda n: table(spark, sf_dir, n)
    j = t("lineitem").select("l_orderkey", "l_extendedprice", "l_discount").join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    j = j.join(t("customer").select("c_custkey", "c_nationkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    j = j.join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("r_name", "c_mktsegment").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("lines"))


def chunk_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of the current version of every source, with workspace and provider of their active
    connection. A version is what was modified at one time; repeated rows give way to the last indexed."""
    c = table(spark, sf_dir, "chunks").where("chunk_id IS NOT NULL").groupBy("chunk_id").agg(F.max(F.struct("indexed_at", "modified_at", "source_id", "connection_id", "chunk_index")).alias("r")).select("chunk_id", "r.*")
    versions = c.groupBy("source_id").agg(F.max("modified_at").alias("modified_at"))
    active = table(spark, sf_dir, "connections").where("status = 'active'").select("connection_id", "workspace_id", "provider")
    return c.join(versions, ["source_id", "modified_at"]).join(active, "connection_id").select("chunk_id", "source_id", "chunk_index", "modified_at", "workspace_id", "provider")


def exists_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders per priority that have a returned line."""
    back = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").join(back, "o_orderkey", "left_semi").groupBy("o_orderpriority").agg(F.count("*").alias("orders"))


_D = "documents d JOIN connections c ON c.connection_id = d.connection_id"
ORACLES = {
    "filter_providers": f"SELECT doc_id FROM {_D} WHERE lower(provider) = 'google_drive' AND lower(source_type) = 'file'",
    "filter_filetype": f"SELECT doc_id FROM {_D} WHERE lower(mime_type) LIKE 'text/%' OR lower(regexp_extract(coalesce(title, ''), '\\.(\\w+)$', 1)) = 'pdf'",
    "filter_dates": f"SELECT doc_id FROM {_D} WHERE modified_at >= TIMESTAMP '2024-04-01' AND modified_at < TIMESTAMP '2024-07-01'",
    "filter_people": """
SELECT DISTINCT item_id FROM (SELECT item_id, unnest(owners) AS o FROM drive_items)
WHERE lower(o.normalized_identifier) LIKE '%mateo%' OR lower(o.normalized_identifier) LIKE '%brightwick%' OR lower(o.display_name) LIKE '%mateo%' OR lower(o.display_name) LIKE '%brightwick%'""",
    "filter_collections": "SELECT DISTINCT chunk_id FROM chunks k WHERE EXISTS (SELECT 1 FROM connections c WHERE c.connection_id = k.connection_id AND provider = 'google_drive' AND status = 'active')",
    "tenant_scope": f"SELECT source, count(*) AS docs FROM {_D} WHERE workspace_id = (SELECT min(workspace_id) FROM connections) GROUP BY 1",
    "row_validation": """
SELECT CASE WHEN text IS NULL THEN 'no text' WHEN NOT regexp_matches(text, '[^ \t\r\n]') THEN 'blank text' WHEN length(text) > 5000000 THEN 'too long' WHEN coalesce(trim(title), '') = '' THEN 'no title'
WHEN length(title) > 2000 THEN 'long title' WHEN lang IS NULL THEN 'no language' ELSE 'ok' END AS rule, count(*) AS docs FROM documents GROUP BY 1""",
    "json_predicates": "SELECT event_type, count(*) AS events, CAST(sum(k) AS BIGINT) AS k FROM (SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) WHERE k >= 50 GROUP BY 1",
    "keyset_page": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 25",
    "star_join": """
SELECT r_name, c_mktsegment, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS lines FROM lineitem JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2""",
    "chunk_star": """
WITH c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY indexed_at DESC NULLS LAST, modified_at DESC NULLS LAST, source_id DESC NULLS LAST, connection_id DESC NULLS LAST, chunk_index DESC NULLS LAST) AS n FROM chunks WHERE chunk_id IS NOT NULL) WHERE n = 1),
v AS (SELECT source_id, max(modified_at) AS modified_at FROM c GROUP BY 1)
SELECT chunk_id, source_id, chunk_index, modified_at, workspace_id, provider FROM c JOIN v USING (source_id, modified_at) JOIN connections USING (connection_id) WHERE status = 'active'""",
    "exists_semi": "SELECT o_orderpriority, count(*) AS orders FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') GROUP BY 1",
}
QUERIES = {f.__name__: f for f in (filter_providers, filter_filetype, filter_dates, filter_people, filter_collections, tenant_scope, row_validation, json_predicates, keyset_page, star_join, chunk_star, exists_semi)}
