"""Mail: bodies, headers, people and documents of messages."""

from __future__ import annotations

import base64
import binascii
import re
import unicodedata
from collections.abc import Iterator
from email.header import decode_header
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import table

# --- fixed values: what a reader of a mail sees, and what starts a line of its own -------------
_SKIPPED = {"head", "script", "style", "noscript", "svg", "title", "blockquote"}
_BLOCKS = {"address", "article", "aside", "br", "div", "footer", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "li", "main", "ol", "p", "pre", "section", "table", "td", "th", "tr", "ul"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_CLASSES = {"gmail_quote", "gmail_extra", "gmail_signature"}


class _Visible(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.hidden: list[str] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        named = set((dict(attrs).get("class") or "").split()) & _CLASSES
        if tag not in _VOID and (self.hidden or tag in _SKIPPED or named):
            self.hidden.append(tag)
        elif tag in _BLOCKS:
            self.parts.append("\n")

    def handle_endtag(self, tag: str) -> None:
        if tag in self.hidden:
            while self.hidden.pop() != tag:
                pass
        elif not self.hidden and tag in _BLOCKS:
            self.parts.append("\n")

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.parts.append(data)


def visible_text(html: str) -> str:
    """What a reader of the page sees, one line per block; quotations and signatures are left out."""
    parser = _Visible()
    parser.feed(html)
    parser.close()
    lines = [" ".join(x.split()) for x in "".join(parser.parts).split("\n")]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


def decode_words(header: str) -> str:
    """A header with its encoded words decoded; unknown charsets fall back to UTF-8."""

    def one(raw, charset) -> str:
        if isinstance(raw, str):
            return raw
        try:
            return raw.decode(charset or "ascii")
        except (LookupError, UnicodeDecodeError):
            return raw.decode("utf-8", "replace")

    return " ".join("".join(one(*p) for p in decode_header(header)).split())


def decode_part(data: str, charset: str | None = None, most: int = 5_000_000) -> str | None:
    """A base64url body as text; null for malformed or oversized data."""
    try:
        raw = base64.b64decode(data.replace("-", "+").replace("_", "/") + "=" * (-len(data) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None
    if len(raw) > most:
        return None
    try:
        return raw.decode(charset or "utf-8")
    except (LookupError, UnicodeDecodeError):
        return raw.decode("utf-8", "replace")


def select_body(part: dict) -> tuple[str, str] | None:
    """(format, text) of a MIME tree: of alternatives the first plain one with text, else the first;
    otherwise all distinct texts, one after the other. Attachments hold no body."""
    kind = (part.get("mimeType") or "").lower()
    if part.get("filename"):
        return None
    children = [b for p in part.get("parts") or [] if (b := select_body(p))]
    if kind == "multipart/alternative":
        return next((c for c in children if c[0] == "plain"), children[0] if children else None)
    if children:
        texts = list(dict.fromkeys(t for _, t in children))
        kinds = {k for k, _ in children}
        return kinds.pop() if len(kinds) == 1 else "mixed", "\n\n".join(texts)
    data = (part.get("body") or {}).get("data")
    if kind not in ("text/plain", "text/html") or not data:
        return None
    text = decode_part(data, part.get("charset"))
    text = visible_text(text) if text and kind == "text/html" else text
    return ("html" if kind == "text/html" else "plain", text.strip()) if text and text.strip() else None


def attachments(part: dict, most: int = 100) -> list[dict]:
    """Parts with a file name, in document order, each part id once."""
    own = [{"part_id": part.get("partId"), "filename": part["filename"], "mime_type": part.get("mimeType")}] if part.get("filename") else []
    found = own + [a for p in part.get("parts") or [] for a in attachments(p, most)]
    return list({a["part_id"]: a for a in found}.values())[:most]


@F.pandas_udf(T.StringType())
def _visible(html: pd.Series) -> pd.Series:
    return html.map(lambda x: None if x is None else visible_text(x))


@F.pandas_udf(T.StringType())
def _decoded(header: pd.Series) -> pd.Series:
    return header.map(lambda x: None if x is None else decode_words(x))


def printable(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text) with composed texts, without control and format characters but for line ends and tabs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [None if x is None else "".join(c for c in unicodedata.normalize("NFC", x) if c in "\n\t" or not unicodedata.category(c).startswith("C")) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], [key, text])

    return rows.select(key, text).mapInArrow(run, f"{key} string, {text} string")


#: Lines that begin a quotation in full (fixed values).
_ORIGINAL = r"(?i)^-{2,}\s*(begin )?original message\s*-{2,}$"
_ON_WROTE = r"(?i)^on .+ wrote:$"


def clean_body(text: Column) -> Column:
    """Body lines with single blanks, without the quoted suffix and the part behind a ``-- `` line.

    A line ``Original Message`` ends the body; ``On ... wrote:`` does if only quoted lines follow; a
    block of ``>`` lines at the end goes.
    """
    raw = F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n")
    lines = F.transform(raw, lambda x: F.struct(F.regexp_replace(F.regexp_replace(x, r"\s+", " "), "^ | $", "").alias("t"), (x == "-- ").alias("s")))

    def rest(i: Column) -> Column:
        return F.filter(F.slice(lines, i + 2, F.size(lines)), lambda y: y["t"] != "")

    def ends(x: Column, i: Column) -> Column:
        quote = x["t"].rlike(_ON_WROTE) & (F.size(rest(i)) > 0) & F.forall(rest(i), lambda y: y["t"].startswith(">"))
        return x["t"].rlike(_ORIGINAL) | quote | (x["s"] & (F.size(rest(i)) > 0))

    hits = F.filter(F.transform(lines, lambda x, i: F.when(ends(x, i), i)), lambda i: i.isNotNull())
    kept = F.when(F.size(hits) > 0, F.slice(lines, 1, F.array_min(hits))).otherwise(lines)
    body = F.array_join(F.transform(kept, lambda x: x["t"]), "\n")
    body = F.regexp_replace(body, r"(?:(?:^|\n)>[^\n]*|\n)+$", "")
    return F.regexp_replace(F.regexp_replace(body, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def people_of(messages: DataFrame, most: int = 50) -> DataFrame:
    """(message_id, relationship, address): sender before recipients, each address once, at most 50."""
    part = lambda c, r: messages.select("message_id", F.lit(r).alias("rank"), F.explode(F.regexp_extract_all(F.lower(c), F.lit(r"([\w.+'-]+@[\w.-]+\w)"), F.lit(1))).alias("address"))
    rows = part("sender_header", 0).unionByName(part("to_header", 1)).unionByName(part("cc_header", 2)).where(F.length("address") <= 320)
    best = rows.groupBy("message_id", "address").agg(F.min("rank").alias("rank"))
    w = Window.partitionBy("message_id").orderBy("rank", "address")
    kind = F.when(F.col("rank") == 0, "sender").otherwise("recipient")
    return best.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).select("message_id", kind.alias("relationship"), "address")


def current_mail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last fetched row of every message."""
    m = table(spark, sf_dir, "email_messages")
    w = Window.partitionBy("message_id").orderBy(F.desc_nulls_last("fetched_at"), F.desc_nulls_last(F.length("text")))
    return m.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


# --- registered queries -------------------------------------------------------------------------
def mail_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages as documents: a preamble of the known headers, an empty line, the body."""
    m = current_mail(spark, sf_dir)
    head = F.concat_ws("\n", *[F.concat(F.lit(f"{n}: "), F.col(c)) for n, c in (("Subject", "subject"), ("From", "sender_header"), ("To", "to_header"), ("Cc", "cc_header"), ("Date", "date_header"))])
    content = F.concat(head, F.lit("\n\n"), F.coalesce("text", F.lit("")))
    return m.select("message_id", F.substring(F.coalesce("subject", F.lit("")), 1, 2000).alias("title"), F.md5(content).alias("digest"), F.coalesce("skipped_attachment_count", F.lit(0)).alias("skipped"))


def mail_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length and digest of every cleaned body."""
    m = printable(current_mail(spark, sf_dir).where("text IS NOT NULL"), "message_id", "text").select("message_id", clean_body(F.col("text")).alias("b"))
    return m.select("message_id", F.length("b").cast("long").alias("n"), F.md5("b").alias("digest"))


def mail_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decoded subjects."""
    return current_mail(spark, sf_dir).where("subject IS NOT NULL").select("message_id", _decoded("subject").alias("subject"))


def people_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """People of all messages by relationship."""
    return people_of(current_mail(spark, sf_dir))


def references_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twenty different recipients of every message, in order."""
    m = current_mail(spark, sf_dir).where("to_header IS NOT NULL")
    return m.select("message_id", F.array_join(F.slice(F.array_distinct(F.regexp_extract_all(F.lower("to_header"), F.lit(r"([\w.+'-]+@[\w.-]+\w)"), F.lit(1))), 1, 20), " ").alias("recipients"))


def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies sent as HTML, wrapped as a mail program does, and read back: the visible lines."""
    m = current_mail(spark, sf_dir).where("body_format = 'html' AND text IS NOT NULL")
    safe = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", "&", "&amp;"), "<", "&lt;"), ">", "&gt;")
    page = F.concat(F.lit("<html><head><title>x</title><style>p{}</style></head><body><p>"), F.regexp_replace(safe, "\n", "</p><p>"), F.lit("</p><blockquote>earlier</blockquote><div class='gmail_signature'>me</div></body></html>"))
    seen = F.regexp_replace(F.regexp_replace(_visible(page), r"\s+", " "), "^ | $", "")
    return m.select("message_id", F.md5(seen).alias("digest"))


_M = "m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY message_id ORDER BY fetched_at DESC NULLS LAST, length(text) DESC NULLS LAST) AS n FROM email_messages) WHERE n = 1)"
_ADR = "regexp_extract_all(lower({0}), '[\\w.+''-]+@[\\w.-]+\\w')"
ORACLES = {
    "mail_documents": f"""WITH {_M} SELECT message_id, substr(coalesce(subject, ''), 1, 2000) AS title,
md5(concat_ws(chr(10), 'Subject: ' || subject, 'From: ' || sender_header, 'To: ' || to_header, 'Cc: ' || cc_header, 'Date: ' || date_header) || chr(10) || chr(10) || coalesce(text, '')) AS digest, coalesce(skipped_attachment_count, 0) AS skipped FROM m""",
    "people_cap": f"""WITH {_M}, a AS (SELECT message_id, 0 AS rank, unnest({_ADR.format('sender_header')}) AS address FROM m UNION ALL SELECT message_id, 1, unnest({_ADR.format('to_header')}) FROM m UNION ALL SELECT message_id, 2, unnest({_ADR.format('cc_header')}) FROM m),
b AS (SELECT message_id, address, min(rank) AS rank FROM a WHERE length(address) <= 320 GROUP BY 1, 2)
SELECT message_id, CASE WHEN rank = 0 THEN 'sender' ELSE 'recipient' END AS relationship, address FROM (SELECT *, row_number() OVER (PARTITION BY message_id ORDER BY rank, address) AS n FROM b) WHERE n <= 50""",
    "references_dedup": f"""WITH {_M}, l AS (SELECT message_id, {_ADR.format('to_header')} AS l FROM m WHERE to_header IS NOT NULL)
SELECT message_id, coalesce(array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i)[1:20], ' '), '') AS recipients FROM l""",
    "mail_headers": f"WITH {_M} SELECT message_id, trim(regexp_replace(subject, '\\s+', ' ', 'g')) AS subject FROM m WHERE subject IS NOT NULL",
    "html_text": f"WITH {_M} SELECT message_id, md5(trim(regexp_replace(text, '[\\s\\x{{A0}}]+', ' ', 'g'))) AS digest FROM m WHERE body_format = 'html' AND text IS NOT NULL",
}
QUERIES = {f.__name__: f for f in (mail_documents, mail_bodies, mail_headers, people_cap, references_dedup, html_text)}
