"""Drive items: validation, descriptors, and the texts of office files."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.store import ORACLES as STORE
from tidemark.operators.store import folder_paths, newest
from tidemark.session import table

#: Bounds of an office file: packed bytes, unpacked bytes, members, characters of text.
MAX_BYTES, MAX_UNPACKED, MAX_MEMBERS, MAX_CHARS = 20 << 20, 50 << 20, 2_000, 4_900_000
_OFFICE = "application/vnd.openxmlformats-officedocument."
#: Media type to the extractor that reads it.
ROUTES = {
    f"{_OFFICE}wordprocessingml.document": "docx",
    f"{_OFFICE}spreadsheetml.sheet": "xlsx",
    f"{_OFFICE}presentationml.presentation": "pptx",
    "application/vnd.google-apps.document": "docx",
    "application/vnd.google-apps.spreadsheet": "xlsx",
    "application/vnd.google-apps.presentation": "pptx",
    "application/pdf": "pdf",
}


class _Bad(Exception):
    pass


def _member(box: zipfile.ZipFile, name: str) -> ElementTree.Element | None:
    """A member's XML; documents that declare types or entities are refused."""
    if name not in box.namelist():
        return None
    data = box.read(name)
    if re.search(rb"<!\s*(?:DOCTYPE|ENTITY)", data):
        raise _Bad("declarations")
    return ElementTree.fromstring(data)


def _tag(e: ElementTree.Element) -> str:
    return e.tag.rpartition("}")[2]


def _attr(e: ElementTree.Element, name: str) -> str | None:
    return next((v for k, v in e.attrib.items() if k.rpartition("}")[2] == name), None)


def _all_text(e: ElementTree.Element) -> str:
    out = []
    for x in e.iter():
        out.append(x.text or "" if _tag(x) == "t" else "\t" if _tag(x) == "tab" else "\n" if _tag(x) == "br" else "")
    return "".join(out).strip()


def _docx(box: zipfile.ZipFile) -> Iterator[str]:
    root = _member(box, "word/document.xml")
    if root is None:
        raise _Bad("no document")
    for block in next((x for x in root.iter() if _tag(x) == "body"), root):
        if _tag(block) == "p":
            text = _all_text(block)
            style = next((_attr(x, "val") or "" for x in block.iter() if _tag(x) == "pStyle"), "")
            if text and (m := re.fullmatch(r"(?i)heading ?([1-6])", style)):
                yield "#" * int(m[1]) + " " + text
            elif text:
                yield ("- " if any(_tag(x) == "numPr" for x in block.iter()) else "") + text
        elif _tag(block) == "tbl":
            rows = [" | ".join(_all_text(c) for c in row if _tag(c) == "tc") for row in block if _tag(row) == "tr"]
            yield "\n".join(["[Table]", *rows, "[/Table]"])


def _numbered(box: zipfile.ZipFile, pattern: str) -> list[tuple[int, str]]:
    return sorted((int(m[1]), n) for n in box.namelist() if (m := re.fullmatch(pattern, n)))


def _xlsx(box: zipfile.ZipFile) -> Iterator[str]:
    strings = _member(box, "xl/sharedStrings.xml")
    shared = [_all_text(x) for x in strings if _tag(x) == "si"] if strings is not None else []
    book = _member(box, "xl/workbook.xml")
    names = [_attr(x, "name") for x in book.iter() if _tag(x) == "sheet"] if book is not None else []
    sheets = _numbered(box, r"xl/worksheets/sheet(\d+)\.xml")
    if not sheets:
        raise _Bad("no sheet")
    for place, (_, member) in enumerate(sheets):
        rows = []
        for row in (x for x in _member(box, member).iter() if _tag(x) == "row"):
            cells = []
            for c in (x for x in row if _tag(x) == "c"):
                part = {_tag(x): x for x in c}
                value = part["v"].text or "" if "v" in part else ""
                kind = c.get("t")
                if kind == "s":
                    if not value.isdigit() or int(value) >= len(shared):
                        raise _Bad("shared string")
                    value = shared[int(value)]
                elif kind == "inlineStr":
                    value = _all_text(c)
                elif kind == "b":
                    value = "TRUE" if value == "1" else "FALSE"
                formula = part["f"].text if "f" in part else None
                cells.append(f"={formula} ({value})" if formula else value)
            if any(cells):
                rows.append(" | ".join(cells))
        yield "\n".join([f"# {names[place] if place < len(names) and names[place] else f'Sheet {place + 1}'}", *rows])


def _pptx(box: zipfile.ZipFile) -> Iterator[str]:
    slides = _numbered(box, r"ppt/slides/slide(\d+)\.xml")
    if not slides:
        raise _Bad("no slide")
    for n, member in slides:
        lines = [t for p in _member(box, member).iter() if _tag(p) == "p" and (t := _all_text(p))]
        notes = _member(box, f"ppt/notesSlides/notesSlide{n}.xml")
        said = [t for p in notes.iter() if _tag(p) == "p" and (t := _all_text(p))] if notes is not None else []
        yield "\n".join([f"# Slide {n}", *lines, *(["Speaker notes:", *said] if said else [])])


def extract(kind: str, data: bytes | None) -> tuple[str, str]:
    """(status, text) of a file; bad input gives a status, never an error."""
    if not data:
        return "empty", ""
    if len(data) > MAX_BYTES:
        return "too_large", ""
    if kind == "pdf":
        try:
            from pypdf import PdfReader  # optional
        except ImportError:
            return "unsupported", ""
        try:
            reader = PdfReader(io.BytesIO(data))
            if reader.is_encrypted:
                return "encrypted", ""
            text = "\n\n".join(p.extract_text() or "" for p in reader.pages[:500])
        except Exception:  # noqa: BLE001 - any malformed file
            return "invalid", ""
    else:
        try:
            with zipfile.ZipFile(io.BytesIO(data)) as box:
                infos = box.infolist()
                if len(infos) > MAX_MEMBERS or sum(i.file_size for i in infos) > MAX_UNPACKED:
                    return "too_large", ""
                text = "\n\n".join({"docx": _docx, "xlsx": _xlsx, "pptx": _pptx}[kind](box))
        except (zipfile.BadZipFile, ElementTree.ParseError, _Bad, KeyError, NotImplementedError, RuntimeError):
            return "invalid", ""
    text = "".join(c for c in text if c in "\n\t" or ord(c) >= 32).strip()
    if not text:
        return "empty", ""
    return ("text_truncated", text[:MAX_CHARS]) if len(text) > MAX_CHARS else ("extracted", text)


def extract_files(files: DataFrame, mime: str = "mime_type") -> DataFrame:
    """(path, status, text) for rows of the binaryFile source with a media type; the size bound is
    checked before the bytes are read into a task's Python."""
    route = F.create_map(*[F.lit(x) for kv in ROUTES.items() for x in kv])[F.col(mime)]
    rows = files.select("path", route.alias("kind"), F.when(F.col("length") <= MAX_BYTES, F.col("content")).alias("content"), (F.col("length") > MAX_BYTES).alias("large"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [("too_large", "") if large else (extract(k, c) if k else ("descriptor", "")) for k, c, large in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s for s, _ in out], pa.string()), pa.array([t for _, t in out], pa.string())], ["path", "status", "text"])

    return rows.mapInArrow(run, "path string, status string, text string")


def merged(descriptor, label: str, status, text):
    """A descriptor with the extraction's status and text behind it, at most five million characters."""
    return F.substring(F.concat(descriptor, F.lit(f"\n{label} extraction: "), status, F.lit("\n\n"), F.coalesce(text, F.lit(""))), 1, 5_000_000)


# --- registered queries -------------------------------------------------------------------------
def drive_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings per first broken rule."""
    i = table(spark, sf_dir, "drive_items")
    rule = (
        F.when(~F.coalesce(F.col("item_id").rlike("^[A-Za-z0-9_-]{1,512}$"), F.lit(False)), "id")
        .when(F.coalesce("name", F.lit("")) == "", "name")
        .when(F.col("mime_type").isNull(), "mime type")
        .when(F.col("modified_at").isNull(), "modified")
        .when(F.size("owners") > 100, "owners")
        .when(F.coalesce("size_bytes", F.lit(0)) < 0, "size")
        .otherwise("ok")
    )
    return i.groupBy(rule.alias("rule")).agg(F.count("*").alias("items"))


def drive_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descriptor documents of the current files, with their sorted parents."""
    i = newest(table(spark, sf_dir, "drive_items"), ["connection_id", "item_id"], F.desc_nulls_last("modified_at"), F.desc_nulls_last("fetched_at"), F.desc_nulls_last("name"), F.desc_nulls_last("mime_type"))
    parents = F.array_join(F.array_sort(F.array_distinct(F.filter("parent_ids", lambda x: x.isNotNull()))), ",")
    return i.select("connection_id", "item_id", F.concat_ws("\n", F.concat(F.lit("Name: "), F.coalesce("name", F.lit(""))), F.concat(F.lit("Type: "), F.coalesce("mime_type", F.lit("")))).alias("content"), F.coalesce(parents, F.lit("")).alias("parents"))


def drive_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current files as documents: name, type and logical path, a link, and metadata as JSON. Of several
    paths the first by text counts, of rows with equal times the largest; a file without a path down from a root stands by its name."""
    order = F.struct("modified_at", "fetched_at", "is_folder", "parent_ids", "name", "mime_type", "drive_id", "size_bytes", "shortcut_target_id")
    fields = ("name", "mime_type", "is_folder", "parent_ids", "drive_id", "size_bytes", "shortcut_target_id")
    i = table(spark, sf_dir, "drive_items").where("connection_id IS NOT NULL AND item_id IS NOT NULL")
    i = i.groupBy("connection_id", "item_id").agg(F.max_by(F.struct(*fields), order).alias("r")).select("connection_id", "item_id", "r.*").where("NOT coalesce(is_folder, false)")
    paths = folder_paths(spark, sf_dir).groupBy("connection_id", "item_id").agg(F.min("path").alias("path"))
    name = F.coalesce("name", F.lit(""))
    i = i.join(paths, ["connection_id", "item_id"], "left").withColumn("path", F.coalesce("path", name))
    shortcut = F.when(F.col("shortcut_target_id").isNotNull(), "Shortcut: indexed without following its target")
    content = F.concat_ws("\n", F.concat(F.lit("Name: "), name), F.concat(F.lit("Type: "), "mime_type"), F.concat(F.lit("Path: "), "path"), shortcut)
    parents = F.coalesce("parent_ids", F.array().cast("array<string>"))
    facts = F.struct(F.col("item_id").alias("file_id"), F.col("path").alias("logical_path"), parents.alias("parent_ids"), "drive_id", F.col("size_bytes").alias("size"), "shortcut_target_id")
    link = F.concat(F.lit("https://drive.google.com/open?id="), F.replace(F.url_encode("item_id"), F.lit("+"), F.lit("%20")))
    return i.select("connection_id", "item_id", content.alias("content"), link.alias("url"), F.to_json(facts).alias("metadata"))


def extraction_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files per extractor."""
    route = F.coalesce(F.create_map(*[F.lit(x) for kv in ROUTES.items() for x in kv])[F.col("mime_type")], F.lit("descriptor"))
    return table(spark, sf_dir, "drive_items").where("NOT is_folder").groupBy(route.alias("route")).agg(F.count("*").alias("files"))


ORACLES = {
    "drive_validate": """
SELECT CASE WHEN NOT coalesce(regexp_full_match(item_id, '[A-Za-z0-9_-]{1,512}'), false) THEN 'id' WHEN coalesce(name, '') = '' THEN 'name' WHEN mime_type IS NULL THEN 'mime type' WHEN modified_at IS NULL THEN 'modified'
WHEN len(owners) > 100 THEN 'owners' WHEN coalesce(size_bytes, 0) < 0 THEN 'size' ELSE 'ok' END AS rule, count(*) AS items FROM drive_items GROUP BY 1""",
    "drive_normalize": """
SELECT connection_id, item_id, 'Name: ' || coalesce(name, '') || chr(10) || 'Type: ' || coalesce(mime_type, '') AS content, coalesce(array_to_string(list_sort(list_distinct(list_filter(parent_ids, lambda x: x IS NOT NULL))), ','), '') AS parents
FROM (SELECT *, row_number() OVER (PARTITION BY connection_id, item_id ORDER BY modified_at DESC NULLS LAST, fetched_at DESC NULLS LAST, name DESC NULLS LAST, mime_type DESC NULLS LAST) AS n FROM drive_items) WHERE n = 1""",
    "drive_documents": f"""
WITH RECURSIVE {STORE['folder_paths'].split('WITH RECURSIVE', 1)[1].rsplit('SELECT connection_id, item_id, depth, path FROM (', 1)[0]}
, named AS (SELECT s.c, s.x, s.path, string_agg(coalesce(k.name, ''), '/' ORDER BY s.at) AS text FROM step s JOIN cur k ON k.connection_id = s.c AND k.item_id = s.id GROUP BY s.c, s.x, s.depth, s.path),
best AS (SELECT c, x, min(text) AS text FROM named WHERE length(text) <= 8000 GROUP BY 1, 2),
one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY connection_id, item_id ORDER BY modified_at DESC NULLS LAST, fetched_at DESC NULLS LAST, name DESC NULLS LAST, mime_type DESC NULLS LAST, drive_id DESC NULLS LAST, size_bytes DESC NULLS LAST, shortcut_target_id DESC NULLS LAST) AS n FROM drive_items) WHERE n = 1),
f AS (SELECT one.*, coalesce(text, name, '') AS way FROM one LEFT JOIN best ON c = connection_id AND x = item_id WHERE NOT coalesce(is_folder, false) AND connection_id IS NOT NULL AND item_id IS NOT NULL)
SELECT connection_id, item_id, concat_ws(chr(10), 'Name: ' || coalesce(name, ''), 'Type: ' || mime_type, 'Path: ' || way, CASE WHEN shortcut_target_id IS NOT NULL THEN 'Shortcut: indexed without following its target' END) AS content,
'https://drive.google.com/open?id=' || url_encode(item_id) AS url,
'{{' || concat_ws(',', '"file_id":' || CAST(to_json(item_id) AS VARCHAR), '"logical_path":' || CAST(to_json(way) AS VARCHAR), '"parent_ids":' || CASE WHEN parent_ids IS NULL THEN '[]' ELSE CAST(to_json(parent_ids) AS VARCHAR) END,
  CASE WHEN drive_id IS NOT NULL THEN '"drive_id":' || CAST(to_json(drive_id) AS VARCHAR) END, CASE WHEN size_bytes IS NOT NULL THEN '"size":' || size_bytes END, CASE WHEN shortcut_target_id IS NOT NULL THEN '"shortcut_target_id":' || CAST(to_json(shortcut_target_id) AS VARCHAR) END) || '}}' AS metadata FROM f""",
    "extraction_route": "SELECT CASE mime_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ROUTES.items()) + " ELSE 'descriptor' END AS route, count(*) AS files FROM drive_items WHERE NOT is_folder GROUP BY 1",
}
QUERIES = {f.__name__: f for f in (drive_validate, drive_normalize, drive_documents, extraction_route)}
