"""From document to chunks: normalising, gating, chunking, deduplicating, identities."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.session import table

PARSER, CHUNKER, MODEL = "text-parser-v1", "structure-words-v1", "local-hash-v1"
#: Namespace of the identities that the queries below derive (fixed value).
NAMESPACE = "6ba7b810-9dad-11d1-80b4-00c04fd430c8"
WINDOW, TARGET = 800, 600


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised texts with their length in characters and bytes."""
    d = documents(spark, sf_dir).select("doc_id", X.normalize(F.col("text")).alias("t"))
    return d.select("doc_id", F.md5("t").alias("digest"), F.length("t").cast("long").alias("n"), F.octet_length("t").cast("long").alias("bytes"))


def tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens per document with a digest of them all."""
    d = documents(spark, sf_dir).select("doc_id", X.tokens(F.col("text")).alias("t"))
    return d.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("digest")).where("n_tokens >= 0")


def detect_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detected against given language."""
    d = documents(spark, sf_dir).select(F.coalesce("lang", F.lit("none")).alias("lang"), X.language(F.col("text")).alias("detected"))
    return d.groupBy("lang", "detected").agg(F.count("*").alias("docs"))


def media_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents per media type and whether it can be indexed."""
    d = documents(spark, sf_dir)
    return d.groupBy(F.coalesce("mime_type", F.lit("none")).alias("mime_type")).agg(F.count("*").alias("docs"), F.max(X.indexable(F.col("mime_type"))).alias("indexable"))


def document_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens and bytes per source."""
    d = documents(spark, sf_dir).where("text IS NOT NULL").select("source", "text", F.size(X.tokens(F.col("text"))).alias("n"))
    return d.groupBy("source").agg(F.sum("n").alias("tokens"), F.sum(F.octet_length("text")).alias("bytes"))


def chunk_fixed_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 800 consecutive tokens: their place, size and last token."""
    d = documents(spark, sf_dir).select("doc_id", X.tokens(F.col("text")).alias("t")).where(F.size("t") > 0)
    w = d.select("doc_id", "t", F.explode(F.sequence(F.lit(0), F.floor((F.size("t") - 1) / WINDOW).cast("int"))).alias("window"))
    part = F.slice("t", F.col("window") * WINDOW + 1, F.lit(WINDOW))
    return w.select("doc_id", "window", F.size(part).cast("long").alias("n_tokens"), F.element_at(part, -1).alias("last_token"))


_WORD = re.compile(r"\w+|[^\w\s]")
_GAP = re.compile(r"\n\s*\n")
_HEADING = re.compile(r"(#{1,6})\s+(.+?)\s*")


def structure_chunks(text: str, target: int = TARGET, most: int = WINDOW) -> Iterator[tuple[list[str], int, int, int]]:
    """(heading path, start, end, tokens) of the chunks of a normalised text.

    Blocks between empty lines are packed until the next would pass ``most`` tokens, or a new heading
    follows after ``target``; a block larger than ``most`` is cut at token borders first. A chunk
    carries the heading path of its first block.
    """
    path: list[str] = []
    pieces: list[tuple[list[str], int, int, int]] = []
    edges = [m.span() for m in _GAP.finditer(text)]
    for a, b in zip([0, *(e for _, e in edges)], [*(s for s, _ in edges), len(text)]):
        if m := _HEADING.fullmatch(text, a, b):
            path = [*path[: len(m[1]) - 1], m[2]]
        spans = [m.span() for m in _WORD.finditer(text, a, b)]
        if len(spans) <= most:
            pieces.append((path, a, b, len(spans)))
        else:
            pieces += [(path, spans[i][0], spans[min(i + most, len(spans)) - 1][1], min(most, len(spans) - i)) for i in range(0, len(spans), most)]
    held: list[tuple[list[str], int, int, int]] = []
    for piece in [*pieces, None]:
        size = sum(p[3] for p in held)
        if held and (piece is None or size + piece[3] > most or (size >= target and piece[0] != held[-1][0])):
            yield held[0][0], held[0][1], held[-1][2], size
            held = []
        if piece is not None:
            held.append(piece)


class Fingerprints(dict):
    """Signs of the 64 leading digest bits of each token met; sums of them make a SimHash."""

    def __missing__(self, token: str) -> np.ndarray:
        if len(self) > 200_000:
            self.clear()
        bits = np.unpackbits(np.frombuffer(hashlib.sha256(token.encode("utf-8", "surrogatepass")).digest()[:8], dtype=np.uint8))
        self[token] = signs = bits.astype(np.int16) * 2 - 1
        return signs

    def simhash(self, tokens: list[str]) -> int:
        """Bitwise majority as a signed number; a tie sets the bit."""
        total = np.sum([self[t] for t in tokens], axis=0) if tokens else np.zeros(64)
        return int.from_bytes(np.packbits(total >= 0).tobytes(), "big", signed=True)


def chunk_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, position, heading_path, content, start_offset, end_offset, token_count, simhash) before deduplication."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints = Fingerprints()
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for n, (path, a, b, size) in enumerate(structure_chunks(text) if text else ()):
                    if size:
                        rows.append((doc, n, path, text[a:b].strip(), a, b, size, prints.simhash([t.casefold() for t in _WORD.findall(text, a, b)])))
            columns = list(zip(*rows)) or [[]] * 8
            kinds = [pa.int64(), pa.int32(), pa.list_(pa.string()), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "position", "heading_path", "content", "start_offset", "end_offset", "token_count", "simhash"])

    return docs.select("doc_id", X.normalize(F.col("text")).alias("t")).mapInArrow(run, "doc_id long, position int, heading_path array<string>, content string, start_offset int, end_offset int, token_count int, simhash long")


def keep_distinct(chunks: DataFrame) -> DataFrame:
    """First chunk of each wording in a document, numbered; near copies (three bits of SimHash) under one heading go too.

    The kept set is built chunk by chunk, as a near copy is compared with kept chunks only: a fold
    over the chunks of one document.
    """
    c = chunks.withColumn("hash", F.sha2("content", 256))
    first = Window.partitionBy("doc_id", "hash").orderBy("position")
    c = c.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")
    rows = c.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("position", "heading_path", "content", "start_offset", "end_offset", "token_count", "hash", "simhash"))).alias("all"))
    near = lambda k, x: (k["heading_path"] == x["heading_path"]) & (F.bit_count(k["simhash"].bitwiseXOR(x["simhash"])) <= 3)
    kept = F.aggregate("all", F.slice("all", 1, 0), lambda acc, x: F.when(F.exists(acc, lambda k: near(k, x)), acc).otherwise(F.concat(acc, F.array(x))))
    return rows.select("doc_id", F.posexplode(kept).alias("chunk_index", "k")).select("doc_id", "chunk_index", "k.*")


def chunk_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of all indexable documents with their identities."""
    d = documents(spark, sf_dir).where(X.indexable(F.col("mime_type")))
    k = keep_distinct(chunk_documents(d)).withColumn("version_id", X.uuid5(F.lit(NAMESPACE), F.col("doc_id").cast("string")))
    name = F.concat_ws(":", F.lit(CHUNKER), F.col("chunk_index").cast("string"), "hash")
    return k.select("doc_id", "chunk_index", X.uuid5(F.col("version_id"), name).alias("chunk_id"), F.array_join("heading_path", " / ").alias("heading"), "start_offset", "end_offset", "token_count", "simhash")


def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First chunk of each content within its source."""
    c = table(spark, sf_dir, "chunks").where("content IS NOT NULL").select("source_id", "chunk_index", "chunk_id", F.sha2("content", 256).alias("hash")).distinct()
    w = Window.partitionBy("source_id", "hash").orderBy("chunk_index", "chunk_id")
    return c.withColumn("n", F.row_number().over(w)).where("n = 1").select("source_id", "chunk_index", "chunk_id", "hash")


def near_dup_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of chunks under equal heading paths whose given fingerprints differ in at most three bits.

    Four tables of 16 bits: fingerprints within three bits agree in one of them. Chunks that share
    heading and fingerprint stand behind the first of them.
    """
    c = table(spark, sf_dir, "chunks").where("simhash IS NOT NULL AND simhash <> 0").select(F.coalesce(F.array_join("heading_path", "/"), F.lit("")).alias("heading"), "chunk_id", "simhash")
    c = c.groupBy("heading", "simhash").agg(F.min("chunk_id").alias("chunk_id"))
    keyed = c.select("*", F.posexplode(F.array(*[F.shiftrightunsigned("simhash", 16 * i).bitwiseAND(F.lit(65535)) for i in range(4)])).alias("t", "v"))
    other = keyed.select("heading", "t", "v", F.col("chunk_id").alias("chunk_id_b"), F.col("simhash").alias("h2"))
    apart = F.bit_count(F.col("simhash").bitwiseXOR(F.col("h2")))
    pairs = keyed.join(other, ["heading", "t", "v"]).where((F.col("chunk_id") < F.col("chunk_id_b")) & (apart <= 3))
    return pairs.select(F.col("chunk_id").alias("chunk_id_a"), "chunk_id_b", apart.cast("int").alias("distance")).distinct()


def simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash of every document title."""
    d = documents(spark, sf_dir).where("title <> ''").select("doc_id", X.tokens(F.col("title")).alias("t")).where(F.size("t") > 0)
    return d.select("doc_id", X.simhash64(F.col("t")).alias("simhash"))


def embed_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deterministic unit vectors (64 values) of every source name that occurs."""
    names = documents(spark, sf_dir).where("source IS NOT NULL").select(F.col("source").alias("name")).distinct()
    v = names.select("name", F.posexplode(X.unit(X.hash_embedding(F.col("name"), 64))).alias("i", "x"))
    return v.select("name", "i", F.round("x", 9).alias("x"))


def chunk_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash of the content of every chunk with a token; the same as ``simhash64`` of its tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits: dict[str, np.ndarray] = {}
        for batch in batches:
            out = []
            for tokens in batch.column(1).to_pylist():
                if len(bits) > 100_000:  # 64 bytes a token
                    bits.clear()
                for w in tokens:
                    if w not in bits:
                        bits[w] = np.unpackbits(np.frombuffer(hashlib.sha256(w.encode()).digest()[:8], np.uint8))
                on = np.sum([bits[w] for w in tokens], axis=0, dtype=np.int64)
                out.append(int.from_bytes(np.packbits(on * 2 >= len(tokens)).tobytes(), "big", signed=True))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.int64())], ["chunk_id", "simhash"])

    c = table(spark, sf_dir, "chunks").select("chunk_id", X.tokens(F.col("content")).alias("t")).where(F.size("t") > 0)
    return c.mapInArrow(run, "chunk_id string, simhash long")


def chunk_embeddings(spark: SparkSession, sf_dir: str, dimensions: int = 1536) -> DataFrame:
    """Deterministic unit vector of the content of every chunk; the same as ``unit`` of its ``hash_embedding``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                raw = bytearray()
                for text in part.column(1).to_pylist():
                    t = text.encode()
                    raw += b"".join(hashlib.sha256(b"%d:" % i + t).digest() for i in range(-(-dimensions // 32)))
                v = (np.frombuffer(raw, np.uint8).reshape(part.num_rows, -1)[:, :dimensions] - 127.5) / 127.5
                v /= np.sqrt((v * v).sum(1, keepdims=True))  # no byte is 127.5: never zero
                offsets = pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * dimensions)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(offsets, pa.array(v.ravel()))], ["chunk_id", "embedding"])

    return table(spark, sf_dir, "chunks").where("content IS NOT NULL").select("chunk_id", "content").mapInArrow(run, "chunk_id string, embedding array<double>")


def uuid5_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source and version identities of every document."""
    d = documents(spark, sf_dir).where("connection_id IS NOT NULL AND text IS NOT NULL")
    source = X.uuid5(F.col("connection_id"), F.col("doc_id").cast("string"))
    key = F.sha2(F.concat_ws("|", source, F.sha2("text", 256), F.lit(PARSER), F.lit(CHUNKER), F.lit(MODEL)), 256)
    return d.select("doc_id", source.alias("source_id"), key.alias("version_key")).withColumn("version_id", X.uuid5(F.col("source_id"), F.col("version_key")))


def source_derivations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timestamp, its kind and the extension of every Drive listing."""
    i = table(spark, sf_dir, "drive_items")
    ext = F.lower(F.regexp_extract("name", r"\.([A-Za-z0-9]{1,16})$", 1))
    owners = F.array_join(F.transform("owners", lambda o: F.coalesce(o["display_name"], o["normalized_identifier"])), ", ")
    return i.select(
        "item_id",
        "fetched_at",
        F.coalesce("modified_at", "fetched_at").alias("source_timestamp"),
        F.when(F.col("modified_at").isNotNull(), "modified").otherwise("fetched").alias("timestamp_kind"),
        F.when(ext != "", ext).alias("extension"),
        F.substring(F.coalesce(owners, F.lit("")), 1, 500).alias("author_display"),
        F.coalesce("size_bytes", F.lit(0)).alias("size_bytes"),
    ).distinct()


_T = "regexp_extract_all(text, '[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_\\s]')"
_U = "(lower(substr({h},1,8))||'-'||substr({h},9,4)||'-5'||substr({h},14,3)||'-'||substr('89ab',1+(position(substr({h},17,1) IN '0123456789abcdef')-1)%4,1)||substr({h},18,3)||'-'||substr({h},21,12))"


def sql_uuid5(namespace: str, name: str) -> str:
    return _U.format(h=f"sha1(unhex(replace({namespace},'-',''))||encode({name}))")


_UNIT = "(('0x'||substr(sha256(b||':'||name), 2*j+1, 2))::BIGINT::DOUBLE - 127.5)/127.5"
ORACLES = {
    "normalize_text": """
WITH n AS (SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(nfc_normalize(text), '\\r\\n?', chr(10), 'g'), '[\\x00-\\x08\\x0B-\\x1F\\x7F]', '', 'g'), '[^\\S\\n]+', ' ', 'g'), ' +\\n', chr(10), 'g'), ' +$', '', 'g'), '\\n{3,}', chr(10)||chr(10), 'g'), chr(10)||' '||chr(9)) AS t FROM documents)
SELECT doc_id, md5(t) AS digest, length(t) AS n, strlen(t) AS bytes FROM n""",
    "tokenize": f"SELECT doc_id, len(t) AS n_tokens, md5(lower(array_to_string(t, ' '))) AS digest FROM (SELECT doc_id, {_T} AS t FROM documents WHERE text IS NOT NULL)".replace("array_to_string(t, ' ')", "coalesce(array_to_string(t, ' '), '')"),
    "detect_language": """
SELECT coalesce(lang, 'none') AS lang, CASE WHEN l > 0 AND a >= l * 0.85 THEN 'en' ELSE 'und' END AS detected, count(*) AS docs
FROM (SELECT lang, coalesce(length(regexp_replace(text, '\\P{L}', '', 'g')), 0) AS l, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS a FROM documents) GROUP BY 1, 2""",
    "media_gate": "SELECT coalesce(mime_type, 'none') AS mime_type, count(*) AS docs, coalesce(bool_or(starts_with(mime_type, 'text/') OR mime_type IN (" + ", ".join(f"'{m}'" for m in X.TEXT_MEDIA) + ")), false) AS indexable FROM documents GROUP BY 1",
    "document_totals": f"SELECT source, CAST(sum(len({_T})) AS BIGINT) AS tokens, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM documents WHERE text IS NOT NULL GROUP BY 1",
    "chunk_fixed_window": f"""
WITH d AS (SELECT doc_id, {_T} AS t FROM documents),
w AS (SELECT doc_id, t, CAST(unnest(range((len(t) + 799) // 800)) AS INTEGER) AS "window" FROM d WHERE len(t) > 0),
p AS (SELECT doc_id, "window", t["window" * 800 + 1 : "window" * 800 + 800] AS part FROM w)
SELECT doc_id, "window", len(part) AS n_tokens, lower(part[len(part)]) AS last_token FROM p""",
    "exact_dedup": """
SELECT source_id, chunk_index, chunk_id, hash FROM (
  SELECT *, row_number() OVER (PARTITION BY source_id, hash ORDER BY chunk_index, chunk_id) AS n FROM (SELECT DISTINCT source_id, chunk_index, chunk_id, sha256(content) AS hash FROM chunks WHERE content IS NOT NULL)) WHERE n = 1""",
    "near_dup_pairs": """
WITH c AS (SELECT coalesce(array_to_string(heading_path, '/'), '') AS heading, min(chunk_id) AS chunk_id, simhash FROM chunks WHERE simhash IS NOT NULL AND simhash <> 0 GROUP BY 1, 3)
SELECT a.chunk_id AS chunk_id_a, b.chunk_id AS chunk_id_b, CAST(bit_count(xor(a.simhash, b.simhash)) AS INTEGER) AS distance
FROM c a JOIN c b ON a.heading = b.heading AND a.chunk_id < b.chunk_id WHERE bit_count(xor(a.simhash, b.simhash)) <= 3""",
    "simhash": f"""
WITH t AS (SELECT doc_id, unnest({_T.replace('text', 'title', 1)}) AS w FROM documents WHERE title <> ''),
h AS (SELECT doc_id, ('0x' || substr(sha256(lower(w)), 1, 16))::UBIGINT AS x FROM t),
b AS (SELECT doc_id, i, sum(CASE WHEN (x >> i) & 1 = 1 THEN 1 ELSE -1 END) AS s FROM h, (SELECT unnest(range(64))::UBIGINT AS i) GROUP BY 1, 2),
v AS (SELECT doc_id, sum(CASE WHEN s >= 0 THEN (1::HUGEINT << i::INTEGER) ELSE 0 END)::HUGEINT AS v FROM b GROUP BY 1)
SELECT doc_id, CAST(CASE WHEN v >= 9223372036854775808 THEN v - 18446744073709551616 ELSE v END AS BIGINT) AS simhash FROM v""",
    "embed_hash": f"""
WITH n AS (SELECT DISTINCT source AS name FROM documents WHERE source IS NOT NULL),
v AS (SELECT name, CAST(b * 32 + j AS INTEGER) AS i, {_UNIT} AS x FROM n, (SELECT unnest(range(2)) AS b), (SELECT unnest(range(32)) AS j))
SELECT name, i, round(x / sqrt(sum(x * x) OVER (PARTITION BY name)), 9) AS x FROM v""",
    "uuid5_ids": f"""
WITH s AS (SELECT doc_id, {sql_uuid5('connection_id', 'CAST(doc_id AS VARCHAR)')} AS source_id, text FROM documents WHERE connection_id IS NOT NULL AND text IS NOT NULL),
k AS (SELECT doc_id, source_id, sha256(source_id||'|'||sha256(text)||'|{PARSER}|{CHUNKER}|{MODEL}') AS version_key FROM s)
SELECT doc_id, source_id, version_key, {sql_uuid5('source_id', 'version_key')} AS version_id FROM k""",
    "source_derivations": """
SELECT DISTINCT item_id, fetched_at, coalesce(modified_at, fetched_at) AS source_timestamp, CASE WHEN modified_at IS NOT NULL THEN 'modified' ELSE 'fetched' END AS timestamp_kind,
nullif(lower(regexp_extract(name, '\\.([A-Za-z0-9]{1,16})$', 1)), '') AS extension,
substr(coalesce(array_to_string(list_filter(list_transform(owners, lambda o: coalesce(o.display_name, o.normalized_identifier)), lambda x: x IS NOT NULL), ', '), ''), 1, 500) AS author_display, coalesce(size_bytes, 0) AS size_bytes FROM drive_items""",
}
QUERIES = {f.__name__: f for f in (normalize_text, tokenize, detect_language, media_gate, document_totals, chunk_fixed_window, chunk_structure, exact_dedup, near_dup_pairs, simhash, embed_hash, chunk_simhash, chunk_embeddings, uuid5_ids, source_derivations)}
