"""Text, identity and fingerprint functions as Column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Letters, digits and underscores, or one other visible character.
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"
#: Media types besides text/* whose content arrives as plain text (fixed values).
TEXT_MEDIA = (
    "application/json",
    "application/ld+json",
    "application/pdf",
    "application/toml",
    "application/vnd.google-apps.document",
    "application/vnd.google-apps.presentation",
    "application/vnd.google-apps.spreadsheet",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "application/xml",
    "application/x-httpd-php",
    "application/x-ndjson",
    "application/x-sh",
    "application/x-yaml",
    "application/yaml",
)


@F.pandas_udf(T.StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Canonical composition; Spark has no built-in for it."""
    return text.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFC", x))


@F.pandas_udf(T.StringType())
def casefold(text: pd.Series) -> pd.Series:
    """Full case folding (ß becomes ss), stronger than lower()."""
    return text.map(lambda x: None if x is None else x.casefold())


def squeeze(text: Column) -> Column:
    """One newline form, no control characters, single blanks inside lines, at most one empty line."""
    t = F.regexp_replace(text, "\r\n?", "\n")
    t = F.regexp_replace(t, r"[\x00-\x08\x0B-\x1F\x7F]", "")
    t = F.regexp_replace(t, r"[^\S\n]+", " ")
    t = F.regexp_replace(t, r" +(?=\n|$)", "")
    return F.regexp_replace(F.regexp_replace(t, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def normalize(text: Column) -> Column:
    """Composed and squeezed text."""
    return squeeze(nfc(text))


def tokens(text: Column) -> Column:
    """Lower-case tokens."""
    return F.transform(F.regexp_extract_all(text, F.lit(f"({TOKEN})"), F.lit(1)), F.lower)


def language(text: Column) -> Column:
    """'en' if at least 85 % of the letters are ASCII, else (and without letters) 'und'."""
    letters = F.length(F.regexp_replace(text, r"\P{L}", ""))
    plain = F.length(F.regexp_replace(text, r"[^A-Za-z]", ""))
    return F.when((letters > 0) & (plain >= letters * 0.85), "en").otherwise("und")


def indexable(mime_type: Column) -> Column:
    """Whether the media type can be indexed."""
    return F.coalesce(mime_type.startswith("text/") | mime_type.isin(*TEXT_MEDIA), F.lit(False))


def snippet(text: Column, size: int = 500) -> Column:
    """White space collapsed; longer texts end with an ellipsis at ``size`` characters."""
    t = F.regexp_replace(F.regexp_replace(text, r"\s+", " "), "^ | $", "")
    return F.when(F.length(t) > size, F.concat(F.rtrim(F.substring(t, 1, size - 1)), F.lit("…"))).otherwise(t)


def trigrams(text: Column) -> Column:
    """Distinct three-letter pieces of the lower-case words, padded by two blanks before and one after."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    pieces = F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.concat(F.lit("  "), w, F.lit(" ")).substr(i, F.lit(3))))
    return F.array_distinct(F.flatten(pieces))


def trigram_similarity(a: Column, b: Column) -> Column:
    """Common over all trigrams; 0 if there are none."""
    x, y = trigrams(a), trigrams(b)
    union = F.size(F.array_union(x, y))
    return F.when(union > 0, F.size(F.array_intersect(x, y)) / union).otherwise(F.lit(0.0))


def uuid5(namespace: Column, name: Column) -> Column:
    """Name-based UUID (SHA-1) as lower-case text."""
    h = F.sha1(F.concat(F.unhex(F.translate(namespace, "-", "")), F.encode(name, "utf-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def simhash64(words: Column) -> Column:
    """Bitwise majority of the first 64 digest bits of all tokens; a tie sets the bit."""
    halves = F.transform(words, lambda w: F.sha2(w, 256))
    sums = F.transform(
        F.sequence(F.lit(0), F.lit(15)),
        # counts per hex digit first: four bits share one pass over the digests
        lambda i: F.transform(halves, lambda h: F.conv(h.substr(i + 1, F.lit(1)), 16, 10).cast("int")),
    )

    def has(bit: int):
        return lambda v: v.bitwiseAND(bit) != 0

    def digit(values: Column) -> Column:
        n = F.size(values)
        value = F.lit(0)
        for bit in (8, 4, 2, 1):
            on = F.size(F.filter(values, has(bit)))
            value = value + F.when(on * 2 >= n, bit).otherwise(0)
        return F.lower(F.hex(value.cast("int")))

    return F.conv(F.array_join(F.transform(sums, digit), ""), 16, -10).cast("long")


def hash_embedding(text: Column, dimensions: int = 1536) -> Column:
    """Unit vector from counted digests; deterministic, not semantic."""
    blocks = F.flatten(
        F.transform(
            F.sequence(F.lit(0), F.lit(-(-dimensions // 32) - 1)),
            lambda i: F.transform(F.sequence(F.lit(0), F.lit(31)), lambda j: (F.conv(F.sha2(F.concat(i.cast("string"), F.lit(":"), text), 256).substr(j * 2 + 1, F.lit(2)), 16, 10).cast("double") - 127.5) / 127.5),
        )
    )
    values = F.slice(blocks, 1, dimensions)
    return values


def unit(vector: Column) -> Column:
    """A vector scaled to length one; null for the zero vector."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(norm > 0, F.transform(vector, lambda x: x / norm))


def dot(a: Column, b: Column) -> Column:
    """Scalar product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
