"""Encoding of a whole corpus with a public byte-pair vocabulary.

Words are counted over all texts, the most frequent ones (``lexicon_words``, a bound that does
not grow with the corpus) are compiled into a transducer, and a second pass encodes every text:
words of the lexicon by the automaton, all others by exact merging. The result equals that of
the vocabulary's own library.

Defined results: a null or empty text gives an empty array (0 tokens); an empty table gives an
empty table; repeated rows and ties change nothing; other columns of the table are not read, so
their names cannot clash.
"""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.lexicon import Encoder, Lexicon, compile_lexicon, read_ranks, split_words
from tidemark.session import put_shared, stage

#: Folder of the public vocabularies on every machine.
TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
#: Texts handled at once in a task; bounds its memory.
STEP = 256


def word_counts(documents: DataFrame, text: str = "text") -> DataFrame:
    """(word, n) over all texts: counted inside each partition first, then shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])
            seen.clear()
            return out

        for batch in batches:
            for value in batch.column(0):
                if t := value.as_py():
                    seen.update(split_words(t))
            if len(seen) > 500_000:
                yield flush()
        yield flush()

    return documents.select(F.col(text).alias("t")).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(documents: DataFrame, text: str = "text", vocabulary: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken", lexicon_words: int = 32_768) -> str:
    """Compile the ``lexicon_words`` most frequent words; returns the artefact's name for the tasks.

    At most ``lexicon_words`` rows reach the driver, whatever the corpus holds.
    """
    spark = documents.sparkSession
    # words beyond 64 characters are rare and would only widen the automaton: merged exactly instead
    counts = stage(word_counts(documents, text).where("n > 1 and length(word) <= 64"), "words")
    # at most 64 * 16 classes of frequency; the widest range of whole classes that fits is taken
    level = F.floor(F.log2("n") * 16)
    sizes = counts.groupBy(level.alias("level")).agg(F.count("*").alias("words")).orderBy(F.desc("level")).collect()
    held, least = 0, None
    for r in sizes:
        if (held := held + r.words) > lexicon_words:
            break
        least = r.level
    top = counts.where(level >= least) if least is not None else counts.limit(0)
    data = compile_lexicon((r.word for r in top.select("word").collect()), read_ranks(vocabulary))
    uri = put_shared(spark, "lexicon", data)
    spark.sparkContext.addFile(uri)
    return os.path.basename(uri)


def _encoder(name: str, vocabulary: str) -> Encoder:
    return Encoder(Lexicon(SparkFiles.get(name)), read_ranks(vocabulary))


def encode(documents: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken", lexicon_words: int = 32_768, lexicon: str | None = None) -> DataFrame:
    """(key, ids): the token ids of every text, without special tokens."""
    name = lexicon or build_lexicon(documents, text, vocabulary, lexicon_words)
    kind = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(name, vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                part = batch.slice(at, STEP)
                count, ids = encoder.encode(part.column(1).to_pylist())
                offsets = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32)))], ["k", "ids"])

    out = documents.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"k {kind}, ids array<int>")
    return out.select(F.col("k").alias(key), "ids")


def token_counts(documents: DataFrame, keep: list[str], text: str = "text", vocabulary: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken", lexicon_words: int = 32_768) -> DataFrame:
    """The columns ``keep`` and ``n_tokens`` (int) of every row."""
    name = build_lexicon(documents, text, vocabulary, lexicon_words)
    data = documents.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(keep)], F.col(text).alias("t"))
    kinds = ", ".join(f"c{i} {data.schema[i].dataType.simpleString()}" for i in range(len(keep)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(name, vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                part = batch.slice(at, STEP)
                count, _ = encoder.encode(part.column(len(keep)).to_pylist(), ids=False)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(count.astype(np.int32))], [*(f"c{i}" for i in range(len(keep))), "n_tokens"])

    out = data.mapInArrow(run, f"{kinds}, n_tokens int")
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], "n_tokens")


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document by byte_bpe_50k."""
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"))
