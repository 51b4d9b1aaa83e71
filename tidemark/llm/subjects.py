"""Subject areas of documents from latent Dirichlet topics.

1. Terms: words of three letters and more outside mail header lines and addresses; kept are those
   found in at least ``rare`` and at most ``modelled`` of all documents (counted on all of them), and
   up to ``common`` where labelled documents say that they lean to a subject (``lean`` times its usual
   share). There are at most (distinct words of a document) / ``rare`` terms, whatever the corpus holds.
2. Topics: variational LDA, fitted in passes over all documents until it has settled: no topic moves more
   than ``SETTLED`` of its terms in the last pass (at most ``passes``). Every pass is a Spark job:
   tasks infer the topics of their documents and sum what each topic takes of each term, the sums
   are added up by term, and the next pass starts from them. One topic starts near the labelled
   documents and the description of each subject, ``background`` others at random; all are free
   to move, so terms that no label names come in by the company they keep. A topic holds terms of every
   language (``lang``) by shares of their own, as in polylingual topic models: with one vocabulary for all, the
   background turns into the rarer languages in later passes and takes their subject words along.
3. Topics to subjects: each topic goes to the subject that its top terms (those that it holds far
   more often than the corpus does) stand for in labels and descriptions, or to none.
4. Documents: the fitted model gives every document its topic proportions, and these its subject
   proportions (shares of what belongs to subjects at all); ``proportion`` and more is needed.
5. Sentences: in the light of the document's proportions every sentence goes to the subject that takes
   the largest part of its terms. Of the subjects of step 4, those stay (at most two) that hold
   ``share`` of the sentences with a subject and at least ``sentences`` of them: a stray one makes none.

Defined results: null, empty and blank texts and texts without terms have no subject; null document
ids are left out; of rows repeated under one id the longest text counts; labels with null values or
of unknown subjects are not read and repeated labels count once; without labels only the descriptions
speak; ties go to the subject first in the alphabet; an empty table gives an empty result; without a
column ``lang``, or where it is null, all terms are one language, as are those of languages with few
terms and the largest; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import stage, table

WORD = re.compile(r"[^\W\d_]{3,}")
HEADER = re.compile(r"^(?:From|To|Cc|Von|An|De|À|Para) ?:.*$", re.M)
ADDRESS = re.compile(r"\S+@\S+")
#: Sentence ends, also inside quoted values: line ends, or a mark, what closes and white space.
SENTENCE = re.compile(r"[.!?\n](?:(?<=\n)\n*|[\"'”»)\]]*[,;]?\s+)")
#: What parts words becomes a blank: bytes by table, characters beyond ASCII one by one.
LETTERS = bytes(b if b > 127 or chr(b).isalpha() else 32 for b in range(256))
NO_LETTER = re.compile(r"[\W\d]")
#: Topics have settled when none moves a larger share of its terms in a pass.
SETTLED = 0.01
#: From the second pass on topics go on this much further than a pass moves them, to settle in fewer.
BEYOND = 0.5
#: A document's topics have settled when a round moves a smaller share of its terms; most take 2 to 5 of at most ``ROUNDS``.
STILL, ROUNDS = 0.001, 12


def _plain(text: str) -> str:
    return ADDRESS.sub(" ", HEADER.sub("", text)).lower() if "@" in text else text.lower()


def _spelled(texts: list[str], sentences: bool = False) -> list[bytes]:
    """The runs of letters of all texts (UTF-8), ``b"D"`` between texts and, if wanted, ``b"S"`` between sentences;
    lower-cased texts have no capitals of ASCII."""
    text = " D ".join(map(_plain, texts))
    if sentences:
        text = SENTENCE.sub(" S ", text)
    if not text.isascii():
        others = [c for c in set(text) if c > "\x7f" and NO_LETTER.match(c)]
        if len(others) > 50:
            text = NO_LETTER.sub(" ", text)
        else:
            for c in others:
                text = text.replace(c, " ")
    return text.encode().translate(LETTERS).split()


def _pieces(batch: pa.RecordBatch, texts: pa.Array, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Rows in order, by about ``most`` bytes of text."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, to - at)
        at = to


def term_frequencies(documents: DataFrame) -> DataFrame:
    """(term, df, lang) over all documents, counted in each partition first; ``lang`` is the language most
    of the term's documents are in, null where none of them has one."""

    class Numbers(dict):
        def __missing__(self, key):
            self[key] = n = len(self)
            return n

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, langs, seen = Numbers(), Numbers(), Counter()

        def flush() -> pa.RecordBatch:
            texts, names = [w.decode() for w in words], list(langs)
            rows = [(texts[key & 0xFFFFFFFF], names[key >> 32], n) for key, n in seen.items() if len(texts[key & 0xFFFFFFFF]) > 2]
            for known in (words, langs, seen):
                known.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.string(), pa.string(), pa.int64()))], ["term", "lang", "df"])

        for batch in batches:
            for part in _pieces(batch, batch.column(0)):
                spelled = _spelled(part.column(0).to_pylist())
                number = np.fromiter(map(words.__getitem__, spelled), np.int64, len(spelled))
                doc = np.cumsum(number == words[b"D"])
                each = np.unique(doc << 32 | number)
                lang = np.fromiter(map(langs.__getitem__, part.column(1).to_pylist()), np.int64, part.num_rows)[each >> 32]
                key, n = np.unique(lang << 32 | each & 0xFFFFFFFF, return_counts=True)
                for k, c in zip(key.tolist(), n.tolist()):
                    seen[k] += c
                if len(seen) > 500_000:
                    yield flush()
        yield flush()

    lang = F.col("lang").cast("string") if "lang" in documents.columns else F.lit(None).cast("string")
    each = documents.select("text", lang.alias("lang")).mapInArrow(count, "term string, lang string, df long").groupBy("term", "lang").agg(F.sum("df").alias("df"))
    return each.groupBy("term").agg(F.sum("df").alias("df"), F.max(F.when(F.col("lang").isNotNull(), F.struct("df", "lang")))["lang"].alias("lang"))


def vocabularies(langs: list[str | None], used: np.ndarray, few: float = 0.02) -> np.ndarray:
    """The number of each term's language, -1 for terms that are not used; those without a language and of
    languages with less than ``few`` of the used terms go with the largest."""
    known, number = np.unique([lang or "" for lang in langs], return_inverse=True)
    size = np.bincount(number[used], minlength=len(known)) * (known != "")
    small = (size < max(few * used.sum(), 1))[number]
    return np.where(used, np.where(small, size.argmax(), number), -1)


def encoded(documents: DataFrame, terms: list[str]) -> DataFrame:
    """(doc_id, ids, sentence): the known terms of each document and the sentence each stands in."""
    place = documents.sparkSession.sparkContext.broadcast({t.encode(): i for i, t in enumerate(terms)} | {b"S": -2, b"D": -3})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = place.value.get
        for batch in batches:
            for part in _pieces(batch, batch.column(1)):
                spelled = _spelled(part.column(1).to_pylist(), sentences=True)
                ids = np.fromiter(map(get, spelled, repeat(-1)), np.int32, len(spelled))
                doc, sentence = np.cumsum(ids == -3), np.cumsum(ids < -1)
                sentence -= np.r_[0, sentence[ids == -3]][doc]
                at = np.flatnonzero(ids >= 0)
                o = pa.array(np.r_[0, np.cumsum(np.bincount(doc[at], minlength=part.num_rows))].astype(np.int32))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(o, pa.array(ids[at])), pa.ListArray.from_arrays(o, pa.array(sentence[at].astype(np.int32)))], ["doc_id", "ids", "sentence"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>, sentence array<int>")


def _digamma(x: np.ndarray) -> np.ndarray:
    """The digamma function of positive numbers: recurrence up to 6, then its asymptotic series."""
    low = sum(1 / (x + i) for i in range(6))
    x = x + 6
    y = 1 / (x * x)
    return np.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y / 252)) - low


def _totals(topics: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Sums of each topic in the vocabulary of each term."""
    total = np.zeros((words.max(initial=0) + 1, topics.shape[1]))
    np.add.at(total, words[words >= 0], topics[words >= 0])
    total[total == 0] = 1
    return total[np.maximum(words, 0)]


def _expected(topics: np.ndarray, words: np.ndarray | None = None) -> np.ndarray:
    """exp(E[log p(term | topic)]) of Dirichlet parameters (term, topic), one Dirichlet for each vocabulary."""
    words = np.zeros(len(topics), dtype=np.int64) if words is None else words
    return np.exp(_digamma(topics) - _digamma(_totals(topics, words))).astype(np.float32)


def moved(before: np.ndarray, after: np.ndarray, words: np.ndarray) -> float:
    """The largest share of its terms that a topic holds in ``after`` but not in ``before``."""
    a, b = before[words >= 0], after[words >= 0]
    return float(0.5 * np.abs(b / b.sum(0) - a / a.sum(0)).sum(0).max())


def _padded(own: np.ndarray, begin: np.ndarray, length: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of the documents ``own`` those of similar length together: which they are, (document, place) of their terms
    and which places hold one."""
    width = np.ceil(2 ** (np.ceil(2 * np.log2(np.maximum(length[own], 4))) / 2)).astype(np.int64)
    for w in np.unique(width):
        same = own[width == w]
        for some in np.array_split(same, -(-len(same) * w // (1 << 16))):
            inside = np.arange(w) < length[some, None]
            yield some, np.where(inside, begin[some, None] + np.arange(w), 0), inside


def _weights(gamma: np.ndarray) -> np.ndarray:
    """exp(digamma) of positive numbers, to a millionth: recurrence up to 3, then the asymptotic series."""
    x = gamma + 3
    y = 1 / (x * x)
    return x * np.exp(-0.5 / x - y * (1 / 12 - y * (1 / 120 - y / 252)) - ((3 * gamma + 6) * gamma + 2) / (gamma * (gamma + 1) * (gamma + 2)))


def proportions(begin: np.ndarray, term: np.ndarray, count: np.ndarray, expected: np.ndarray, alpha: float, rounds: int) -> np.ndarray:
    """exp(E[log p(topic | document)]) (document, topic) of documents that begin at ``begin`` and end where the next
    does. A document is settled when a round moves less than ``STILL`` of its terms; the few that are not after
    some rounds go on together."""
    k, length = expected.shape[1], np.diff(np.r_[begin, len(term)])
    total = np.add.reduceat(count, begin)
    gamma = np.repeat(np.float32(alpha) + total[:, None] / np.float32(k), k, axis=1)
    theta = np.empty_like(gamma)
    todo, done = np.arange(len(begin)), 0
    while len(todo) and done < rounds:
        left, some = [], min(5 if done == 0 else rounds, rounds - done)
        for own, at, inside in _padded(todo, begin, length):
            w, c, g, least = expected[term[at]], np.where(inside, count[at], np.float32(0)), gamma[own], STILL * total[own]
            for _ in range(some):
                now = _weights(g)
                share = c / np.maximum((w @ now[:, :, None])[:, :, 0], 1e-30)
                before, g = g, alpha + now * (share[:, None] @ w)[:, 0]
                moves = np.abs(g - before).max(1) > least
                if not moves.any():
                    break
            theta[own], gamma[own] = now, g
            left.append(own[moves])
        todo, done = np.concatenate(left), done + some
    return theta


def taken(begin: np.ndarray, term: np.ndarray, count: np.ndarray, expected: np.ndarray, alpha: float, rounds: int) -> np.ndarray:
    """What each topic takes of the count of each term of the documents."""
    theta = proportions(begin, term, count, expected, alpha, rounds)
    part = expected[term] * np.repeat(theta, np.diff(np.r_[begin, len(term)]), axis=0)
    part *= count[:, None] / np.maximum(part.sum(1, keepdims=True), 1e-30)
    return part


def infer(ids: np.ndarray, doc: np.ndarray, n: int, expected: np.ndarray, alpha: float, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Topic parameters (document, topic) of ``n`` documents, and their distinct (document, term) with
    the share of each topic in it times its weight, 1 + log(count), so that no long text rules a topic."""
    k = expected.shape[1]
    d, term, count = _counted(ids, doc)
    gamma = np.full((n, k), alpha, dtype=np.float32)
    if not len(d):
        return gamma, d, term, np.zeros((0, k), dtype=np.float32)
    begin = np.flatnonzero(np.r_[True, d[1:] != d[:-1]])
    part = taken(begin, term, count, expected, alpha, rounds)
    gamma[d[begin]] += np.add.reduceat(part, begin, axis=0)
    return gamma, d, term, part


def _counted(ids: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, term) and their weights."""
    pair, count = np.unique(doc.astype(np.int64) << 32 | ids, return_counts=True)
    return pair >> 32, pair & 0xFFFFFFFF, 1 + np.log(count.astype(np.float32))


def counted(docs: DataFrame, used: np.ndarray) -> DataFrame:
    """(terms, weights): the distinct used terms of every document that has some, as int32, and their weights, as float32."""
    known = docs.sparkSession.sparkContext.broadcast(used)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                ids, doc, _ = _tokens(batch.slice(at, 1024), 0, known.value)
                d, term, count = _counted(ids, doc)
                o = pa.py_buffer((4 * np.r_[np.flatnonzero(np.diff(d, prepend=-1)), len(d)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.Array.from_buffers(pa.binary(), len(o) // 4 - 1, [None, o, pa.py_buffer(x)]) for x in (term.astype(np.int32), count)], ["terms", "weights"])

    return docs.select("ids").mapInArrow(run, "terms binary, weights binary")


def _numbers(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The numbers in a binary column, and where each row begins."""
    column = column.cast(pa.binary())
    o = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1] // 4
    return np.frombuffer(column.buffers()[2], kind)[o[0] : o[-1]], (o[:-1] - o[0]).astype(np.int64)


def _tokens(part: pa.RecordBatch, column: int, used: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Term and document of every place with a used term, and which places these are."""
    ids = part.column(column).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    doc = np.repeat(np.arange(part.num_rows), part.column(column).value_lengths().to_numpy(zero_copy_only=False))
    at = np.flatnonzero(used[ids])
    return ids[at], doc[at], at


def topic_model(docs: DataFrame, start: np.ndarray, prior: np.ndarray, words: np.ndarray, alpha: float, passes: int) -> np.ndarray:
    """Dirichlet parameters (term, topic) that have settled from ``start``, after ``passes`` passes at most;
    (terms * topics) numbers reach the driver in each, whatever the corpus holds."""
    spark, (terms, k) = docs.sparkSession, start.shape
    docs = stage(counted(docs, words >= 0), "counted")
    columns = [f"t{i}" for i in range(k)]
    topics = after = start
    for i in range(passes):
        model = spark.sparkContext.broadcast(_expected(topics, words))

        def collect(batches: Iterator[pa.RecordBatch], model=model) -> Iterator[pa.RecordBatch]:
            total, expected = np.zeros((terms, k)), model.value
            for batch in batches:
                for at in range(0, batch.num_rows, 16384):
                    part = batch.slice(at, 16384)
                    (term, begin), (count, _) = _numbers(part.column(0), np.int32), _numbers(part.column(1), np.float32)
                    took = taken(begin, term, count, expected, alpha, ROUNDS)
                    order = np.argsort(term, kind="stable")
                    first = np.flatnonzero(np.diff(term[order], prepend=-1))
                    total[term[order[first]]] += np.add.reduceat(took[order], first, axis=0)
            some = np.flatnonzero(total.any(1))
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), *(pa.array(total[some, i]) for i in range(k))], ["term", *columns])

        sums = docs.mapInArrow(collect, f"term int, {', '.join(f'{c} double' for c in columns)}").groupBy("term").agg(*[F.sum(c).alias(c) for c in columns]).toPandas()
        after = prior.copy()
        after[sums["term"].to_numpy()] += sums[columns].to_numpy()
        model.unpersist()
        if moved(topics, after, words) <= SETTLED:
            break
        topics = np.maximum(after + BEYOND * (after - topics), prior) if i else after
    return after


def labelled_terms(docs: DataFrame, labels: DataFrame, subjects: DataFrame, terms: list[str]) -> tuple[list[str], np.ndarray]:
    """The subjects, and how many labelled documents and descriptions of each hold a term (term, subject)."""
    rows = subjects.where("subject IS NOT NULL").groupBy("subject").agg(F.max("description").alias("d")).orderBy("subject").collect()  # the closed list
    names = [r.subject for r in rows]
    seen = np.zeros((len(terms), len(names)))
    place, at = {t: i for i, t in enumerate(terms)}, {s: i for i, s in enumerate(names)}
    for s, r in enumerate(rows):
        for w in WORD.findall((r.d or "").lower()):
            if w in place:
                seen[place[w], s] += 1
    known = labels.where("doc_id IS NOT NULL").join(subjects.select("subject").distinct(), "subject").select("doc_id", "subject").distinct()
    each = known.groupBy("doc_id").agg(F.collect_set("subject").alias("subjects"))  # a document has few labels
    counted = docs.join(each, "doc_id").select(F.explode(F.array_distinct("ids")).alias("term"), "subjects", (1 / F.size("subjects")).alias("w"))
    # one row per term and subject
    for r in counted.select("term", F.explode("subjects").alias("subject"), "w").groupBy("term", "subject").agg(F.sum("w").alias("w")).collect():
        seen[r.term, at[r.subject]] += r.w
    return names, seen


def first_topics(seen: np.ndarray, df: np.ndarray, background: int, seed: int) -> np.ndarray:
    """Where the topics start: one near the evidence for each subject, the others at random."""
    rng = np.random.default_rng(seed)
    subjects = seen.shape[1]
    usual = seen.sum(0, keepdims=True) / max(1.0, seen.sum())
    lift = (seen + 0.5 * usual) / (seen.sum(1, keepdims=True) + 0.5)  # share of a subject in the evidence for a term
    start = np.empty((len(df), subjects + background))
    start[:, :subjects] = df[:, None] * lift**2 + 0.01
    rest = 1 - np.clip((lift - usual).max(1, initial=0), 0, 1)  # what leans to a subject is less of the background
    start[:, subjects:] = (df * rest)[:, None] * rng.gamma(20.0, 0.05, (len(df), background)) * 0.1 + 0.01
    return start


def subjects_of_topics(topics: np.ndarray, df: np.ndarray, seen: np.ndarray, top: int = 100) -> np.ndarray:
    """The subject of every topic by its top terms, -1 where no subject has half of
    their evidence and twice that of the next."""
    if not seen.shape[1]:
        return np.full(topics.shape[1], -1)
    p = topics / topics.sum(0, keepdims=True)
    score = p * np.log(p / (df / df.sum())[:, None])
    usual = np.maximum(seen.sum(0), 1e-9)
    out = []
    for k in range(topics.shape[1]):
        best = np.argsort(-score[:, k], kind="stable")[:top]
        evidence = (score[best, k, None] * seen[best] / usual).sum(0)
        second = np.sort(evidence)[-2] if len(evidence) > 1 else 0
        out.append(int(evidence.argmax()) if evidence.max() >= max(0.5 * evidence.sum(), 2 * second) > 0 else -1)
    return np.asarray(out)


def document_subjects(documents: DataFrame, labels: DataFrame, subjects: DataFrame, rare: float = 0.0005, common: float = 0.15, modelled: float = 0.05, lean: float = 3.0, background: int = 2, passes: int = 100, alpha: float = 0.05, eta: float = 0.02, trust: float = 10.0, proportion: float = 0.1, share: float = 0.25, sentences: int = 2, seed: int = 1) -> DataFrame:
    """(doc_id, subject): the subject areas each document is about."""
    spark = documents.sparkSession
    texts = documents.where("doc_id IS NOT NULL AND trim(text) <> ''").select("doc_id", "text", *(["lang"] if "lang" in documents.columns else []))
    n = texts.count()
    counts = term_frequencies(texts).where(F.col("df").between(max(3, rare * n), max(3, common * n))).orderBy("df", "term").collect()
    terms, df = [r.term for r in counts], np.asarray([r.df for r in counts], dtype=np.float64)
    docs = stage(encoded(texts, terms).groupBy("doc_id").agg(F.max(F.struct(F.size("ids").alias("n"), "ids", "sentence")).alias("d")).select("doc_id", "d.ids", "d.sentence"), "terms")
    names, seen = labelled_terms(docs, labels, subjects, terms) if terms else ([], None)
    if not names:
        return docs.select("doc_id", F.lit("").alias("subject")).limit(0)
    start = first_topics(seen, df, background, seed)
    prior = np.full(start.shape, eta)  # labelled documents also count in every pass
    usual = seen.sum(0) / max(1.0, seen.sum())
    lift = (seen + usual) / (seen.sum(1, keepdims=True) + 1) / np.maximum(usual, 1e-9)
    prior[:, : len(names)] += trust * seen * (lift > 1.5)
    used = (df <= modelled * n) | ((seen.sum(1) >= 5) & (lift.max(1, initial=0) >= lean))
    words = vocabularies([r.lang for r in counts], used)
    if not used.any():
        return docs.select("doc_id", F.lit("").alias("subject")).limit(0)
    topics = topic_model(docs, start, prior, words, alpha, passes)
    of_topic = np.zeros((topics.shape[1], len(names)), dtype=np.float32)
    for k, subject in enumerate(subjects_of_topics(topics, df, seen)):
        if subject >= 0:
            of_topic[k, subject] = 1
    shared = spark.sparkContext.broadcast((_expected(topics, words), of_topic, used))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expected, of_topic, used = shared.value
        s = len(names)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                ids, doc, spots = _tokens(part, 1, used)
                sentence = part.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.int64)[spots]
                gamma, d, term, took = infer(ids, doc, part.num_rows, expected, alpha)
                about = (gamma - alpha) @ of_topic
                about /= np.maximum(about.sum(1, keepdims=True), 1e-9)
                # each place of a term has the term's topics in this document
                took = (took / np.maximum(took.sum(1, keepdims=True), 1e-30)) @ of_topic
                place = doc * (1 << 24) + sentence  # in order
                begin = np.flatnonzero(np.diff(place, prepend=-1))
                mass = took[np.searchsorted(d << 32 | term, doc << 32 | ids)]
                mass = np.add.reduceat(mass, begin, axis=0) if len(begin) else mass
                owner, top, ok = place[begin] >> 24, mass.argmax(1), mass.max(1, initial=0) > 0.5
                held = np.bincount(owner[ok] * s + top[ok], minlength=part.num_rows * s).reshape(-1, s)
                good = (about >= proportion) & (held >= sentences) & (held >= share * held.sum(1, keepdims=True))
                rank = np.argsort(np.argsort(-np.where(good, about, 0), axis=1, kind="stable"), axis=1)
                row, column = np.nonzero(good & (rank < 2))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array([names[i] for i in column], pa.string())], ["doc_id", "subject"])

    return docs.mapInArrow(assign, "doc_id long, subject string")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subject areas of every document."""
    return document_subjects(table(spark, sf_dir, "documents"), table(spark, sf_dir, "subject_labels"), table(spark, sf_dir, "subjects"))


def p9_makeup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The make-up of the corpus: documents and characters per source and subject."""
    d = table(spark, sf_dir, "documents").groupBy("doc_id").agg(F.max("source").alias("source"), F.max("n_chars").alias("n_chars"))
    s = d.join(p9_found(spark, sf_dir), "doc_id", "left")
    return s.groupBy("source", F.coalesce("subject", F.lit("none")).alias("subject")).agg(F.count("*").alias("docs"), F.coalesce(F.sum("n_chars"), F.lit(0)).alias("chars"))
