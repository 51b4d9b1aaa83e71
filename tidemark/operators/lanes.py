"""Retrieval lanes over eligible chunks: exact, keyword, vector and trigram, fused by rank.

The four lanes read one shared frame of eligible chunks and each keeps its best rows only, so what
is fused is bounded by the lanes' sizes, not by the corpus.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.session import stage, table

#: Lane sizes, rank weights and the rank constant; feature weights of the final score (fixed values).
SIZES = {"exact": 50, "keyword": 100, "vector": 100, "trigram": 50}
WEIGHTS = {"exact": 1.5, "keyword": 1.25, "vector": 1.0, "trigram": 0.75}
FEATURES = {"vector": 0.30, "keyword": 0.25, "exact": 0.20, "trigram": 0.10}
QUALITY, RANK_CONSTANT = 0.05, 60
#: The request that the registered queries run.
QUERY = "loading dock"


@dataclass(frozen=True)
class Plan:
    """A normalised query with its quoted phrases."""

    text: str
    phrases: tuple[str, ...] = field(default=())

    @property
    def literal(self) -> str:
        """What the exact lane looks for: the first quoted phrase, else the whole query."""
        return self.phrases[0] if self.phrases else self.text


def plan(query: str) -> Plan:
    """Compatibility form, single blanks, case folded; an empty query is an error."""
    text = " ".join(unicodedata.normalize("NFKC", query).split()).casefold()
    if not text:
        raise ValueError("the query is empty")
    return Plan(text, tuple(p.strip() for p in re.findall(r'"([^"\n]{1,500})"', text) if p.strip()))


def parse_web_query(text: str) -> list[list[tuple[bool, list[str]]]]:
    """Alternatives of conjunctions of (wanted, words of a phrase): blanks mean and, ``or``, ``-`` not."""
    groups: list[list[tuple[bool, list[str]]]] = [[]]
    for minus, phrase, word in re.findall(r'(-?)(?:"([^"]*)"|(\S+))', text.lower()):
        if word == "or" and not minus:
            groups.append([])
        elif words := re.findall(r"[^\W_]+", phrase or word):
            groups[-1].append((not minus, words))
    return [g for g in groups if g]


def keyword_match(words: Column, text: str) -> Column:
    """Whether an array of words satisfies a web query; phrases need neighbouring words."""

    def holds(phrase: list[str]) -> Column:
        if len(phrase) == 1:
            return F.array_contains(words, phrase[0])
        joined = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
        return joined.contains(" " + " ".join(phrase) + " ")

    any_ = F.lit(False)
    for group in parse_web_query(text):
        all_ = F.lit(True)
        for wanted, phrase in group:
            all_ = all_ & (holds(phrase) if wanted else ~holds(phrase))
        any_ = any_ | all_
    return any_


def eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searchable chunks: the newest row of every chunk whose connection is active, with its title."""
    c = table(spark, sf_dir, "chunks").select("chunk_id", "connection_id", "source_id", "chunk_index", "heading_path", "content", "token_count", "embedding", "modified_at", "indexed_at")
    newest = Window.partitionBy("chunk_id").orderBy(F.desc_nulls_last("indexed_at"), F.desc_nulls_last("modified_at"))
    c = c.withColumn("n", F.row_number().over(newest)).where("n = 1 AND content <> ''").drop("n", "indexed_at")
    active = table(spark, sf_dir, "connections").where("status = 'active'").select("connection_id", "provider", "workspace_id")
    return c.join(active, "connection_id").withColumn("title", F.coalesce(F.array_join("heading_path", " "), F.lit("")))


def search_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eligible chunks written once for all lanes of a request: each lane then scans only its
    columns, and the newest-row window over whole chunks runs once instead of once a lane."""
    return stage(eligible(spark, sf_dir), "eligible")


_KEPT = ["chunk_id", "source_id", "chunk_index", "title", "content", "token_count", "modified_at", "raw_score"]


def _lane(scored: DataFrame, lane: str) -> DataFrame:
    """The best rows of a lane, ranked; ties go to the smaller chunk id."""
    top = scored.withColumn("raw_score", F.round("raw_score", 6)).select(*_KEPT).orderBy(F.desc("raw_score"), "chunk_id").limit(SIZES[lane])
    rank = Window.partitionBy("lane").orderBy(F.desc("raw_score"), "chunk_id")
    return top.withColumn("lane", F.lit(lane)).withColumn("rank", F.row_number().over(rank))


def _literal(p: Plan) -> tuple[Column, Column]:
    """Score and condition of a literal match: title equal 1.0, title containing 0.8, content containing 0.6."""
    q, title = F.lit(p.literal), F.lower("title")
    return F.when(title == q, 1.0).when(title.contains(q), 0.8).otherwise(0.6), title.contains(q) | F.lower("content").contains(q)


def exact_lane(chunks: DataFrame, p: Plan) -> DataFrame:
    """Chunks that hold the query literally."""
    score, match = _literal(p)
    return _lane(chunks.where(match).withColumn("raw_score", score), "exact")


def words(text: Column) -> Column:
    """Lower-case words of letters and digits in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def keyword_lane(chunks: DataFrame, p: Plan) -> DataFrame:
    """Chunks matching the web query, ranked by cover density of its words."""
    terms = sorted({w for g in parse_web_query(p.text) for wanted, phrase in g if wanted for w in phrase})

    def places(term: str) -> Column:
        marked = F.transform("w", lambda x, i: F.struct(x.alias("x"), i.alias("i")))
        return F.transform(F.filter(marked, lambda s: s["x"] == term), lambda s: s["i"])


    def density(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["raw_score"] = [cover_density([list(x) for x in row]) for row in b.pop("positions")]
            yield b

    matched = chunks.withColumn("w", words(F.col("content"))).where(keyword_match(F.col("w"), p.text))
    matched = matched.select(*_KEPT[:-1], F.array(*map(places, terms)).alias("positions"))
    schema = matched.drop("positions").withColumn("raw_score", F.lit(0.0)).schema
    return _lane(matched.mapInPandas(density, schema), "keyword")


def cover_density(positions: list[list[int]]) -> float:
    """Sum over the minimal stretches that hold every word: more words in less room score higher."""
    if not positions or not all(positions):
        return 0.1 * sum(map(len, positions))
    marks = sorted((i, t) for t, p in enumerate(positions) for i in p)
    last: dict[int, int] = {}
    total, start = 0.0, -1
    for at, t in marks:
        last[t] = at
        if len(last) == len(positions) and (begin := min(last.values())) > start:
            total += 0.1 * len(positions) / (len(positions) + max(0, at - begin + 1 - len(positions)))
            start = begin
    return total


def _proper(vector: str) -> Column:
    return (F.size(vector) == 64) & F.exists(vector, lambda x: x != 0) & F.forall(vector, lambda x: ~F.isnan(x))


def vector_lane(chunks: DataFrame, query: list[float], least: float = 0.1) -> DataFrame:
    """Chunks by cosine with a query vector."""
    q = F.array(*map(F.lit, query)).cast("array<double>")
    cosine = X.dot(F.col("embedding"), q) / F.sqrt(X.dot(F.col("embedding"), F.col("embedding")) * X.dot(q, q))
    return _lane(chunks.where(_proper("embedding") if query else F.lit(False)).withColumn("raw_score", F.greatest(cosine, F.lit(0.0))).where(F.col("raw_score") >= least), "vector")


def trigram_lane(chunks: DataFrame, p: Plan, least: float = 0.15) -> DataFrame:
    """Chunks whose title is like the query by common trigrams."""
    return _lane(chunks.withColumn("raw_score", X.trigram_similarity(F.col("title"), F.lit(p.text))).where(F.col("raw_score") >= least), "trigram")


def query_vector(chunks: DataFrame, p: Plan, best: int = 10) -> list[float]:
    """A vector for the query: the mean embedding of its ``best`` literal matches, none without a match.

    The embeddings of the table come from a model that is not at hand, so the query cannot be embedded
    itself; what matches it literally stands for it (relevance feedback).
    """
    score, match = _literal(p)
    top = chunks.where(match & _proper("embedding")).orderBy(F.desc(score), "chunk_id").limit(best)
    mean = top.select(F.posexplode("embedding").alias("i", "v")).groupBy("i").agg(F.avg(F.col("v").cast("double")).alias("v"))
    return [r.v for r in mean.orderBy("i").collect()]  # as many numbers as an embedding has


def fuse(lanes: DataFrame) -> DataFrame:
    """Fused and feature scores of the union of lanes, one row per chunk.

    Reciprocal-rank sums and the four signals (raw score over the lane's maximum) come from one
    aggregation; features that a chunk lacks are left out of the weighted mean.
    """
    top = F.max("raw_score").over(Window.partitionBy("lane"))
    weight = F.create_map(*[F.lit(x) for kv in WEIGHTS.items() for x in kv])
    signal = F.greatest(F.lit(0.0), F.col("raw_score") / F.when(top > 0, top).otherwise(1.0))
    s = lanes.withColumn("signal", signal).withColumn("part", weight[F.col("lane")] / (RANK_CONSTANT + F.col("rank")))
    kept = [F.first(c).alias(c) for c in _KEPT[1:-1]]
    c = s.groupBy("chunk_id").agg(F.sum("part").alias("rrf"), *[F.max(F.when(F.col("lane") == k, F.col("signal"))).alias(k) for k in FEATURES], *kept)
    value, share = F.lit(QUALITY), F.lit(QUALITY)
    for k, w in FEATURES.items():
        value, share = value + F.coalesce(F.col(k), F.lit(0.0)) * w, share + F.when(F.col(k).isNotNull(), w).otherwise(0.0)
    best = F.max("rrf").over(Window.partitionBy(F.lit(0)))  # at most the sum of the lane sizes
    score = 0.25 * F.col("rrf") / F.when(best > 0, best).otherwise(1.0) + 0.75 * value / share
    return c.withColumn("score", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)), 6))


def pick(scored: DataFrame, limit: int = 20, per_source: int = 3) -> DataFrame:
    """The final list: best first, equal contents once, at most ``per_source`` of a source.

    A row dropped for its source does not block its content for others, so this is a fold over the
    ranked rows; there are at most as many as the lanes hold.
    """
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), F.desc_nulls_last("modified_at"), "chunk_id")
    r = scored.withColumn("place", F.row_number().over(order)).withColumn("hash", F.md5("content"))
    rows = r.agg(F.sort_array(F.collect_list(F.struct("place", "chunk_id", "source_id", "hash"))).alias("all"))
    fits = lambda acc, x: ~F.exists(acc, lambda k: k["hash"] == x["hash"]) & (F.size(F.filter(acc, lambda k: k["source_id"] == x["source_id"])) < per_source) & (F.size(acc) < limit)
    kept = F.aggregate("all", F.slice("all", 1, 0), lambda acc, x: F.when(fits(acc, x), F.concat(acc, F.array(x))).otherwise(acc))
    chosen = rows.select(F.posexplode(kept).alias("pos", "k")).select((F.col("pos") + 1).alias("position"), F.col("k.chunk_id").alias("chunk_id"))
    return chosen.join(scored, "chunk_id")


def pack(ranked: DataFrame, budget: int = 12_000, most: int = 15, per_source: int = 4, per_section: int = 2) -> DataFrame:
    """Context for an answer: ranked rows while they fit the token budget; the first always does."""
    rows = ranked.agg(F.sort_array(F.collect_list(F.struct("position", "chunk_id", "source_id", "title", "token_count"))).alias("all"))
    tokens = lambda acc: F.aggregate(acc, F.lit(0), lambda s, k: s + k["token_count"])
    fits = lambda acc, x: (
        (F.size(F.filter(acc, lambda k: k["source_id"] == x["source_id"])) < per_source)
        & (F.size(F.filter(acc, lambda k: (k["source_id"] == x["source_id"]) & (k["title"] == x["title"]))) < per_section)
        & ((F.size(acc) == 0) | (tokens(acc) + x["token_count"] <= budget))
        & (F.size(acc) < most)
    )
    kept = F.aggregate("all", F.slice("all", 1, 0), lambda acc, x: F.when(fits(acc, x), F.concat(acc, F.array(x))).otherwise(acc))
    chosen = rows.select(F.posexplode(kept).alias("pos", "k")).select((F.col("pos") + 1).alias("context_position"), F.col("k.chunk_id").alias("chunk_id"))
    return chosen.join(ranked, "chunk_id")


def all_lanes(chunks: DataFrame, p: Plan) -> DataFrame:
    vector = vector_lane(chunks, query_vector(chunks, p))
    return exact_lane(chunks, p).unionByName(keyword_lane(chunks, p)).unionByName(vector).unionByName(trigram_lane(chunks, p))


# --- registered queries -------------------------------------------------------------------------
def eligible_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eligible chunks per provider and workspace."""
    e = eligible(spark, sf_dir)
    return e.groupBy("workspace_id", "provider").agg(F.count("*").alias("chunks"), F.sum("token_count").alias("tokens"))


def _shown(lane: DataFrame) -> DataFrame:
    return lane.select("chunk_id", "raw_score", "rank")


def lane_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best 50 by literal match."""
    return _shown(exact_lane(eligible(spark, sf_dir), plan(QUERY)))


def lane_keyword(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best 100 by cover density."""
    return _shown(keyword_lane(eligible(spark, sf_dir), plan(QUERY)))


def keyword_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All chunks that match a web query with a phrase, an alternative and a negation."""
    e = eligible(spark, sf_dir)
    return e.where(keyword_match(words(F.col("content")), '"loading dock" -forklift or "blood sample" symptom')).select("chunk_id")


def lane_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best 100 by cosine."""
    e = search_frame(spark, sf_dir)
    return _shown(vector_lane(e, query_vector(e, plan(QUERY))))


def lane_trigram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best 50 by title trigrams."""
    return _shown(trigram_lane(eligible(spark, sf_dir), plan(QUERY)))


def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fused scores of the exact, trigram and vector lanes."""
    e, p = search_frame(spark, sf_dir), plan(QUERY)
    lanes = exact_lane(e, p).unionByName(trigram_lane(e, p)).unionByName(vector_lane(e, query_vector(e, p)))
    return fuse(lanes).select("chunk_id", F.round("rrf", 6).alias("rrf"), "score")


def hybrid_exact_trigram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The final list from the exact and trigram lanes."""
    e, p = search_frame(spark, sf_dir), plan(QUERY)
    found = pick(fuse(exact_lane(e, p).unionByName(trigram_lane(e, p))))
    return found.select("position", "chunk_id", "score", X.snippet(F.col("content")).alias("snippet"))


def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The final list from all four lanes."""
    return pick(fuse(all_lanes(search_frame(spark, sf_dir), plan(QUERY)))).select("position", "chunk_id", "source_id", "score")


def context_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Context packed from the final list."""
    return pack(pick(fuse(all_lanes(search_frame(spark, sf_dir), plan(QUERY))))).select("context_position", "chunk_id", "token_count")


def answer_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extractive answer: five cited snippets, or the reason why there is none."""
    context = pack(pick(fuse(all_lanes(search_frame(spark, sf_dir), plan(QUERY))))).where("context_position <= 5")
    cited = F.concat(X.snippet(F.col("content")), F.lit(" [c"), F.col("context_position").cast("string"), F.lit("]"))
    parts = context.agg(F.sort_array(F.collect_list(F.struct("context_position", cited.alias("c"), "chunk_id"))).alias("p"))
    return parts.select(F.array_join(F.transform("p", lambda x: x["c"]), "\n\n").alias("answer"), F.transform("p", lambda x: x["chunk_id"]).alias("citations"), F.when(F.size("p") == 0, "no_authorized_results").alias("insufficient"))


def retrieval_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known-item search: how often and how high a chunk comes back for words taken from itself.

    Queries are all eligible chunks whose hashed id is divisible by 100, each by its three rarest words
    (keyword lane: matching words by rarity) and its first five words (exact lane: the phrase). All
    queries meet all chunks in one join over postings; the lanes are fused as those of a request.
    Copies of a chunk compete with it, so 1.0 is out of reach.
    """
    e = stage(eligible(spark, sf_dir).select("chunk_id", words(F.col("content")).alias("w")), "words")
    asked = e.where(F.conv(F.substring(F.md5("chunk_id"), 1, 8), 16, 10).cast("long") % 100 == 0)
    postings = e.select("chunk_id", F.explode(F.array_distinct("w")).alias("word")).where(F.length("word") >= 3)
    df = postings.groupBy("word").agg(F.count("*").alias("df"))
    rare = asked.select(F.col("chunk_id").alias("q"), F.explode(F.array_distinct("w")).alias("word")).where(F.length("word") >= 3).join(df, "word")
    rare = rare.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy("df", "word"))).where("n <= 3").select("q", "word", "df")
    score = rare.join(postings, "word").groupBy("q", "chunk_id").agg(F.round(F.sum(1 / F.col("df")), 9).alias("raw_score"))
    phrases = F.transform(F.sequence(F.lit(1), F.size("w") - 4), lambda i: F.array_join(F.slice("w", i, 5), " "))
    grams = e.where(F.size("w") >= 5).select("chunk_id", F.explode(F.array_distinct(phrases)).alias("phrase"))
    first = asked.where(F.size("w") >= 5).select(F.col("chunk_id").alias("q"), F.array_join(F.slice("w", 1, 5), " ").alias("phrase"))
    exact = first.join(grams, "phrase").select("q", "chunk_id", F.lit(0.6).alias("raw_score"))
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("raw_score"), "chunk_id"))
    lanes = [x.withColumn("rank", place).where(F.col("rank") <= SIZES[k]).select("q", "chunk_id", (F.lit(WEIGHTS[k]) / (RANK_CONSTANT + F.col("rank"))).alias("part")) for k, x in (("exact", exact), ("keyword", score))]
    fused = lanes[0].unionByName(lanes[1]).groupBy("q", "chunk_id").agg(F.round(F.sum("part"), 9).alias("raw_score")).withColumn("place", place)
    hit = asked.select(F.col("chunk_id").alias("q")).join(fused.where("q = chunk_id").select("q", "place"), "q", "left")
    within = lambda k: F.round(F.avg(F.coalesce(F.col("place") <= k, F.lit(False)).cast("double")), 6)
    return hit.agg(F.count("*").alias("queries"), within(5).alias("recall_5"), within(10).alias("recall_10"), F.round(F.avg(F.coalesce(1 / F.col("place"), F.lit(0.0))), 6).alias("mrr"))


_E = """
e AS (SELECT c.*, n.provider, n.workspace_id, coalesce(array_to_string(list_filter(c.heading_path, lambda x: x IS NOT NULL), ' '), '') AS title FROM (
  SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY indexed_at DESC NULLS LAST, modified_at DESC NULLS LAST) AS rn FROM chunks) c
  JOIN connections n ON n.connection_id = c.connection_id AND n.status = 'active' WHERE rn = 1 AND content <> '')"""
_X = f"""
x AS (SELECT *, CASE WHEN lower(title) = '{QUERY}' THEN 1.0::DOUBLE WHEN contains(lower(title), '{QUERY}') THEN 0.8::DOUBLE ELSE 0.6::DOUBLE END AS raw_score
  FROM e WHERE contains(lower(title), '{QUERY}') OR contains(lower(content), '{QUERY}') ORDER BY raw_score DESC, chunk_id LIMIT 50)"""
_TRI = "list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"
_G = f"""
g0 AS (SELECT *, {_TRI.format('title')} AS a, {_TRI.format(f"'{QUERY}'")} AS b FROM e),
g AS (SELECT * EXCLUDE (a, b), round(len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))), 6) AS raw_score FROM g0
  WHERE len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) >= 0.15 ORDER BY raw_score DESC, chunk_id LIMIT 50)"""
_P = "len(embedding) = 64 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AND len(list_filter(embedding, lambda x: isnan(x))) = 0"
_V = f"""
b AS (SELECT embedding FROM e WHERE {_P} AND (contains(lower(title), '{QUERY}') OR contains(lower(content), '{QUERY}'))
  ORDER BY CASE WHEN lower(title) = '{QUERY}' THEN 1.0 WHEN contains(lower(title), '{QUERY}') THEN 0.8 ELSE 0.6 END DESC, chunk_id LIMIT 10),
q AS (SELECT list(m ORDER BY i) AS qv FROM (SELECT i, avg(v) AS m FROM (SELECT unnest(embedding::DOUBLE[]) AS v, unnest(range(64)) AS i FROM b) GROUP BY i)),
v AS (SELECT e.*, round(greatest(list_cosine_similarity(embedding::DOUBLE[], qv), 0), 6) AS raw_score FROM e, q WHERE {_P} AND list_cosine_similarity(embedding::DOUBLE[], qv) >= 0.1 ORDER BY raw_score DESC, chunk_id LIMIT 100)"""
_RANKED = "SELECT chunk_id, raw_score, CAST(row_number() OVER (ORDER BY raw_score DESC, chunk_id) AS INTEGER) AS rank FROM "


def _fused(lanes: dict[str, str]) -> str:
    union = " UNION ALL ".join(f"SELECT '{k}' AS lane, chunk_id, source_id, content, modified_at, raw_score, row_number() OVER (ORDER BY raw_score DESC, chunk_id) AS rank, {WEIGHTS[k]}::DOUBLE AS weight FROM {t}" for k, t in lanes.items())
    value = " + ".join([f"{QUALITY}", *(f"coalesce(s_{k}, 0) * {FEATURES[k]}" for k in lanes)])
    share = " + ".join([f"{QUALITY}", *(f"CASE WHEN s_{k} IS NOT NULL THEN {FEATURES[k]} ELSE 0 END" for k in lanes)])
    signals = ", ".join(f"max(CASE WHEN lane = '{k}' THEN signal END) AS s_{k}" for k in lanes)
    return f"""
u AS ({union}),
m AS (SELECT *, raw_score / (CASE WHEN max(raw_score) OVER (PARTITION BY lane) > 0 THEN max(raw_score) OVER (PARTITION BY lane) ELSE 1 END) AS signal FROM u),
f AS (SELECT chunk_id, any_value(source_id) AS source_id, any_value(content) AS content, any_value(modified_at) AS modified_at, sum(weight::DOUBLE / (60 + rank)) AS rrf, {signals} FROM m GROUP BY chunk_id),
s AS (SELECT *, round(least(1, greatest(0, 0.25 * rrf / max(rrf) OVER () + 0.75 * ({value})::DOUBLE / ({share}))), 6) AS score FROM f)"""


_WORDS = "regexp_extract_all(lower(content), '[\\p{L}\\p{N}]+')"
ORACLES = {
    "eligible_chunks": f"WITH {_E} SELECT workspace_id, provider, count(*) AS chunks, CAST(sum(token_count) AS BIGINT) AS tokens FROM e GROUP BY 1, 2",
    "lane_exact": f"WITH {_E}, {_X} {_RANKED} x",
    "lane_trigram": f"WITH {_E}, {_G} {_RANKED} g",
    "lane_vector": f"WITH {_E}, {_V} {_RANKED} v",
    "keyword_matches": f"""WITH {_E}, w AS (SELECT chunk_id, {_WORDS} AS w FROM e)
SELECT chunk_id FROM w WHERE (contains(' ' || coalesce(array_to_string(w, ' '), '') || ' ', ' loading dock ') AND NOT list_contains(w, 'forklift')) OR (contains(' ' || coalesce(array_to_string(w, ' '), '') || ' ', ' blood sample ') AND list_contains(w, 'symptom'))""",
    "rrf_fusion": f"WITH {_E}, {_X}, {_G}, {_V}, {_fused({'exact': 'x', 'trigram': 'g', 'vector': 'v'})} SELECT chunk_id, round(rrf, 6) AS rrf, score FROM s",
    "hybrid_exact_trigram": f"""WITH RECURSIVE {_E}, {_X}, {_G}, {_fused({'exact': 'x', 'trigram': 'g'})},
r AS (SELECT *, md5(content) AS h, row_number() OVER (ORDER BY score DESC, modified_at DESC NULLS LAST, chunk_id) AS place FROM s),
k AS (
  SELECT 0::BIGINT AS place, []::VARCHAR[] AS hs, []::VARCHAR[] AS ss, []::VARCHAR[] AS ids
  UNION ALL
  SELECT place, CASE WHEN ok THEN list_append(hs, h) ELSE hs END, CASE WHEN ok THEN list_append(ss, source_id) ELSE ss END, CASE WHEN ok THEN list_append(ids, chunk_id) ELSE ids END
  FROM (SELECT r.place, k.hs, k.ss, k.ids, r.h, r.source_id, r.chunk_id, NOT list_contains(k.hs, r.h) AND len(list_filter(k.ss, lambda x: x = r.source_id)) < 3 AND len(k.ids) < 20 AS ok FROM k JOIN r ON r.place = k.place + 1)),
last AS (SELECT ids FROM k ORDER BY place DESC LIMIT 1),
picked AS (SELECT unnest(ids) AS chunk_id, CAST(unnest(range(1, len(ids) + 1)) AS INTEGER) AS position FROM last),
t AS (SELECT picked.position, picked.chunk_id, r.score, trim(regexp_replace(r.content, '\\s+', ' ', 'g')) AS t FROM picked JOIN r ON r.chunk_id = picked.chunk_id)
SELECT position, chunk_id, score, CASE WHEN length(t) > 500 THEN rtrim(substr(t, 1, 499)) || '…' ELSE t END AS snippet FROM t""",
    "retrieval_recall": f"""WITH {_E}, t AS (SELECT chunk_id, {_WORDS} AS w FROM e),
a AS (SELECT *, chunk_id AS q FROM t WHERE CAST('0x' || substr(md5(chunk_id), 1, 8) AS BIGINT) % 100 = 0),
p AS (SELECT DISTINCT chunk_id, word FROM (SELECT chunk_id, unnest(w) AS word FROM t) WHERE length(word) >= 3),
d AS (SELECT word, count(*) AS df FROM p GROUP BY 1),
r AS (SELECT * FROM (SELECT a.q, d.word, d.df, row_number() OVER (PARTITION BY a.q ORDER BY d.df, d.word) AS n FROM a JOIN p ON p.chunk_id = a.q JOIN d ON d.word = p.word) WHERE n <= 3),
k AS (SELECT r.q, p.chunk_id, round(sum(1.0::DOUBLE / r.df), 9) AS score FROM r JOIN p ON p.word = r.word GROUP BY 1, 2),
g AS (SELECT DISTINCT chunk_id, array_to_string(w[i:i + 4], ' ') AS phrase FROM (SELECT chunk_id, w, unnest(range(1, len(w) - 3)) AS i FROM t WHERE len(w) >= 5)),
x AS (SELECT a.q, g.chunk_id, 0.6 AS score FROM a JOIN g ON len(a.w) >= 5 AND g.phrase = array_to_string(a.w[1:5], ' ')),
l AS (
  SELECT q, chunk_id, 1.5::DOUBLE / (60 + rank) AS part FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, chunk_id) AS rank FROM x) WHERE rank <= 50
  UNION ALL SELECT q, chunk_id, 1.25::DOUBLE / (60 + rank) FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, chunk_id) AS rank FROM k) WHERE rank <= 100),
f AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s DESC, chunk_id) AS place FROM (SELECT q, chunk_id, round(sum(part), 9) AS s FROM l GROUP BY 1, 2))
SELECT count(*) AS queries, round(avg(CASE WHEN place <= 5 THEN 1.0 ELSE 0.0 END), 6) AS recall_5, round(avg(CASE WHEN place <= 10 THEN 1.0 ELSE 0.0 END), 6) AS recall_10, round(avg(coalesce(1.0 / place, 0.0)), 6) AS mrr
FROM a LEFT JOIN f ON f.q = a.q AND f.chunk_id = a.q""",
}
QUERIES = {f.__name__: f for f in (eligible_chunks, lane_exact, lane_keyword, keyword_matches, lane_vector, lane_trigram, rrf_fusion, hybrid_exact_trigram, hybrid_search, context_pack, answer_extract, retrieval_recall)}
