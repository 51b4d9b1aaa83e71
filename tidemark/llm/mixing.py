"""Mixing sources to target weights with a low-discrepancy schedule.

Sizes are tokens of a public tokenizer. Each source may give each document at most
``max_repeats`` times. Its quota is its share of the wanted total; a source that cannot fill its
quota even with all repeats gives all it has, and what is missing goes to the other sources in
proportion to their shares. In a source's last pass a document too long for what is left is skipped
for later ones that fit, so a share misses its target by at most half of the shortest document left
or by what no later document fits into. The shares really reached are reported.

The order of the mix comes from a schedule of equal-token slots: slot ``k`` is the point
``frac((k + 1) / golden ratio)`` mapped through the cumulative weights. The slots of one source
are ranked, its documents are put into a hashed order and cut into blocks of as many tokens, and
the n-th slot of a source takes its n-th block. Running sums are made in buckets (sum per bucket,
sum over buckets, sum inside the bucket), so no source has to fit into one task.

Defined results: null, empty and zero-token texts carry no tokens and are left out; sources
without a target, with a null or non-positive share or without documents take no part; a source
that occurs more than once among the targets has its shares added and its smallest repeat bound;
a null repeat bound counts as 1 and one below 1 as no part; repeated rows of one document key
count once; an empty table gives an empty mix. Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.tokenizing import token_counts
from tidemark.session import cut, stage, table

#: 1 / golden ratio as a fraction of 2**32 (fixed value): slots keep exact integer arithmetic.
GOLDEN = 2654435769


def running_sum(df: DataFrame, group: list[str], bucket: str, order: list[Column], value: Column, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over the earlier rows of the group (exclusive).

    ``bucket`` (not null) must follow ``order``; only one bucket of a group has to be sorted at once.
    """
    sums = df.groupBy(*group, bucket).agg(F.sum(value).alias("_in"))
    ahead = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(*group, bucket, F.coalesce(F.sum("_in").over(ahead), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.join(base, [*group, bucket]).withColumn(name, F.col("_base") + F.coalesce(F.sum(value).over(inside), F.lit(0))).drop("_base")


def quotas(supply: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """(source, target_share, max_repeats, docs, tokens, quota) of every targeted source.

    ``supply`` holds (source, docs, tokens). The rows are sources, not documents. In the order of
    how soon they run dry, a source is dry if it has less than its part of what the drier ones
    leave; all others stand at one common level. ``total_tokens`` defaults to the tokens of the
    targeted sources, each document once.
    """
    want = targets.select("source", "target_share", F.coalesce("max_repeats", F.lit(1)).alias("max_repeats")).where("source is not null and target_share > 0 and max_repeats >= 1").groupBy("source").agg(F.sum("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats"))
    q = want.join(supply, "source", "left").fillna(0, ["docs", "tokens"]).withColumn("room", F.col("tokens") * F.col("max_repeats")).withColumn("ratio", F.col("room") / F.col("target_share"))
    every = Window.partitionBy(F.lit(0))
    drier = every.orderBy("ratio", "source").rowsBetween(Window.unboundedPreceding, -1)
    total = F.lit(float(total_tokens)) if total_tokens is not None else F.sum("tokens").over(every).cast("double")
    total = F.least(total, F.sum("room").over(every).cast("double"))
    open_share = F.sum("target_share").over(every) - F.coalesce(F.sum("target_share").over(drier), F.lit(0.0))
    q = q.withColumn("level", (total - F.coalesce(F.sum("room").over(drier), F.lit(0))) / open_share).withColumn("dry", F.col("ratio") <= F.col("level"))
    common = F.min(F.when(~F.col("dry"), F.struct("ratio", "source", "level"))).over(every)["level"]
    q = q.withColumn("quota", F.when(F.col("dry"), F.col("room")).otherwise(F.round(F.col("target_share") * common).cast("long")))
    return q.drop("room", "ratio", "level", "dry")


def last_pass(docs: DataFrame) -> DataFrame:
    """(source, doc_id, copy, start, n_tokens): what each source gives after its ``full`` whole passes.

    Documents follow each other while they fit. What is left behind the first that does not goes to
    later ones, in order, and the shortest one not taken comes last if half of it fits.
    """
    shown = ["source", "doc_id", F.col("full").alias("copy"), "start", "n_tokens"]
    rest = docs.where("full < max_repeats").withColumn("open", F.col("quota") - F.col("full") * F.col("whole")).withColumn("fits", F.col("before") + F.col("n_tokens") <= F.col("open"))
    head = rest.where("fits").withColumn("start", F.col("full") * F.col("whole") + F.col("before")).select(*shown)
    gaps = rest.groupBy("source").agg((F.first("open") - F.coalesce(F.sum(F.when(F.col("fits"), F.col("n_tokens"))), F.lit(0))).alias("gap"))
    later = rest.where("NOT fits").drop("before").join(gaps, "source").where("n_tokens <= gap")
    later = running_sum(later, ["source"], "bucket", [F.col("h"), F.col("doc_id")], F.col("n_tokens"), "before").where("before + n_tokens <= gap")
    later = later.withColumn("start", F.col("quota") - F.col("gap") + F.col("before")).select(*shown)
    taken = stage(head.unionByName(later), "taken")
    used = taken.groupBy("source").agg(F.sum("n_tokens").alias("used"))
    left = rest.join(taken.select("doc_id"), "doc_id", "left_anti").groupBy("source").agg(F.min(F.struct("n_tokens", "h", "doc_id")).alias("d"), *[F.first(c).alias(c) for c in ("open", "quota", "full")])
    left = left.join(used, "source", "left").withColumn("gap", F.col("open") - F.coalesce("used", F.lit(0))).select("source", "d.*", "full", "gap", (F.col("quota") - F.col("gap")).alias("start"))
    return taken.unionByName(left.where("n_tokens / 2 <= gap").select(*shown))


def mix(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, block_tokens: int = 2048, seed: int = 7, bucket_tokens: int = 4_000_000) -> tuple[DataFrame, DataFrame]:
    """The mixed corpus and its report.

    Corpus: (slot, doc_id, copy, source, n_tokens); reading by (slot, copy, doc_id) gives the mix.
    Report: (source, target_share, max_repeats, docs, tokens, mixed_tokens, mixed_docs, most_uses, share).
    """
    sized = token_counts(documents, ["doc_id", "source"])
    sized = stage(sized.where("n_tokens > 0 and source is not null and doc_id is not null").groupBy("doc_id").agg(F.min(F.struct("source", "n_tokens")).alias("d")).select("doc_id", "d.*"), "sized")
    supply = sized.groupBy("source").agg(F.count("*").alias("docs"), F.sum("n_tokens").alias("tokens"))
    plan = cut(quotas(supply, targets, total_tokens))

    # documents of each source in hashed order, with the tokens before each of them
    docs = sized.join(plan.where("quota > 0").select("source", "quota", F.col("tokens").alias("whole"), "max_repeats"), "source")
    docs = docs.withColumn("h", F.xxhash64(F.lit(seed), "doc_id")).withColumn("buckets", F.greatest(F.lit(1), F.ceil(F.col("whole") / bucket_tokens)))
    docs = docs.withColumn("bucket", F.floor((F.shiftright("h", 32) + F.lit(1 << 31)) * F.col("buckets") / F.lit(1 << 32)))
    docs = running_sum(docs, ["source"], "bucket", [F.col("h"), F.col("doc_id")], F.col("n_tokens"), "before")
    docs = stage(docs.withColumn("full", F.least(F.col("max_repeats").cast("long"), F.floor(F.col("quota") / F.col("whole")))), "ordered")
    passes = docs.where("full > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("full") - 1)))
    copies = passes.select("source", "doc_id", "copy", (F.col("copy") * F.col("whole") + F.col("before")).alias("start"), "n_tokens").unionByName(last_pass(docs))
    blocks = copies.select("source", F.floor(F.col("start") / block_tokens).alias("rank"), "doc_id", F.col("copy").cast("int").alias("copy"), "n_tokens")

    # slots: golden-ratio points through the cumulative quotas, ranked per source. A point falls
    # into each interval in proportion to its width up to O(log n) slots, so a few slots more than
    # the quota let every block find its slot.
    spark = documents.sparkSession
    need = plan.where("quota > 0").select("source", "quota", F.ceil(F.col("quota") / block_tokens).alias("blocks"))
    ahead = Window.partitionBy(F.lit(0)).orderBy("source").rowsBetween(Window.unboundedPreceding, 0)
    edges = need.withColumn("upto", F.sum("quota").over(ahead)).withColumn("all", F.sum("quota").over(Window.partitionBy(F.lit(0))))
    edges = edges.select("source", "blocks", ((F.col("upto") - F.col("quota")) / F.col("all")).alias("lo"), (F.col("upto") / F.col("all")).alias("hi"))
    slots = need.agg(F.coalesce(F.sum("blocks"), F.lit(0)).alias("n")).first().n
    smallest = need.agg((F.min("quota") / F.sum("quota")).alias("x")).first().x or 1.0
    spare = int(slots * 1.02) + int(8 / max(smallest, 1e-6)) + 64
    points = spark.range(spare).withColumn("x", ((F.col("id") + 1) * GOLDEN % (1 << 32)) / float(1 << 32)).withColumn("bucket", F.floor(F.col("id") / 65536)) if slots else spark.range(0).withColumn("x", F.lit(0.0)).withColumn("bucket", F.lit(0).cast("long"))
    # one entry per source of the target table, looked up in each row instead of joined
    table_ = F.array(*[F.struct(F.lit(r.source).alias("source"), F.lit(r.blocks).alias("blocks"), F.lit(r.lo).alias("lo"), F.lit(r.hi).alias("hi")) for r in edges.collect()]) if slots else None
    if slots:
        hit = F.get(F.filter(table_, lambda e: (F.col("x") >= e["lo"]) & (F.col("x") < e["hi"])), F.lit(0))
        placed = points.withColumn("hit", hit).where("hit IS NOT NULL").select("hit.source", "hit.blocks", "bucket", F.col("id").alias("slot"))
    else:
        placed = points.select(F.lit("").alias("source"), F.lit(0).cast("long").alias("blocks"), "bucket", F.col("id").alias("slot"))
    ranked = running_sum(placed, ["source"], "bucket", [F.col("slot")], F.lit(1), "rank").where("rank < blocks").select("source", "rank", "slot")
    mixed = blocks.join(ranked, ["source", "rank"], "left")
    # a block that found no slot (possible for a tiny source) goes behind the last slot
    mixed = stage(mixed.select(F.coalesce("slot", F.lit(spare) + F.col("rank")).alias("slot"), "doc_id", "copy", "source", "n_tokens"), "mixed")

    uses = mixed.groupBy("source", "doc_id").agg(F.count("*").alias("uses"), F.sum("n_tokens").alias("t"))
    got = uses.groupBy("source").agg(F.sum("t").alias("mixed_tokens"), F.sum("uses").alias("mixed_docs"), F.max("uses").alias("most_uses"))
    report = plan.drop("quota").join(got, "source", "left").fillna(0, ["mixed_tokens", "mixed_docs", "most_uses"])
    report = report.withColumn("share", F.coalesce(F.col("mixed_tokens") / F.sum("mixed_tokens").over(Window.partitionBy(F.lit(0))), F.lit(0.0)))
    return mixed, report


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixed corpus: (slot, doc_id, copy, source, n_tokens)."""
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[0]


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and reached shares per source."""
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[1]
