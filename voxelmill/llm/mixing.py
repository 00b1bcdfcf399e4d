"""Mixing sources to target weights.

Every source is permuted by a hash and cut into blocks of equal token size.
From the target weights follows how many blocks each source gives, whole
passes over a source counting as repeats. A splitting tree then deals these
quotas to the output shards: a node draws, from the multivariate
hypergeometric distribution, what of its counts goes to its left half, down to
single shards, so every quota is met exactly and every shard looks as if drawn
from the whole. The driver draws the top of the tree, tasks grow the branches.
Shards take disjoint runs of permuted blocks and are shuffled locally.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from voxelmill.functions.keys import tidy
from voxelmill.llm.bpe import VOCABULARY, encode_corpus
from voxelmill.storage import materialize

BUCKETS = 4096  # hash ranges of a source, summed before any ordering
#: Shards, unless they would hold more tokens than this.
SHARDS, SHARD_TOKENS = 8, 1 << 28
#: Tokens of a block, unless the mix would have more blocks than the draws can count (under 10^9).
BLOCK_TOKENS, BLOCKS = 4096, 1 << 29
#: Nodes of the splitting tree that the driver draws; each then grows its own branch in a task.
BRANCHES = 256


def split_node(low: int, high: int, counts: np.ndarray, seed: int) -> tuple[int, np.ndarray]:
    """The middle of shards low..high and the blocks of each source that go to its left half. The draw depends on nothing but the node and the seed."""
    middle = (low + high) // 2
    take = int(counts.sum()) * (middle - low) // (high - low)
    rng = np.random.default_rng((seed, low, high))
    return middle, rng.multivariate_hypergeometric(counts, take, method="marginals") if counts.sum() else counts


def grow(nodes: list[tuple[int, int, np.ndarray, np.ndarray]], seed: int, most: int | None = None) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """Splits nodes (low, high, first block of each source, blocks of each source) down to single shards, or until there are ``most``."""
    done: list[tuple] = []
    todo = list(nodes)
    while todo and (most is None or len(done) + len(todo) < most):
        low, high, first, counts = todo.pop(0 if most else -1)
        if high - low == 1:
            done.append((low, high, first, counts))
            continue
        middle, left = split_node(low, high, counts, seed)
        todo += [(low, middle, first, left), (middle, high, first + left, counts - left)]
    return done + todo


def split_counts(counts: np.ndarray, shards: int, seed: int = 0) -> np.ndarray:
    """Blocks of each source for each shard: rows are shards, columns sources. Columns sum to ``counts``, rows differ by at most a block a level."""
    counts = np.asarray(counts, np.int64)
    out = np.zeros((shards, len(counts)), np.int64)
    for low, _, _, own in grow([(0, shards, np.zeros_like(counts), counts)], seed):
        out[low] = own
    return out


def shard_runs(spark: SparkSession, counts: np.ndarray, shards: int, seed: int) -> DataFrame:
    """``k, shard, low, high``: the run of blocks of source k that a shard takes, none where it is empty. Runs of a source are disjoint and leave nothing out."""
    top = grow([(0, shards, np.zeros_like(counts), counts)], seed, BRANCHES)
    rows = [(int(low), int(high), first.tolist(), own.tolist()) for low, high, first, own in top]
    branches = spark.createDataFrame(rows, "a int, b int, first array<long>, own array<long>").repartition(max(1, min(len(rows), spark.sparkContext.defaultParallelism)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                for low, _, first, own in grow([(r["a"], r["b"], np.array(r["first"], np.int64), np.array(r["own"], np.int64))], seed):
                    k = np.flatnonzero(own)
                    yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(np.full(len(k), low), pa.int32()), pa.array(first[k]), pa.array(first[k] + own[k])], names=["k", "shard", "low", "high"])

    return branches.mapInArrow(run, "k int, shard int, low long, high long")


def plan_sizes(tokens: dict[str, int], targets: dict[str, tuple[float, int]], total: float | None) -> dict[str, float]:
    """Tokens to take of each source. Weights count among the sources that have texts.

    Without a total, the mix is the largest in which no source falls short.
    With one, what a source can't give goes to the others by their weights.
    """
    able = {s: w for s, (w, r) in targets.items() if tokens.get(s, 0) > 0 and w > 0 and r > 0}
    if not able:
        return {}
    most = {s: tokens[s] * targets[s][1] for s in able}
    whole = sum(able.values())
    left = min(most[s] * whole / w for s, w in able.items()) if total is None else float(total)
    out: dict[str, float] = {}
    while able:
        scale = left / sum(able.values())
        short = [s for s, w in able.items() if most[s] < scale * w]
        for s in short or list(able):
            out[s] = min(scale * able.pop(s), most[s])
            left -= out[s]
    return out


def size_texts(df: DataFrame, item: str, text: str, source: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """``i, source, tokens, h``: every distinct text with tokens once, under its smallest id, with a place in the permutation of its source."""
    rows = df.select(F.col(item).alias("i"), F.col(text).alias("x"), tidy(F.col(source)).alias("source")).where("i IS NOT NULL AND x IS NOT NULL AND x <> '' AND source IS NOT NULL AND source <> ''")
    # a digest stands for the text in the shuffle that finds copies
    keyed = rows.select(F.struct("i", "source", F.md5("x").alias("m")).alias("key"), "x")
    sized = encode_corpus(keyed, "key", "x", vocabulary, count=True).where("tokens > 0")
    first = sized.groupBy("key.m").agg(F.min(F.struct("key.i", "key.source", "tokens")).alias("t"))
    return first.select("t.i", "t.source", "t.tokens", F.xxhash64("t.i", F.lit(17)).alias("h"))


def mix_sources(df: DataFrame, item: str, text: str, source: str, targets: DataFrame, target_source: str, weight: str, repeats: str, shards: int | None = None, block_tokens: int | None = None, total: float | str | None = "corpus", seed: int = 23, vocabulary: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """The mix (``shard, place, item, source, copy, tokens``) and its report (``source, target_share, available, wanted, taken, share, shortfall``).

    Source names count tidied (case, padding, ``_`` or space). Null and empty
    texts, and those without a source or of a source without a target, aren't
    used. A text that stands several times is one text, of the source of its
    smallest id. Each is used at most ``repeats`` times; a repeat starts only
    when its source has been passed over whole. Null or non-positive weights
    or repeats give nothing. ``total`` is a number of tokens, ``"corpus"`` for
    as many as the sources have, or None for the largest mix in which every
    source has its share. What a source can't give goes to the others by their
    weights, and shortfall tells by how much its share misses the target, 0
    where it doesn't. Sources without texts are reported with share 0.

    The driver holds a row a source, never a row a shard or text.
    """
    spark = df.sparkSession
    own = targets.select(tidy(F.col(target_source)).alias("s"), F.col(weight).cast("double").alias("w"), F.col(repeats).cast("int").alias("r")).where("s IS NOT NULL AND w > 0 AND NOT isnan(w) AND r > 0")
    wanted = {r["s"]: (r["w"], r["r"]) for r in own.collect()}
    names = sorted(wanted)
    kind = dict(df.dtypes)[item]
    codes = spark.createDataFrame([(s, k) for k, s in enumerate(names)], "source string, k int")
    sized = materialize(size_texts(df, item, text, source, vocabulary).join(codes, "source").select("k", "i", "tokens", "h", F.pmod(F.shiftright("h", 20), F.lit(BUCKETS)).cast("int").alias("bucket")), "sized")
    # token sums of hash ranges, at most sources times BUCKETS rows, give where each range starts in its source
    sums = materialize(sized.groupBy("k", "bucket").agg(F.sum("tokens").alias("n")), "sums")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("k").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sums.select("k", "bucket", before.alias("start"))
    tokens = {names[r["k"]]: r["n"] for r in sums.groupBy("k").agg(F.sum("n").alias("n")).collect()}
    sizes = plan_sizes(tokens, wanted, sum(tokens.values()) if total == "corpus" else total)
    shards = shards or max(SHARDS, int(np.ceil(sum(sizes.values()) / SHARD_TOKENS)))
    block_tokens = block_tokens or max(BLOCK_TOKENS, int(np.ceil(sum(sizes.values()) / BLOCKS)))
    counts = np.array([int(np.ceil(sizes.get(s, 0) / block_tokens)) for s in names], np.int64)
    able = sum(w for w, _ in wanted.values())
    facts = [(k, s, int(tokens.get(s, 0)), float(sizes.get(s, 0)), wanted[s][0], wanted[s][0] / able, max(1, int(counts[k]) // shards)) for k, s in enumerate(names)]
    facts_df = spark.createDataFrame(facts, "k int, source string, available long, wanted double, weight double, target double, step long")
    inside = F.coalesce(F.sum("tokens").over(Window.partitionBy("k", "bucket").orderBy("h", "i").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = sized.withColumn("inside", inside).join(starts, ["k", "bucket"]).select("k", "i", "tokens", (F.col("start") + F.col("inside")).alias("at"))
    # the c-th copy of a text lies c passes further on; it is used if its middle is within the wanted size
    room = F.col("wanted") - F.col("at") - F.col("tokens") / 2
    copies = at.join(facts_df, "k").where(room > 0).withColumn("copy", F.explode(F.sequence(F.lit(0), F.ceil(room / F.col("available")).cast("int") - 1)))
    # runs and blocks meet in ranges about as wide as a run, so a text meets the few runs of its range
    copies = copies.withColumn("block", F.floor((F.col("at") + F.col("copy") * F.col("available")) / block_tokens)).withColumn("range", F.floor(F.col("block") / F.col("step")))
    runs = shard_runs(spark, counts, shards, seed).join(facts_df.select("k", "step"), "k")
    runs = runs.select("k", "shard", "low", "high", F.explode(F.sequence(F.floor(F.col("low") / F.col("step")), F.floor((F.col("high") - 1) / F.col("step")))).alias("range"))
    placed = copies.join(runs, ["k", "range"]).where("block >= low AND block < high")
    place = F.row_number().over(Window.partitionBy("shard").orderBy(F.xxhash64("i", "copy", F.lit(seed)), "i", "copy"))
    mix = placed.select("shard", place.cast("int").alias("place"), F.col("i").cast(kind).alias(item), "source", F.col("copy").alias("copy"), "tokens")
    taken = copies.groupBy("k").agg(F.sum("tokens").alias("taken"))
    every = facts_df.join(taken, "k", "left").select("source", F.col("weight").alias("target_share"), "target", "available", F.round("wanted", 3).alias("wanted"), F.coalesce("taken", F.lit(0)).alias("taken"))
    whole = F.sum("taken").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))  # a row a source
    report = every.withColumn("share", F.when(whole > 0, F.col("taken") / whole).otherwise(0.0))
    return mix, report.select("source", "target_share", "available", "wanted", "taken", "share", F.greatest(F.col("target") - F.col("share"), F.lit(0.0)).alias("shortfall"))
