"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Targets.  Sources share a given part of all words by weight; a target stops at a number of passes over its source, and what is
over is shared again.  That is a water level: with the sources sorted by cap over weight, the level is the largest of the
levels that follow when all smaller caps are taken out.

Tape.  The documents of a source lie on a tape in an order drawn by hash; a target is a length of tape, which runs over the source as
often as needed.  The tape is cut into blocks of ``BLOCK_WORDS``, the last one shorter, so a source gives exactly its target.
Places on the tape are sums of sums: about as many buckets per source as a bucket has documents, whatever the size.

Tree.  All shards together hold every source's exact quota of blocks.  A node splits its shards into two halves and draws the left half's blocks of
every source from the node's, without replacement (multivariate hypergeometric); the right half gets the rest.  Nodes are
rows, so the tree grows in parallel; a draw depends on the seed and the node alone.  A leaf is a shard with its quota of
each source and the first number of its run; a keyed permutation of the source's blocks turns runs of numbers into
disjoint sets of blocks.  The documents of a shard are then shuffled within it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobmill.llm.common import mix, written
from jobmill.session import broadcast_if_small

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE, MOST_PASSES = 1.5, 2
BLOCK_WORDS, BLOCKS_PER_SHARD = 1 << 14, 64
SEED = 20_261
LEVELS_PER_ROUND = 6
_NUMPY_LIMIT = 10**9  # numpy draws from fewer than this many


# ------------------------------------------------------------------ targets


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: int = MOST_PASSES) -> DataFrame:
    """(source, s, n_rows, source_size, target, words): one row per source of ``sizes`` (source, size).

    Sources are numbered by code point, null last, and take the weights in turn.  One row per source goes through one task.
    """
    each = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("size").alias("source_size"))
    each = each.withColumn("s", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("s") % len(weights) + 1).cast("int"))
    each = each.withColumns({"weight": weight, "cap": (F.col("source_size") * most).cast("double")})
    everything = Window.partitionBy()
    before = Window.orderBy(F.col("cap") / F.col("weight"), "s").rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    level = left / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    each = each.withColumn("level", level).withColumn("level", F.max("level").over(everything))
    each = each.withColumn("target", F.least(F.col("cap"), F.greatest(F.col("level"), F.lit(0.0)) * F.col("weight")))
    return each.select("source", "s", "n_rows", "source_size", "target", F.least(F.round("target"), F.col("cap")).cast("long").alias("words"))


# ------------------------------------------------------------------ the tape


def on_tape(rows: DataFrame) -> DataFrame:
    """``rows`` (s, n_rows, key, doc_id, size, ...) with ``nth`` and ``start``: a document's number and first word on its source's tape."""
    buckets = F.ceil(F.sqrt(F.col("n_rows").cast("double"))).cast("long")
    rows = rows.withColumn("bucket", F.pmod("key", buckets))
    sums = rows.groupBy("s", "bucket").agg(F.sum("size").alias("w"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("s", "bucket", F.coalesce(F.sum("w").over(before), F.lit(0)).alias("words_before"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows_before"))
    within = Window.partitionBy("s", "bucket").orderBy("key", "doc_id", "size")
    placed = rows.withColumns({"nth": F.row_number().over(within), "start": F.coalesce(F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    return placed.join(sums, ["s", "bucket"]).withColumns({"nth": F.col("nth") + F.col("rows_before"), "start": F.col("start") + F.col("words_before")}).drop("rows_before", "words_before", "bucket", "key", "n_rows")


def cut_pieces(placed: DataFrame, block_words: int) -> DataFrame:
    """The pieces of documents that the tapes' used lengths hold: (..., pass, block, offset, length)."""
    passes = F.ceil(F.greatest(F.lit(0), F.col("words") - F.col("start")).cast("double") / F.col("source_size")).cast("int")
    once = placed.where("size > 0 AND words > start").withColumn("pass", F.explode(F.sequence(F.lit(0), passes - 1)))
    once = once.withColumn("begin", F.col("start") + F.col("pass") * F.col("source_size"))
    once = once.withColumn("end", F.least(F.col("begin") + F.col("size"), F.col("words")))
    block = lambda c: F.floor(c / F.lit(block_words)).cast("long")
    cut = once.withColumn("block", F.explode(F.sequence(block(F.col("begin")), block(F.col("end") - 1))))
    first = F.greatest(F.col("begin"), F.col("block") * block_words)
    last = F.least(F.col("end"), (F.col("block") + 1) * block_words)
    return cut.withColumns({"offset": first - F.col("begin"), "length": last - first}).drop("begin", "end")


# ------------------------------------------------------------------ the tree


def drawn(rng: np.random.Generator, good: int, bad: int, take: int) -> int:
    """A hypergeometric draw of any size, by inversion of the probabilities about the mode."""
    low, high = max(0, take - bad), min(take, good)
    if low == high:
        return low
    total = good + bad
    mode = min(max((take + 1) * (good + 1) // (total + 2), low), high)
    spread = np.sqrt(take * (good / total) * (bad / total)) + 1
    low, high = max(low, mode - int(40 * spread) - 40), min(high, mode + int(40 * spread) + 40)
    x = np.arange(low, high, dtype=np.float64)
    steps = np.log(good - x) + np.log(take - x) - np.log(x + 1) - np.log(bad - take + x + 1)
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    sums = np.cumsum(np.exp(logs - logs.max()))
    return low + int(np.searchsorted(sums, rng.random() * sums[-1], side="right"))


def split_quota(rng: np.random.Generator, quota: np.ndarray, take: int) -> np.ndarray:
    """How many blocks of every source are among ``take`` drawn without replacement; they sum to ``take`` exactly."""
    if quota.sum() < _NUMPY_LIMIT:
        return rng.multivariate_hypergeometric(quota, take, method="marginals")
    out, rest = np.zeros_like(quota), int(quota.sum())
    for i, q in enumerate(quota.tolist()):
        out[i] = drawn(rng, q, rest - q, take)
        rest, take = rest - q, take - int(out[i])
    return out


def permuted(numbers: np.ndarray, size: int, seed: int, source: int) -> np.ndarray:
    """A keyed permutation of range(size): four Feistel rounds, walked on until the number is in the range."""
    half = np.uint64(max(1, (max(size - 1, 1).bit_length() + 1) // 2))
    mask = np.uint64((1 << int(half)) - 1)
    keys = mix(np.arange(1, 5, dtype=np.uint64) + mix(np.array([seed ^ (source << 20)], np.uint64)))
    out = numbers.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        a, b = out[todo] >> half, out[todo] & mask
        for key in keys:
            a, b = b, a ^ (mix(b + key) & mask)
        out[todo] = a << half | b
        todo = todo[out[todo] >= np.uint64(size)]
    return out.astype(np.int64)


_NODES = "lo long, hi long, s array<long>, quota array<long>, first array<long>, size array<long>"


def _grower(total: int, per_shard: int, seed: int, levels: int):
    """Splits every node ``levels`` times, or down to single shards."""
    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ring = [(row["lo"], row["hi"], *(np.array(row[c], np.int64) for c in ("s", "quota", "first", "size")))]
                for _ in range(levels):
                    ahead = []
                    for lo, hi, s, quota, first, size in ring:
                        if hi - lo == 1:
                            ahead.append((lo, hi, s, quota, first, size))
                            continue
                        mid = (lo + hi) // 2
                        rng = np.random.Generator(np.random.Philox(key=[seed, int(mix(np.array([lo], np.uint64) ^ mix(np.array([hi], np.uint64)))[0])]))
                        left = split_quota(rng, quota, min(mid * per_shard, total) - lo * per_shard)
                        for a, b, part, begin in ((lo, mid, left, first), (mid, hi, quota - left, first + left)):
                            some = part > 0
                            ahead.append((a, b, s[some], part[some], begin[some], size[some]))
                    ring = ahead
                yield pa.RecordBatch.from_arrays([pa.array([n[i] for n in ring], pa.int64()) for i in range(2)] + [pa.array([n[i].tolist() for n in ring], pa.list_(pa.int64())) for i in range(2, 6)],
                                                 ["lo", "hi", "s", "quota", "first", "size"])
    return grow


def _drawer(seed: int):
    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                blocks = [permuted(np.arange(f, f + q), k, seed, s) for s, q, f, k in zip(row["s"], row["quota"], row["first"], row["size"], strict=True)]
                s = np.repeat(np.array(row["s"], np.int64), [len(b) for b in blocks])
                block = np.concatenate(blocks) if blocks else np.empty(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(s), pa.array(block), pa.array(np.full(len(s), row["lo"]))], ["s", "block", "shard"])
    return draw


def shard_blocks(targets: DataFrame, block_words: int = BLOCK_WORDS, per_shard: int = BLOCKS_PER_SHARD, seed: int = SEED) -> DataFrame:
    """(s, block, shard): every block of every source's target in one shard; each shard but the last holds ``per_shard``."""
    spark = targets.sparkSession
    quotas = targets.select("s", F.ceil(F.col("words").cast("double") / block_words).cast("long").alias("quota")).where("quota > 0")
    total = quotas.agg(F.sum("quota")).first()[0] or 0
    if not total:
        return spark.createDataFrame([], "s long, block long, shard long")
    shards = -(-total // per_shard)
    root = quotas.agg(F.sort_array(F.collect_list(F.struct(F.col("s").cast("long").alias("s"), "quota"))).alias("q"))  # one number per source
    nodes = root.select(F.lit(0).cast("long").alias("lo"), F.lit(shards).cast("long").alias("hi"), F.col("q.s").alias("s"), F.col("q.quota").alias("quota"),
                        F.transform("q.s", lambda _: F.lit(0).cast("long")).alias("first"), F.col("q.quota").alias("size"))
    depth = max(1, (shards - 1).bit_length())
    for done in range(0, depth, LEVELS_PER_ROUND):
        nodes = nodes.mapInArrow(_grower(total, per_shard, seed, min(LEVELS_PER_ROUND, depth - done)), _NODES).repartition("lo")
    return nodes.mapInArrow(_drawer(seed), "s long, block long, shard long")


# ------------------------------------------------------------------ the mix


def document_sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED) -> DataFrame:
    """(doc_id, source, size, key) of every row."""
    size = F.coalesce(F.regexp_count(docs[text_col], F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(docs[id_col].alias("doc_id"), docs[source_col].alias("source"), size.alias("size"), F.xxhash64(docs[id_col], docs[text_col], F.lit(seed)).alias("key"))


def placed_documents(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: int = MOST_PASSES, seed: int = SEED, **columns) -> tuple[DataFrame, DataFrame]:
    """All rows with their places on the tapes, and the sources' targets; both written, for both are used twice."""
    sizes = written(document_sizes(docs, seed=seed, **columns), "mix_sizes")
    targets = written(source_targets(sizes, weights, share, most).coalesce(1), "mix_targets")
    small = broadcast_if_small(targets.withColumnRenamed("source", "named"))
    rows = sizes.join(small, sizes["source"].eqNullSafe(small["named"])).drop("named")
    return written(on_tape(rows), "mix_places"), targets


def mixed_pieces(placed: DataFrame, targets: DataFrame, block_words: int = BLOCK_WORDS, per_shard: int = BLOCKS_PER_SHARD, seed: int = SEED) -> DataFrame:
    """The mix: pieces of documents with their shard and their place in it.

    (doc_id, source, s, nth, pass, offset, length, shard, place): ``offset`` and ``length`` count words of the document.
    """
    pieces = cut_pieces(placed, block_words).join(shard_blocks(targets, block_words, per_shard, seed), ["s", "block"])
    local = Window.partitionBy("shard").orderBy(F.xxhash64("shard", "s", "nth", "pass", "offset", F.lit(seed)), "s", "nth", "pass", "offset")
    return pieces.withColumn("place", F.row_number().over(local)).select("doc_id", "source", "s", "nth", "pass", "offset", "length", "shard", "place")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, taken, n_pieces, first_shard, first_place.

    A null text has no words; a null source is a source, the last one; null and repeated doc_ids are kept row by row; sources
    without words have target 0; an empty table gives no rows; other columns are ignored.  A document at the end of a source's
    target is cut, so ``taken`` sums to the target rounded to a word.
    """
    placed, targets = placed_documents(docs, **options)
    pieces = mixed_pieces(placed, targets)
    taken = pieces.groupBy("s", "nth").agg(F.sum("length").alias("taken"), F.count(F.lit(1)).alias("n_pieces"), F.min(F.struct("shard", "place")).alias("first"))
    return placed.join(taken, ["s", "nth"], "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.coalesce("n_pieces", F.lit(0)).cast("long").alias("n_pieces"),
        F.col("first.shard").alias("first_shard"), F.col("first.place").cast("long").alias("first_place"))


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
