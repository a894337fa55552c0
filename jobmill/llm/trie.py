"""The trie of conversation prefixes, as a node table addressed by minimal perfect hashes.

Spark orders the turns, rebuilds every conversation and chains a SHA-256 digest along it, so that a digest names a prefix.
Distinct digests are the nodes: members, smallest member and parent come from one grouping that combines before its shuffle.

Totals over subtrees are accumulated shard by shard.  A node's weight is the number of turns that its members have from
there on, which bounds the nodes below it.  Weights fall along every path, so the nodes of one level of weight (up to
``LIMIT``, up to ``LIMIT * STEP`` and so on) form subtrees with their upper levels cut off, and a shard holds whole ones.  The levels
are worked off from light to heavy; what hangs below a level reaches its parents as a sum.  Level 0 is nearly all nodes, in
subtrees of at most ``LIMIT``; a higher level has at most ``STEP`` nodes of one depth in a subtree.

Within a shard every digest gets a slot of its own by a minimal perfect hash; a digest found in a slot is compared in full, so
a foreign one is never taken for a node.  Counts stand in flat arrays by slot, and sums go through the parents' slots,
deepest nodes first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobmill.llm.common import conf_parts, mix, release, written
from jobmill.llm.repair import crc32_sql
from jobmill.session import broadcast_if_small, checkpointed

WORD = r"[^\x20\x09-\x0D]+"
ROOT = bytes(32)
LIMIT, STEP, MOST_LEVELS = 1 << 17, 1 << 10, 5
NODES_PER_TASK = 250_000
CHUNK = 4096
MOST_HEADS = 3


class SlotTable:
    """A minimal perfect hash of distinct 32-byte digests, with the digests in their slots.

    In every round the digests left over are hashed into twice as many places; those alone in their place keep it, and their
    slot is the number of kept places before it.  The others go on to the next round.
    """

    def __init__(self, keys: np.ndarray) -> None:
        self.rounds, base, left = [], 0, np.arange(len(keys))
        self.stored, self.slots = np.empty_like(keys), np.empty(len(keys), np.int64)
        while len(left):
            size = max(64, 2 * len(left))
            place = self._place(keys[left], len(self.rounds), size)
            alone = np.bincount(place, minlength=size) == 1
            rank = base - 1 + np.cumsum(alone)
            done = alone[place]
            self.slots[left[done]] = rank[place[done]]
            self.rounds.append((size, alone, rank))
            base, left = base + int(done.sum()), left[~done]
            if len(self.rounds) > 200:
                raise ValueError("a digest is there twice")
        self.stored[self.slots] = keys

    @staticmethod
    def _place(keys: np.ndarray, number: int, size: int) -> np.ndarray:
        salt = np.uint64((number + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        return (mix(keys[:, number % 4] ^ salt) % np.uint64(size)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The slots of digests, -1 for those that are not in the table."""
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for number, (size, alone, rank) in enumerate(self.rounds):
            place = self._place(keys[left], number, size)
            hit = alone[place]
            slot = rank[place[hit]]
            same = (self.stored[slot] == keys[left[hit]]).all(axis=1)
            out[left[hit][same]] = slot[same]
            left = left[~hit]
        return out


def _digests(column: pa.Array) -> np.ndarray:
    """A binary column of 32-byte values as rows of four 64-bit words."""
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, np.uint64).reshape(-1, 4)


# ------------------------------------------------------------------ rebuilt conversations


def turn_rows(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, digest, words): texts are hashed where they are read and never moved."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    return conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), digest.alias("digest"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))


def _shared(conv: Column) -> Column:
    """How many turns a conversation takes over."""
    return (F.crc32(conv.cast("string").cast("binary")) % 4).cast("int")


def rebuilt(turns: DataFrame) -> DataFrame:
    """Sorted streams of conversations: a first row (place 0) with the turns taken over, then the conversation's own ones."""
    own = Window.partitionBy("conv_id")
    ordered = checkpointed(turns.withColumns({"place": F.row_number().over(own.orderBy(F.col("turn").asc_nulls_first(), "digest")), "n": F.count(F.lit(1)).over(own)}).drop("turn"))
    heads = ordered.where(F.col("place") <= MOST_HEADS).groupBy(F.col("conv_id").alias("origin")).agg(F.sort_array(F.collect_list(F.struct("place", "digest", "words"))).alias("heads"))
    shared = _shared(F.col("conv_id"))
    first = ordered.where("place = 1").withColumn("origin", F.col("conv_id") - F.col("conv_id") % 20).join(heads, "origin", "left")
    taken = F.slice(F.coalesce("heads", F.array().cast(heads.schema["heads"].dataType)), F.lit(1), shared)
    first = first.select("conv_id", F.lit(0).alias("place"), taken.alias("heads"), (F.size(taken) + F.greatest(F.col("n") - shared, F.lit(0))).cast("long").alias("total"),
                         F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("words"))
    rest = ordered.where(F.col("place") > shared).select("conv_id", "place", F.lit(None).cast(first.schema["heads"].dataType).alias("heads"), F.lit(None).cast("long").alias("total"), "digest", "words")
    return first.unionByName(rest).repartition("conv_id").sortWithinPartitions("conv_id", "place")


_CHAINED = "conv_id long, depth long, digest binary, parent binary, words long, below long"


def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for every prefix of every conversation, the empty one included; ``below`` counts its turns from there on."""
    chain, depth, total = ROOT, 0, 0
    for batch in batches:
        out: list[tuple] = []

        def add(conv, digest, words):
            nonlocal chain, depth
            parent, chain, depth = chain, hashlib.sha256(chain + digest).digest(), depth + 1
            out.append((conv, depth, chain, parent, words, total - depth + 1))

        columns = (batch.column(c).to_pylist() for c in ("conv_id", "place", "heads", "total", "digest", "words"))
        for conv, place, heads, whole, digest, words in zip(*columns, strict=True):
            if place == 0:
                chain, depth, total = ROOT, 0, whole
                out.append((conv, 0, ROOT, None, 0, total + 1))
                for head in heads:
                    add(conv, head["digest"], head["words"])
            else:
                add(conv, digest, words)
        if out:
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["conv_id", "depth", "digest", "parent", "words", "below"])


# ------------------------------------------------------------------ totals over subtrees


_NODE = ("conv_id", "depth", "n_convs", "own", "n_children", "n_leaves", "saved_tokens")
_TOTALS = "digest binary, parent binary, top boolean, conv_id long, depth long, n_convs long, n_children long, n_leaves long, saved_tokens long, parent_conv_id long"


def accumulated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums over the subtrees of a shard; ``top`` marks nodes whose parent is in another shard."""
    table = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
    if table is None or not table.num_rows:
        return
    table = table.combine_chunks()
    digests, parents = _digests(table["digest"]), _digests(pa.chunked_array([pa.array([p or b"\xff" * 32 for p in table["parent"].to_pylist()], pa.binary())]))
    slots = SlotTable(digests)
    at = slots.slots
    flat = {}
    for name in _NODE:
        flat[name] = np.empty(len(at), np.int64)
        flat[name][at] = table[name].to_numpy()
    parent = np.empty(len(at), np.int64)
    parent[at] = slots.find(parents)
    depth, children, leaves, saved = (flat[n] for n in ("depth", "n_children", "n_leaves", "saved_tokens"))
    saved += flat["own"]
    order = np.argsort(-depth, kind="stable")
    for nodes in np.split(order, np.flatnonzero(np.diff(depth[order])) + 1):
        leaves[nodes[children[nodes] == 0]] = 1
        inner = nodes[parent[nodes] >= 0]
        to = parent[inner]
        np.add.at(children, to, 1)
        np.add.at(leaves, to, leaves[inner])
        np.add.at(saved, to, saved[inner])
    top = parent < 0
    above = pa.array(np.where(top, 0, flat["conv_id"][parent]), mask=top)
    take = lambda values: pa.array(values[at])
    yield pa.RecordBatch.from_arrays([table["digest"].combine_chunks(), table["parent"].combine_chunks(), take(top), take(flat["conv_id"]), take(depth), take(flat["n_convs"]), take(children), take(leaves),
                                      take(saved), above.take(pa.array(at))],
                                     ["digest", "parent", "top", "conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "parent_conv_id"])
    release()


def _ends(prefixes: DataFrame) -> DataFrame:
    """(digest, ends_sha256) of nodes where conversations end: ids are joined in runs of ``CHUNK`` first, then hashed in a stream."""
    runs = prefixes.where("below = 1").groupBy("digest", F.floor(F.col("conv_id") / CHUNK).alias("run")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            done = []
            for digest, ids in zip(batch.column("digest").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if digest != node:
                    if state is not None:
                        done.append((node, state.hexdigest()))
                    node, state = digest, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in done], pa.binary()), pa.array([h for _, h in done], pa.string())], ["digest", "ends_sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([state.hexdigest()], pa.string())], ["digest", "ends_sha256"])

    return runs.repartition("digest").sortWithinPartitions("digest", "run").mapInArrow(hashed, "digest binary, ends_sha256 string")


def prefix_trie(conversations: DataFrame, limit: int = LIMIT, step: int = STEP, nodes_per_task: int = NODES_PER_TASK) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns are taken by turn (nulls first), then by the digest of role and text; null roles and texts count as empty.  Rows with a
    null conv_id belong to no conversation and are left out.  conv_id is an integer; repeated rows are turns of their own; an empty table
    gives no rows, not even the root; other columns are ignored.
    """
    prefixes = written(rebuilt(turn_rows(conversations)).mapInArrow(chained, _CHAINED), "trie_prefixes")
    level = sum(((F.sum("below") > limit * step**i).cast("int") for i in range(MOST_LEVELS)), F.lit(0))
    nodes = written(prefixes.groupBy("digest").agg(
        F.min("conv_id").alias("conv_id"), F.any_value("depth").alias("depth"), F.any_value("parent").alias("parent"), F.count(F.lit(1)).alias("n_convs"),
        ((F.count(F.lit(1)) - 1) * F.any_value("words")).alias("own"), level.alias("level")), "trie_nodes")
    heavy = nodes.where("level > 0").select("digest", "level", F.col("conv_id").alias("above"))
    heavy = broadcast_if_small(written(heavy, "trie_heavy"))
    shards = prefixes.join(heavy.drop("above"), "digest", "left").groupBy("conv_id", F.coalesce("level", F.lit(0)).alias("level")).agg(F.min_by("digest", "depth").alias("shard"))
    nodes = written(nodes.join(shards, ["conv_id", "level"]), "trie_sharded")
    sizes = {r["level"]: r["n"] for r in nodes.groupBy("level").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per level
    results: list[DataFrame] = []
    for at in sorted(sizes):
        part = nodes.where(F.col("level") == at)
        sums = None
        for result in results:
            hanging = result.where("top").select(F.col("parent").alias("digest"), "n_leaves", "saved_tokens")
            sums = hanging if sums is None else sums.unionByName(hanging)
        if sums is None:
            part = part.withColumns({c: F.lit(0).cast("long") for c in ("n_children", "n_leaves", "saved_tokens")})
        else:
            sums = sums.groupBy("digest").agg(F.count(F.lit(1)).alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
            part = part.join(sums, "digest", "left").fillna(0, ["n_children", "n_leaves", "saved_tokens"])
        tasks = max(1, min(conf_parts(nodes), -(-sizes[at] // 1000)), -(-sizes[at] // nodes_per_task))
        part = part.select("digest", "parent", *_NODE, "shard").repartition(tasks, "shard").drop("shard")
        results.append(written(part.mapInArrow(accumulated, _TOTALS), f"trie_level_{at}"))
    if not results:
        results = [conversations.sparkSession.createDataFrame([], _TOTALS)]
    whole = results[0]
    for result in results[1:]:
        whole = whole.unionByName(result)
    whole = whole.join(heavy.select(F.col("digest").alias("parent"), "above"), "parent", "left")
    whole = whole.join(_ends(prefixes), "digest", "left")
    return whole.select("conv_id", "depth", F.coalesce("parent_conv_id", "above").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
                        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


#: The same from the lists of turns themselves, without digests.
SQL = f"""WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (
    PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS i FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT c, list({{'role': role, 'text': text}} ORDER BY i) AS turns FROM t GROUP BY c),
h AS (SELECT l.c, {crc32_sql("cast(l.c AS varchar)")} % 4 AS h, l.turns, o.turns AS origin FROM l LEFT JOIN l o ON o.c = l.c - l.c % 20),
r AS (SELECT c, list_concat(coalesce(origin, [])[1:h], turns[h + 1:]) AS turns FROM h),
p AS (SELECT c, unnest(range(len(turns) + 1)) AS d, turns FROM r),
n AS (SELECT turns[1:d] AS k, d, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(CASE WHEN d > 0 THEN len(regexp_extract_all(turns[d].text, '[^\\x20\\x09-\\x0D]+')) ELSE 0 END) AS own,
  coalesce(string_agg(cast(c AS varchar), ',' ORDER BY c) FILTER (len(turns) = d), '') AS ends FROM p GROUP BY 1, 2),
m AS (SELECT n.*, a.conv_id AS parent_conv_id, (SELECT count(*) FROM n x WHERE x.d = n.d + 1 AND x.k[1:n.d] = n.k) AS n_children FROM n LEFT JOIN n a ON a.d = n.d - 1 AND a.k = n.k[1:n.d - 1]),
e AS (SELECT m.conv_id, m.d AS depth, m.parent_conv_id, m.n_convs, m.n_children, m.ends, m.own, m.k FROM m),
s AS (SELECT unnest(range(depth + 1)) AS top, k, n_children, own FROM e),
g AS (SELECT top, k[1:top] AS k, count(*) FILTER (n_children = 0) AS n_leaves, sum(own) AS saved_tokens FROM s GROUP BY 1, 2)
SELECT e.conv_id, e.depth, e.parent_conv_id, e.n_convs, e.n_children, g.n_leaves, cast(g.saved_tokens AS bigint) AS saved_tokens, sha256(e.ends) AS ends_sha256
FROM e JOIN g ON g.top = e.depth AND g.k = e.k"""
