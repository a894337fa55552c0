"""Nearest neighbours by cross-polytope hashing with multiprobe tables and exact reranking.

A table rotates a unit vector by three rounds of random signs and a fast Hadamard transform and files it under the
nearest signed axis (two axes in a row for large collections).  A query looks into the buckets that lie nearest to it
in every table.

The collection is dealt out once, by the ids of its vectors, over shards that a task holds in memory; the queries go to every shard.
A task files its shard's vectors in one table after the other and scores each bucket's candidates against its queries as matrix
products of vectors rounded to a byte a component.  It keeps the best of each query and passes on nothing but them, with their inner
products taken anew from the original vectors in double precision.  So what moves is each vector once and a few rows for each query
and shard, whatever the number of tables and probes.

Numbers of tables and probes are set from measured recall (``DEPTHS``).  Largest inner product is reduced to smallest angle by one more
component where norms differ.  Equal vectors are filed once
with their smallest ids, as many as a result can hold, so copies fill no bucket.  A bucket with many candidates or
queries is worked off in tiles of at most ``BLOCK`` of either, so no row is left out.  Queries that meet fewer partners
than a result holds are answered again from all rows, block by block.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from jobmill.llm.common import picked, release, utf8
from jobmill.session import checkpointed

NEIGHBOURS, EVERY = 20, 20
BLOCK = 2048
TWO_AXES = 500_000  # rows from which a bucket is named by two axes
#: Axes of a bucket: (tables, buckets looked up in each).  Share of true neighbours met on 500, 2,000 and 10,256 vectors of 64 components:
#: one axis 0.96, 0.97, 0.99; two axes 0.93, 0.98, 0.99.  It rises with the number of vectors, as their neighbours are nearer.
DEPTHS = {1: (8, 16), 2: (40, 144)}
AXES = 16  # best axes of a hash that probes combine
SPARE = 12  # more candidates than a result holds go to the exact scores, as the bytes are rounded
HELD = 1 << 20  # scored candidates that a task holds before it keeps the best of each query
SHARD, ASKED = 1 << 18, 1 << 16  # vectors and queries of a task, about
LEAST, TASKS = 4096, 8  # smaller collections are dealt out over the cores, by so many vectors at least and over so many tasks at most
DENSE = 256  # up to so many components a rotation is one matrix
CHUNK = 4096  # vectors that are hashed, or pairs that are scored exactly, at once
SEED = 20


class Hashes:
    """The pseudo-rotations of all tables for vectors of ``dim`` components (made from the seed alone)."""

    def __init__(self, dim: int, rows: int, seed: int = SEED, depth: int | None = None):
        self.dim, self.size = dim, 1 << max(1, math.ceil(math.log2(dim)))
        self.axes = 2 * self.size
        self.depth = depth or (2 if rows >= TWO_AXES else 1)
        self.tables, probes = DEPTHS[self.depth]
        self.probes = min(probes, self.axes ** self.depth)
        rng = np.random.default_rng(seed)
        self.signs = rng.choice([-1.0, 1.0], (self.tables, self.depth, 3, self.size))
        self.turns: dict[bytes, np.ndarray] = {}

    def rotate(self, x: np.ndarray, signs: np.ndarray) -> np.ndarray:
        if self.size > DENSE:
            return self.transform(x, signs)
        key = signs.tobytes()
        if key not in self.turns:
            self.turns[key] = self.transform(np.eye(self.dim), signs)
        return x @ self.turns[key]

    def transform(self, x: np.ndarray, signs: np.ndarray) -> np.ndarray:
        y = np.zeros((len(x), self.size))
        y[:, :self.dim] = x
        for s in signs:
            y = y * s
            half = 1
            while half < self.size:
                z = y.reshape(len(x), -1, 2, half)
                y = np.stack([z[:, :, 0] + z[:, :, 1], z[:, :, 0] - z[:, :, 1]], axis=2).reshape(len(x), self.size)
                half *= 2
            y /= math.sqrt(self.size)
        return y

    def buckets(self, x: np.ndarray, table: int) -> np.ndarray:
        """The bucket of each vector in one table."""
        out = np.zeros(len(x), np.int64)
        for signs in self.signs[table]:
            y = self.rotate(x, signs)
            axis = np.abs(y).argmax(axis=1)
            out = out * self.axes + 2 * axis + (y[np.arange(len(x)), axis] < 0)
        return out

    def probed(self, x: np.ndarray, table: int) -> np.ndarray:
        """For each vector the ``probes`` buckets of one table whose axes lie nearest to it."""
        out, loss = np.zeros((len(x), 1), np.int64), np.zeros((len(x), 1))
        for signs in self.signs[table]:
            y = self.rotate(x, signs)
            both = np.stack([y, -y], axis=2).reshape(len(x), -1)
            n = min(AXES, self.axes) if self.probes > AXES or self.depth == 1 else self.axes
            best = np.argpartition(-both, n - 1, axis=1)[:, :n] if n < self.axes else np.tile(np.arange(self.axes), (len(x), 1))
            far = (both.max(axis=1, keepdims=True) - np.take_along_axis(both, best, 1)) ** 2
            out = (out[:, :, None] * self.axes + best[:, None, :]).reshape(len(x), -1)
            loss = (loss[:, :, None] + far[:, None, :]).reshape(len(x), -1)
            if loss.shape[1] > self.probes:
                keep = np.argpartition(loss, self.probes - 1, axis=1)[:, :self.probes]
                out, loss = np.take_along_axis(out, keep, 1), np.take_along_axis(loss, keep, 1)
        return out


def matrix(column: pa.Array, dim: int, kind: str) -> np.ndarray:
    return utf8(column)[0].view(kind).reshape(-1, dim).astype("<f8")


def lifted(x: np.ndarray, longest: float, level: bool, query: bool) -> np.ndarray:
    """Unit vectors whose angles are ordered as the inner products; one more component unless all norms are level."""
    norms = np.linalg.norm(x, axis=1, keepdims=True)
    if level:
        return x / norms
    if query:
        return np.hstack([x / norms, np.zeros((len(x), 1))])
    return np.hstack([x / longest, np.sqrt(np.maximum(0, 1 - (norms / longest) ** 2))])


def _as_bytes(kind: str):
    """embedding array -> its components as bytes and its norm; null for vectors that take no part."""
    def run(batches):
        for batch in batches:
            column = batch.column("embedding")
            lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy().astype(np.int64)
            values = np.ascontiguousarray(column.flatten().cast(pa.float32() if kind == "<f4" else pa.float64()).to_numpy(zero_copy_only=False).astype(kind))  # null: NaN
            offsets, norm = np.concatenate([[0], np.cumsum(lengths)]), np.full(len(lengths), np.nan)
            some = np.flatnonzero(lengths)
            if len(some):
                plain = values.astype("<f8")
                finite = np.logical_and.reduceat(np.isfinite(plain), offsets[some]) & np.logical_or.reduceat(plain != 0, offsets[some])
                norm[some] = np.where(finite, np.sqrt(np.add.reduceat(plain * plain, offsets[some])), np.nan)
                lost = some[~finite]
            keep = np.zeros(len(lengths), bool)
            if len(some):
                keep[some] = True
                keep[lost] = False
            vec = pa.Array.from_buffers(pa.binary(), len(lengths), [pa.py_buffer(np.packbits(keep, bitorder="little")), pa.py_buffer((offsets * values.itemsize).astype(np.int32)), pa.py_buffer(values)])
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), vec, pa.array(norm)], ["vec_id", "vec", "norm"])
    return run


def classes_of(vectors: DataFrame, keep: int) -> DataFrame:
    """rep, vec, members: each distinct vector once with its ``keep`` smallest ids.

    The rank has a literal bound, so every task passes on at most ``keep`` rows of a vector, however many copies it has.
    """
    order = W.partitionBy("vec").orderBy("vec_id")
    few = vectors.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)
    return few.groupBy("vec").agg(F.min("vec_id").alias("rep"), F.array_sort(F.collect_list("vec_id")).alias("members"))


def rounded(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as signed bytes and the factor of each."""
    scale = np.abs(x).max(axis=1) / 127
    return np.rint(x / scale[:, None]).astype(np.int8), scale


def _kept(query: np.ndarray, rep: np.ndarray, score: np.ndarray, most: int) -> tuple[np.ndarray, ...]:
    """The ``most`` best candidates of each query, each once; queries and candidates are numbered from 0 on, below 2**32."""
    key = query.astype(np.uint64) << np.uint64(32) | rep.astype(np.uint64)
    order = np.argsort(key)
    key, score = key[order], score[order]
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
    query, rep, score = query[order[starts]], rep[order[starts]], np.maximum.reduceat(score, starts) if len(key) else score
    bits = (score.astype(np.float32) + np.float32(0)).view(np.int32)
    falls = np.where(bits < 0, bits.view(np.uint32), np.uint32(0x7FFFFFFF) - bits.view(np.uint32))  # larger for smaller scores
    order = np.argsort(query.astype(np.uint64) << np.uint64(32) | falls, kind="stable")
    query = query[order]
    first = np.searchsorted(query, query, side="left")
    few = order[np.arange(len(query)) - first < most]
    return query[np.arange(len(query)) - first < most], rep[few], score[few]


class Best:
    """The ``most`` best candidates of each query so far, and the score that others must reach.

    The sums of a matrix product depend a little on its shape; ``slack`` is what they can differ by for a query.
    """

    def __init__(self, slack: np.ndarray, most: int):
        self.most, self.slack, self.least = most, slack, np.full(len(slack), -np.inf, np.float32)
        self.found: list[tuple] = []
        self.n, self.had = 0, 0

    def add(self, query: np.ndarray, rep: np.ndarray, score: np.ndarray) -> None:
        self.found.append((query, rep, score))
        self.n += len(query)
        if self.n > self.had + HELD:
            self.settle()

    def settle(self) -> tuple[np.ndarray, ...]:
        parts = []
        for found in self.found:
            good = found[2] >= self.least[found[0]]
            parts.append(tuple(c[good] for c in found))
        none = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32))
        kept = _kept(*(np.concatenate(c) for c in zip(none, *parts, strict=True)), self.most)
        count = np.bincount(kept[0], minlength=len(self.least))
        full = np.flatnonzero(count == self.most)
        self.least[full] = np.maximum(self.least[full], kept[2][np.cumsum(count)[full] - 1] - self.slack[full])
        self.found, self.n, self.had = [kept], len(kept[0]), len(kept[0])
        return kept


def _runs(names: np.ndarray) -> tuple[np.ndarray, ...]:
    """Order that brings equal names together, the names, and where the run of each starts and stops."""
    order = np.argsort(names, kind="stable")
    held = names[order]
    starts = np.flatnonzero(np.concatenate([[True], held[1:] != held[:-1]])) if len(held) else np.empty(0, np.int64)
    return order, held[starts], starts, np.append(starts[1:], len(held))


def _shared(asked: tuple, held: tuple):
    """Starts and stops of the runs of names that both have."""
    _, i, j = np.intersect1d(asked[1], held[1], assume_unique=True, return_indices=True)
    return zip(asked[2][i].tolist(), asked[3][i].tolist(), held[2][j].tolist(), held[3][j].tolist(), strict=True)


def _first_bound(asked: np.ndarray, pairs: tuple, code: np.ndarray, held: tuple, probes: int, most: int) -> np.ndarray:
    """A score that ``most`` candidates of a query reach in one table at least: the ``most``-th of the best scores of its buckets, each bucket cut in parts."""
    parts = -(-2 * most // probes)
    high, sorted_code = np.full((len(asked) * probes, parts), -np.inf, np.float32), code[held[0]]
    for a, z, start, stop in _shared(pairs, held):
        edges = np.linspace(start, stop, parts + 1).astype(int).tolist()
        for at in range(a, z, BLOCK):
            which = pairs[0][at:min(at + BLOCK, z)]
            q = asked.take(which // probes, axis=0)
            for part, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False)):
                for c in range(lo, hi, BLOCK):
                    high[which, part] = np.maximum(high[which, part], (q @ sorted_code[c:min(c + BLOCK, hi)].T).max(axis=1))
    high = high.reshape(len(asked), -1)
    return np.partition(high, -most, axis=1)[:, -most]


def _scored(asked: np.ndarray, owner: np.ndarray, code: np.ndarray, rep: np.ndarray, probed, filed, hashes: Hashes, most: int) -> tuple[np.ndarray, ...]:
    """The best candidates of each query among those that share a probed bucket with it in any table.

    ``probed`` and ``filed`` give the buckets of all queries and of all candidates in a table; ``owner`` and ``rep`` number their ids.
    """
    probes, far = hashes.probes, np.linalg.norm(code, axis=1).max() * np.linalg.norm(asked, axis=1) * code.shape[1] * np.finfo(np.float32).eps
    slack = np.zeros(int(owner.max()) + 1, np.float32)
    np.maximum.at(slack, owner, far)
    best = Best(slack, most)
    for table in range(hashes.tables):
        names, pairs = filed(table), _runs(probed(table).ravel())
        if table == 0:
            alone = np.flatnonzero(np.bincount(rep)[rep] == 1)  # a bound counts every id once
            np.maximum.at(best.least, owner, _first_bound(asked, pairs, code[alone], _runs(names[alone]), probes, most) - far)
        held = _runs(names)
        sorted_code, sorted_rep, q_of = code[held[0]], rep[held[0]], (pairs[0] // probes).astype(np.int32)
        least, hits, n = best.least[owner[q_of]][:, None], [], 0
        for a, z, start, stop in _shared(pairs, held):
            for at in range(a, z, BLOCK):
                end = min(at + BLOCK, z)
                q, low = asked.take(q_of[at:end], axis=0), least[at:end]
                for c in range(start, stop, BLOCK):
                    score = np.dot(q, sorted_code[c:min(c + BLOCK, stop)].T)
                    hit = (score >= low).ravel().nonzero()[0]
                    if len(hit):
                        hits.append((hit, score.ravel()[hit], at, c, score.shape[1]))
                        n += len(hit)
                        if n > HELD:
                            best.add(*_hit(hits, owner, q_of, sorted_rep))
                            hits, n = [], 0
        if hits:
            best.add(*_hit(hits, owner, q_of, sorted_rep))
        if best.n > 1.25 * best.had:
            best.settle()
    return best.settle()


def _hit(hits: list[tuple], owner: np.ndarray, q_of: np.ndarray, rep: np.ndarray) -> tuple[np.ndarray, ...]:
    """Numbers of queries and candidates, and scores, from the places of scores in the tiles that begin at given pairs and candidates."""
    place, score = (np.concatenate([h[i] for h in hits]) for i in (0, 1))
    at, c, width = (np.repeat([h[i] for h in hits], [len(h[0]) for h in hits]) for i in (2, 3, 4))
    return owner[q_of[at + place // width]], rep[c + place % width], score


def _places(numbers: np.ndarray):
    """For numbers from 0 on, all of which occur: the pairs (place in a list, place in ``numbers``) of equal ones."""
    order, count = np.argsort(numbers, kind="stable"), np.bincount(numbers)
    first = np.cumsum(count) - count

    def found(wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        times = count[wanted]
        i = np.repeat(np.arange(len(wanted)), times)
        return i, order[first[wanted][i] + np.arange(len(i)) - np.repeat(np.cumsum(times) - times, times)]
    return found


def _searched(hashes: Hashes, shape: tuple, most: int):
    """Shards with queries -> query_id, rep, rough, score, members: the best candidates of each query, with exact scores of all their vectors."""
    dim, longest, level, kind = shape

    def coded(x: np.ndarray) -> np.ndarray:
        out = np.empty(x.shape, np.float32)
        for at in range(0, len(x), CHUNK):
            code, scale = rounded(x[at:at + CHUNK].astype("<f8"))
            out[at:at + CHUNK] = code * scale.astype(np.float32)[:, None]
        return out

    def named(x: np.ndarray, query: bool):
        small = np.min_scalar_type(hashes.axes ** hashes.depth - 1)
        look = hashes.probed if query else hashes.buckets
        return lambda table: np.concatenate([look(lifted(x[at:at + CHUNK].astype("<f8"), longest, level, query), table).astype(small) for at in range(0, len(x), CHUNK)])

    def answers(rows: pa.Table):
        asked = rows.column("is_query").to_numpy(zero_copy_only=False).astype(bool)
        if asked.all() or not asked.any():
            return
        vec, ids = utf8(rows.column("vec").combine_chunks())[0].view(kind).reshape(-1, dim), rows.column("id").to_numpy()
        queries, held, q_ids, h_ids = vec[asked], vec[~asked], ids[asked], ids[~asked]
        members = rows.column("members").combine_chunks().filter(pa.array(~asked))
        (names, owner), (reps, rep) = np.unique(q_ids, return_inverse=True), np.unique(h_ids, return_inverse=True)
        query, found, rough = _scored(coded(queries), owner, coded(held), rep, named(queries, True), named(held, False), hashes, most)
        rows_of, askers_of = _places(rep), _places(owner)
        for at in range(0, len(query), CHUNK):
            i, row = rows_of(found[at:at + CHUNK])
            j, asker = askers_of(query[at:at + CHUNK][i])
            i, row = at + i[j], row[j]
            for a in range(0, len(row), CHUNK):
                pick = slice(a, a + CHUNK)
                score = (queries[asker[pick]].astype("<f8") * held[row[pick]].astype("<f8")).sum(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(names[query[i[pick]]]), pa.array(reps[found[i[pick]]]), pa.array(rough[i[pick]].astype(np.float32)), pa.array(score), members.take(pa.array(row[pick]))],
                                                 ["query_id", "rep", "rough", "score", "members"])

    def run(batches):
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        rows = pa.Table.from_batches(batches)
        batches.clear()
        parts = rows.column("part").to_numpy()
        for part in np.unique(parts):
            yield from answers(rows.filter(pa.array(parts == part)) if (parts != part).any() else rows)
        del rows, parts
        release()
    return run


def _best(dim: int, kind: str, k: int):
    def run(key, table):
        query = table.column("is_query").to_numpy(zero_copy_only=False).astype(bool)
        queries, candidates = table.filter(pa.array(query)), table.filter(pa.array(~query))
        out_q, out_v, out_s = [], [], []
        if queries.num_rows and candidates.num_rows:
            q, c = (matrix(t.column("vec").combine_chunks(), dim, kind) for t in (queries, candidates))
            ids, members = queries.column("id").to_pylist(), candidates.column("members").to_pylist()
            reps = candidates.column("id").to_numpy()
            order = np.argsort(reps, kind="stable")
            c, reps, members = c[order], reps[order], [members[i] for i in order]
            rough = q @ c.T
            crowd = np.unique(np.concatenate([np.asarray(m, np.int64) for m in members]), return_counts=True)[1].max()  # vectors of one id
            top = min((k + 1) * int(crowd), len(c))
            best = np.argpartition(-rough, top - 1, axis=1)[:, :top] if top < len(c) else np.tile(np.arange(len(c)), (len(q), 1))
            for i, chosen in enumerate(best):
                chosen = np.sort(chosen)
                exact = (q[i][None, :] * c[chosen]).sum(axis=1)
                ranked = chosen[np.argsort(-exact, kind="stable")]
                score = dict(zip(chosen.tolist(), exact.tolist(), strict=True))
                left = [(-score[j], m) for j in ranked.tolist() for m in members[j] if m != ids[i]]
                left.sort()
                taken = {}
                for s, m in left:
                    taken.setdefault(m, s)
                    if len(taken) == k:
                        break
                for m, s in taken.items():
                    out_q.append(ids[i])
                    out_v.append(m)
                    out_s.append(-s)
        return pa.table([pa.array(out_q, pa.int64()), pa.array(out_v, pa.int64()), pa.array(out_s, pa.float64())], names=["query_id", "vec_id", "score"])
    return run


def _top(found: DataFrame, k: int) -> DataFrame:
    scored = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def from_all(queries: DataFrame, n_queries: int, classes: DataFrame, n_classes: int, dim: int, kind: str, k: int) -> DataFrame:
    """The best of all rows for (id, vec), in pairs of blocks of queries and of candidates."""
    nc, nq = (max(1, math.ceil(n / (BLOCK / 2))) for n in (n_classes, n_queries))
    block = lambda n: F.pmod(F.xxhash64("id", "vec"), F.lit(n)).cast("int")
    every_one = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = queries.select("id", "vec", F.array().cast("array<long>").alias("members"), F.lit(True).alias("is_query"), block(nq).alias("qi")).withColumn("ci", every_one(nc))
    held = classes.select(F.col("rep").alias("id"), "vec", "members", F.lit(False).alias("is_query")).withColumn("ci", block(nc)).withColumn("qi", every_one(nq))
    return asked.unionByName(held).groupBy("ci", "qi").applyInArrow(_best(dim, kind, k), "query_id long, vec_id long, score double")


def search(table: DataFrame, k: int = NEIGHBOURS, every: int = EVERY, id_col: str = "vec_id", vec_col: str = "embedding", seed: int = SEED, depth: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: up to ``k`` neighbours of every row whose id is divisible by ``every``.

    Vectors that are null, zero, of another length than most (of equally frequent lengths the longer), or hold null or
    non-finite components take no part; neither do rows without an id.  Rows that repeat an id and its vector count once;
    of rows that repeat an id with other vectors each is a candidate and the best score stands.  Equal scores are ordered
    by id.  A query whose buckets hold fewer than ``k`` partners is answered from all rows, so it has ``k`` or, in tables with
    fewer rows, all of them; an empty table gives no rows.  Ids are integers.
    """
    spark, most = table.sparkSession, k + SPARE
    rows = picked(table, vec_id=table[id_col].cast("long"), embedding=vec_col).where("vec_id IS NOT NULL")
    kind = "<f4" if isinstance(rows.schema["embedding"].dataType.elementType, FloatType) else "<f8"
    vectors = rows.mapInArrow(_as_bytes(kind), "vec_id long, vec binary, norm double").where("vec IS NOT NULL")
    numbers = [F.count(F.lit(1)).alias("rows"), F.count_distinct(F.xxhash64("vec")).alias("n"), F.max("norm").alias("longest"), F.min("norm").alias("shortest")]  # n sets sizes only
    usual = vectors.groupBy(F.length("vec").alias("bytes")).agg(*numbers).orderBy(F.desc("rows"), F.desc("bytes")).limit(1).collect()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not usual:
        return empty
    size, dim = usual[0], usual[0]["bytes"] // np.dtype(kind).itemsize
    vectors = vectors.where(F.length("vec") == size["bytes"]).select("vec_id", "vec")
    queries = checkpointed(vectors.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "vec"]).select(F.col("vec_id").alias("id"), "vec"))
    n_queries = queries.count()
    if not n_queries:
        return empty
    level = size["shortest"] > size["longest"] * (1 - 1e-6)
    shape, hashes = (dim, size["longest"], level, kind), Hashes(dim + (not level), size["n"], seed, depth)
    classes = classes_of(vectors, k + 1)

    asked = max(-(-n_queries // ASKED), min(2, -(-n_queries // LEAST)))
    shards = max(-(-size["n"] // SHARD), min(-(-min(TASKS, spark.sparkContext.defaultParallelism) // asked), -(-size["n"] // LEAST)))
    own = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every_one = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    sides = [classes.select(F.lit(False).alias("is_query"), F.col("rep").alias("id"), "vec", F.when(F.size("members") > 1, F.col("members")).alias("members"), own("rep", shards).alias("shard"), every_one(asked).alias("block")),
             queries.select(F.lit(True).alias("is_query"), "id", "vec", F.lit(None).cast("array<long>").alias("members"), own("id", asked).alias("block"), every_one(shards).alias("shard"))]
    dealt = sides[0].unionByName(sides[1]).select((F.col("shard") * asked + F.col("block")).alias("part"), "is_query", "id", "vec", "members").repartitionById(shards * asked, "part")
    met = dealt.mapInArrow(_searched(hashes, shape, most), "query_id long, rep long, rough float, score double, members array<long>")
    best = W.partitionBy("query_id").orderBy(F.desc("rough"), "rep")
    pairs = met.withColumn("nth", F.dense_rank().over(best)).where(F.col("nth") <= most)
    scores = pairs.select("query_id", F.explode(F.coalesce("members", F.array("rep"))).alias("vec_id"), "score").where(F.col("query_id") != F.col("vec_id"))
    result = checkpointed(_top(scores, k))

    def lacking(wanted: int) -> tuple[DataFrame, DataFrame]:
        answered = result.groupBy("query_id").agg(F.count(F.lit(1)).alias("met")).where(F.col("met") >= wanted).select("query_id")
        return answered, checkpointed(queries.join(answered, F.col("id") == F.col("query_id"), "left_anti"))

    answered, short = lacking(k)
    n_short = short.count()
    if not n_short:
        return result
    wanted = min(k, vectors.select("vec_id").distinct().limit(k + 1).count() - 1)
    if wanted < k:
        answered, short = lacking(wanted)
        n_short = short.count()
    if not n_short or wanted < 1:
        return result
    whole = result.join(answered, "query_id", "left_semi").select(*result.columns)
    return whole.unionByName(_top(from_all(short, n_short, classes, size["n"], dim, kind, k), k))


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
