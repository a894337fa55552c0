"""Self-join on the Jaccard similarity of word shingles: MinHash banding, then exact verification.

This is fixed banding in place of an LSH forest: every distinct shingle set gets ``TREES`` bands of ``prefix_length()`` minima (6), the
longest of up to ``DEEPEST`` at which a pair at the threshold meets in some band with the target recall; sets that are equal in a
band are candidates.  There are no sorted tries and no row's prefix is shortened by what it matched: one threshold is
asked for, every candidate is verified exactly, and shorter prefixes would only add candidates.  Candidates are
gathered into components, each set's shingles are fetched once per block of its component, and every pair of a
block pair is compared exactly, so links are counted without being written out as pairs.

Equal sets are one class before any comparison.  The smallest member of a prefix is combined in each task before the
shuffle; a component of more than ``BLOCK`` sets is dealt out as pairs of blocks; links and components stay in Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobmill.llm.common import GOLDEN, conf_parts, grown, mix, prefix_sums, release, runs, shrunk, slices, span_hash, utf8
from jobmill.llm.components import arrow_pairs, components, stars
from jobmill.llm.repeats import keyed
from jobmill.session import checkpointed

WORDS, THRESHOLD = 5, 0.8
TREES, DEEPEST, TARGET = 32, 8, 0.9999
BLOCK = 256
COLUMNS = 4096  # shingles multiplied at once
SEED = np.uint64(0x2545F4914F6CDD1D)
_WORD = np.array([48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def prefix_length(threshold: float = THRESHOLD, trees: int = TREES, deepest: int = DEEPEST, target: float = TARGET) -> int:
    """Shorten the prefix until pairs at the threshold meet in some tree with the target probability."""
    for length in range(deepest, 1, -1):
        if 1 - (1 - threshold ** length) ** trees >= target:
            return length
    return 1


def shingles(column: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the distinct shingles of each text, sorted; a text of fewer words has one shingle of them all."""
    data, offsets = utf8(column)
    data = _LOWER[data]
    upper = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)) + 1 if len(data) else np.empty(0, np.int64)
    data[upper] += 32
    starts, ends = runs(_WORD[data], offsets)
    hashes = span_hash(prefix_sums(data), starts, ends)
    n = np.diff(np.searchsorted(starts, offsets))
    first = np.cumsum(n) - n
    owner = np.repeat(np.arange(len(n)), n)
    whole = np.flatnonzero(np.arange(len(hashes)) - first[owner] + words <= n[owner])
    code = np.zeros(len(whole), np.uint64)
    for i in range(words):
        code = mix(code * GOLDEN + hashes[whole + i])
    owner = owner[whole]
    for i in np.flatnonzero((n > 0) & (n < words)):
        short = np.zeros(1, np.uint64)
        for h in hashes[first[i]:first[i] + n[i]]:
            short = mix(short * GOLDEN + h)
        code, owner = np.append(code, short), np.append(owner, i)
    order = np.lexsort((code, owner))
    code, owner = code[order], owner[order]
    new = np.ones(len(code), bool)
    new[1:] = (code[1:] != code[:-1]) | (owner[1:] != owner[:-1])
    return owner[new], code[new]


def _signer(words: int, trees: int, length: int):
    salts = mix((np.arange(trees * length, dtype=np.uint64) + np.uint64(1)) * SEED) | np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """doc, size, two fingerprints of the set, and the prefix of each tree."""
        for batch in batches:
            for part in slices(batch):
                owner, code = shingles(part.column("text"), words)
                size = np.bincount(owner, minlength=part.num_rows)
                has = np.flatnonzero(size)
                begin = (np.cumsum(size) - size)[has]
                prints = np.zeros((2, part.num_rows), np.int64)
                prefixes = np.zeros((part.num_rows, trees), np.uint64)
                if len(has):
                    for row, salt in zip(prints, (GOLDEN, SEED), strict=True):
                        row[has] = np.add.reduceat(mix(code ^ salt), begin).view(np.int64)
                    for i, salt in enumerate(salts):
                        least = np.minimum.reduceat((code * salt) >> np.uint64(16), begin)
                        prefixes[has, i // length] = mix(prefixes[has, i // length] * GOLDEN + least)
                flat = pa.array(prefixes.ravel().view(np.int64))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, trees * part.num_rows + 1, trees), pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([part.column("doc"), pa.array(size.astype(np.int64)), pa.array(prints[0]), pa.array(prints[1]), lists], ["doc", "size", "f1", "f2", "prefixes"])
        release()
    return run


def _local_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a batch of sets: (prefix, smallest set) per tree, and links of the others to it (prefix null)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        reps = batch.column("rep").to_numpy()
        prefixes = batch.column("prefixes").flatten().to_numpy().reshape(batch.num_rows, -1)
        linked = []
        for tree in range(prefixes.shape[1]):
            keys = mix(prefixes[:, tree].view(np.uint64) + np.uint64(tree)).view(np.int64)
            a, b, first = stars(reps, keys)
            linked.append(np.stack([a, b]))
            yield pa.RecordBatch.from_arrays([pa.array(keys[first]), pa.array(reps[first]), pa.nulls(len(first), pa.int64())], ["prefix", "a", "b"])
        a, b = np.unique(np.concatenate(linked, axis=1), axis=1)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(a), pa.int64()), pa.array(a), pa.array(b)], ["prefix", "a", "b"])


def _shared_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of one partition by prefix: every set to the smallest under its prefix, and those found before."""
    held = [batch.columns for batch in batches if batch.num_rows]
    if held:
        prefix, a, b = (pa.chunked_array(c).combine_chunks() for c in zip(*held, strict=True))
        done = prefix.is_null().to_numpy(zero_copy_only=False)
        keys, a, b = prefix.fill_null(0).to_numpy(), a.to_numpy(), b.fill_null(0).to_numpy()
        x, y, _ = stars(a[~done], keys[~done])
        pairs = np.unique(np.stack([np.concatenate([x, a[done]]), np.concatenate([y, b[done]])]), axis=1)
        for at in range(0, pairs.shape[1], 1 << 17):
            yield arrow_pairs(*pairs[:, at:at + (1 << 17)])


def similar_pairs(sets: list[np.ndarray], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """All pairs i < j whose Jaccard similarity is at least ``threshold``, by exact counts of common shingles."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    if n == 2:
        if min(sizes) < threshold * max(sizes):
            return np.empty(0, int), np.empty(0, int)
        both = len(np.intersect1d(*sets, assume_unique=True))
        hit = int(both >= threshold * (sizes.sum() - both) - 1e-9)
        return np.array([0] * hit, int), np.array([1] * hit, int)
    owner = np.repeat(np.arange(n), sizes)
    values, index, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.cumsum(count > 1) - 1
    keep = count[index] > 1
    index, owner = shared[index[keep]], owner[keep]
    order = np.argsort(index, kind="stable")
    index, owner = index[order], owner[order]
    both = np.zeros((n, n), np.float32)
    last = int(index[-1]) + 1 if len(index) else 0
    for at in range(0, last, COLUMNS):
        lo, hi = np.searchsorted(index, [at, at + COLUMNS])
        m = np.zeros((n, min(COLUMNS, last - at)), np.float32)
        m[owner[lo:hi], index[lo:hi] - at] = 1
        both += m @ m.T
    both = both.astype(np.float64)
    i, j = np.nonzero(np.triu(both >= threshold * (sizes[:, None] + sizes[None, :] - both) - 1e-9, 1))
    return i, j


def _fetch(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in grown(batch):
                owner, code = shingles(part.column("text"), words)
                bounds = np.searchsorted(owner, np.arange(part.num_rows + 1))
                raw = code.tobytes()
                sets = pa.array([raw[8 * a:8 * b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("root", "pairs", "block", "rep", "n")), sets], ["root", "pairs", "block", "rep", "n", "set"])
    return run


def _verify(threshold: float):
    """Streams block pairs (sorted by root, i, j): rows (a, b, n): n copies linked to a if b is null, else a link."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def settle(rows: list[tuple]) -> None:
            (_, first, second), own = rows[0][0], np.array([r[1] for r in rows])
            i, j = similar_pairs([np.frombuffer(r[4], np.uint64) for r in rows], threshold)
            if first != second:
                cross = own[i] != own[j]
                i, j = i[cross], j[cross]
            if not len(i):
                return
            n, rep = np.array([r[3] for r in rows]), np.array([r[2] for r in rows])
            counts = np.bincount(i, n[j], len(rows)) + np.bincount(j, n[i], len(rows))
            out.extend((int(rep[k]), None, int(counts[k])) for k in np.flatnonzero(counts))
            top = np.arange(len(rows))
            parent = top.tolist()

            def find(x):
                while parent[x] != x:
                    parent[x] = parent[parent[x]]
                    x = parent[x]
                return x

            for x, y in zip(i.tolist(), j.tolist(), strict=True):
                x, y = find(x), find(y)
                if x != y:
                    parent[max(x, y)] = min(x, y)
            out.extend((int(rep[k]), int(rep[find(k)]), None) for k in top.tolist() if find(k) != k)

        def flush() -> pa.RecordBatch:
            a, b, n = zip(*out, strict=True)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64())], ["a", "b", "n"])

        rows: list[tuple] = []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("root", "i", "j", "block", "rep", "n", "set")]
            for root, i, j, block, rep, n, blob in zip(*columns, strict=True):
                if rows and rows[0][0] != (root, i, j):
                    settle(rows)
                    rows = []
                rows.append(((root, i, j), block, rep, n, blob))
            if len(out) > 20_000:
                yield flush()
        if rows:
            settle(rows)
        if out:
            yield flush()
    return run


def join_sets(rows: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, trees: int = TREES, deepest: int = DEEPEST, target: float = TARGET, block: int = BLOCK) -> DataFrame:
    """(doc, class_id, group_id, n_links) for rows (doc, text) with unique docs."""
    length = prefix_length(threshold, trees, deepest, target)
    parts = conf_parts(rows)
    signed = rows.select("doc", "text").mapInArrow(_signer(words, trees, length), "doc long, size long, f1 long, f2 long, prefixes array<long>")
    signed = checkpointed(signed)
    sets = signed.where("size > 0")
    classes = checkpointed(sets.groupBy("size", "f1", "f2").agg(F.min("doc").alias("rep"), F.count(F.lit(1)).alias("n")))
    distinct = sets.join(classes.select(F.col("rep").alias("doc")), "doc", "left_semi").select(F.col("doc").alias("rep"), "prefixes")
    near = distinct.mapInArrow(_local_stars, "prefix long, a long, b long").repartition(parts, F.coalesce("prefix", "a")).mapInArrow(_shared_stars, "a long, b long")
    members = checkpointed(components(near).join(classes.select(F.col("rep").alias("id"), "n"), "id").withColumnRenamed("id", "rep"))
    blocks = members.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    large = checkpointed(blocks.where("blocks > 1"))
    dealt = members.join(large, "root", "left").withColumn("block", F.pmod(F.xxhash64("rep"), F.coalesce("blocks", F.lit(1))).cast("int"))
    mates = F.transform(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1), lambda other: F.struct(F.least("block", other).alias("i"), F.greatest("block", other).alias("j")))
    wanted = dealt.select("root", "rep", "n", "block", mates.alias("pairs"))
    fetched = rows.select(F.col("doc").alias("rep"), shrunk(F.col("text")).alias("text")).join(wanted, "rep").mapInArrow(
        _fetch(words), "root long, pairs array<struct<i:int,j:int>>, block int, rep long, n long, set binary")
    spread = fetched.select("root", F.explode("pairs").alias("p"), "block", "rep", "n", "set").select("root", "p.i", "p.j", "block", "rep", "n", "set")
    found = checkpointed(spread.repartition(parts, "root", "i", "j").sortWithinPartitions("root", "i", "j", "rep").mapInArrow(_verify(threshold), "a long, b long, n long"))
    groups = components(found.where("b IS NOT NULL").select("a", "b"))
    links = found.where("b IS NULL").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("links"))
    facts = checkpointed(classes.join(links, "rep", "left").join(groups.withColumnRenamed("id", "rep"), "rep", "left")
                         .select("size", "f1", "f2", "rep", F.coalesce("root", "rep").alias("root"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links")))
    return signed.select("doc", "size", "f1", "f2").join(facts, ["size", "f1", "f2"], "left").select(
        "doc", F.coalesce("rep", "doc").alias("class_id"), F.coalesce("root", "doc").alias("group_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document: doc_id, class_id, group_id, n_links.

    class_id is the smallest id with the same shingle set, group_id the smallest id reached over links, n_links the number
    of other documents at the threshold or above.  Texts that are null or have no word link with nothing.  Rows that
    repeat an id, or have none, are documents of their own, numbered for this result by id and text; the classes then
    name these numbers.  An empty table gives no rows.
    """
    rows = keyed(docs, id_col, text_col, [])
    joined = join_sets(rows, **options)
    return joined.join(rows.select("doc", F.col("carry.c0").alias("doc_id")), "doc").select("doc_id", "class_id", "group_id", "n_links")


def one_of_each_group(docs: DataFrame) -> DataFrame:
    """The documents, all columns as they are, without those that are near copies of a kept one of their group.

    A group keeps its first document.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    rows = keyed(docs, "doc_id", "text", others)
    gone = join_sets(rows).where("doc <> group_id").select("doc")
    at = {"doc_id": F.col("carry.c0"), "text": F.col("text")} | {c: F.col(f"carry.c{i + 1}") for i, c in enumerate(others)}
    return rows.join(gone, "doc", "left_anti").select(*[at[c].alias(c) for c in docs.columns])


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
