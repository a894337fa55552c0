"""Removal of repeated byte strings by external induced suffix sorting.

A byte goes if a string of ``length`` bytes that covers it also starts earlier (in a smaller doc_id, or earlier in
the same document).  Sorting every suffix of a large corpus would move far more than the corpus, so only the suffixes that
can matter are sorted:

1. *Anchors.*  Every string of ``length`` bytes is filed under its leftmost smallest gram of ``GRAM`` bytes (by hash).
   Equal strings have equal anchors at equal offsets, so strings under different anchors need no comparison.  The
   strings of one anchor begin at neighbouring bytes and form one context.  Tasks keep the first of equal contexts
   they see and report the others as repeated, so copies are combined before the shuffle.
2. *Contexts.*  One shuffle by anchor finds contexts that occurred before (all their strings are repeated) and anchors with several
   different contexts.  Everything else, by far the most, is unique and ends here.
3. *Induced sorting.*  The remaining contexts are fetched from their documents, dealt into shards by anchor and sorted on
   disk by Spark's spilling sort; a shard streams through its task anchor by anchor.  The suffixes at the anchors are
   sorted with their common-prefix values.  From them the order of the suffixes one byte further left is induced: a tuple
   (anchor, byte in front, rank of the suffix behind it) sorts them, and the common prefix of neighbours is one more
   than the smallest value between the two ranks they came from.  Repeating this walks left through all strings of the anchor;
   runs of suffixes with a common prefix of ``length`` or more are equal strings, of which the earliest stays.
4. *Cutting.*  The repeated strings of each document are united and cut out.

An anchor that a sample shows to have very many different contexts (a short line on a third of all pages, say) is
replaced by its whole strings, each an anchor of its own; the result is the same and no shard holds more than its part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobmill.llm.common import GOLDEN, conf_parts, grown, key_long, mix, picked, prefix_sums, release, shrunk, slices, span_hash, utf8
from jobmill.session import checkpointed, fresh_dir

LENGTH, GRAM = 100, 32
SAMPLE = 64  # one document in so many is looked at for hot anchors
HOT_CONTEXTS, HOT_MOST = 40, 100_000  # contexts in the sample that make an anchor hot; hot anchors at most
PART_BYTES = 24 << 20  # text behind one partition of anchors
SHARD_ROWS = 1 << 16  # contexts sorted at once, unless one anchor has more
ANCHORS = "anchor long, context long, doc long, place long"


def window_minima(keys: np.ndarray, width: int) -> np.ndarray:
    """The smallest key of each ``width`` neighbours, by doubling."""
    out, have = keys, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[:len(keys) - width + 1], out[width - have:]) if have < width else out


def contexts(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Per run of strings with one anchor: text, first start, number of starts, anchor place, anchor hash, sums."""
    sums, width = prefix_sums(data), length - gram + 1
    none = np.empty(0, np.int64)
    if len(data) < length:
        return none, none, none, none, none.astype(np.uint64), sums
    at = np.arange(len(data) - gram + 1)
    hashes = span_hash(sums, at, at + gram)
    keys = (hashes & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
    place = (window_minima(keys, width) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:len(place)]
    valid = np.arange(len(place)) + length <= offsets[1:][owner]
    starts = np.flatnonzero(valid)
    if not len(starts):
        return none, none, none, none, none.astype(np.uint64), sums
    new = np.ones(len(starts), bool)
    new[1:] = (place[starts[1:]] != place[starts[:-1]]) | (owner[starts[1:]] != owner[starts[:-1]])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(starts)))
    first = starts[first]
    return owner[first], first, count, place[first], hashes[place[first]], sums


def pack(start, count, ahead, done):
    return (start << 15) | (count << 8) | (ahead << 1) | done


def unpack(place: np.ndarray) -> tuple[np.ndarray, ...]:
    """Start in the text, number of starts, bytes from the start to the anchor, whether already known as repeated."""
    return place >> 15, (place >> 8) & 127, (place >> 1) & 127, (place & 1).astype(bool)


def later(keys: tuple[np.ndarray, ...], doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sort by keys, document and start; the order, where a key begins, and which rows (in that order) have an earlier equal one."""
    order = np.lexsort((start, doc, *reversed(keys)))
    begins = np.ones(len(order), bool)
    same = np.ones(max(len(order) - 1, 0), bool)
    for k in keys:
        same &= k[order[1:]] == k[order[:-1]]
    begins[1:] = ~same
    head = np.flatnonzero(begins)[np.cumsum(begins) - 1] if len(order) else order
    ahead = (doc[order] != doc[order[head]]) | (start[order] != start[order[head]])
    return order, begins, ahead


def _anchors(length: int, gram: int, hot: np.ndarray, combine: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                data, offsets = utf8(part.column("text"))
                doc_ids = part.column("doc").to_numpy()
                text, first, count, place, anchor, sums = contexts(data, offsets, length, gram)
                if not len(text):
                    continue
                if len(hot) and (is_hot := np.isin(anchor, hot)).any():
                    many = count[is_hot]
                    each = np.repeat(first[is_hot], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                    text, first = np.concatenate([text[~is_hot], np.repeat(text[is_hot], many)]), np.concatenate([first[~is_hot], each])
                    count, place = np.concatenate([count[~is_hot], np.ones(len(each), np.int64)]), np.concatenate([place[~is_hot], each])
                    anchor = np.concatenate([anchor[~is_hot], mix(span_hash(sums, each, each + length) ^ GOLDEN)])
                context = span_hash(sums, first, first + count - 1 + length) ^ mix((place - first).astype(np.uint64) + GOLDEN)
                start, doc = first - offsets[:-1][text], doc_ids[text]
                done = np.zeros(len(text), np.int64)
                route = anchor
                if combine:
                    order, _, ahead = later((anchor, context), doc, start)
                    done[order] = ahead
                    route = np.where(done > 0, mix(doc.astype(np.uint64) * GOLDEN + start.astype(np.uint64)), anchor)
                yield pa.RecordBatch.from_arrays([pa.array(route.view(np.int64)), pa.array(context.view(np.int64)), pa.array(doc), pa.array(pack(start, count, place - first, done))],
                                                 ["anchor", "context", "doc", "place"])
        release()
    return run


def _contests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of one partition by anchor: contexts that are repeated, and first contexts of anchors that have others."""
    held = [[c.to_numpy() for c in batch.columns] for batch in batches]
    if not held:
        return
    anchor, context, doc, place = (np.concatenate(c) for c in zip(*held, strict=True))
    start, _, _, done = unpack(place)
    reported = np.flatnonzero(done)
    open_rows = np.flatnonzero(~done)
    anchor, context, doc, place, start, known = anchor[open_rows], context[open_rows], doc[open_rows], place[open_rows], start[open_rows], (doc[reported], place[reported])
    order, begins, ahead = later((anchor, context), doc, start)
    firsts = order[begins]
    _, index, n = np.unique(anchor[firsts], return_inverse=True, return_counts=True)
    contested = firsts[n[index] > 1]
    repeated = order[ahead]
    parts = ((np.zeros(len(reported), np.int64), *known, True), (anchor[repeated], doc[repeated], place[repeated], True), (anchor[contested], doc[contested], place[contested], False))
    for a, d, p, r in parts:
        for at in range(0, len(a), 1 << 17):
            cut = slice(at, at + (1 << 17))
            yield pa.RecordBatch.from_arrays([pa.array(a[cut]), pa.array(d[cut]), pa.array(p[cut]), pa.array(np.full(len(a[cut]), r))], ["anchor", "doc", "place", "repeated"])


def _fetch(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The bytes of the contexts that a document takes part with."""
        for batch in batches:
            for part in grown(batch):
                data, offsets = utf8(part.column("text"))
                raw = data.tobytes()
                rows = part.column("wanted")
                owner = np.repeat(np.arange(part.num_rows), np.diff(rows.offsets.to_numpy()))
                flat = rows.flatten()
                anchor, place = flat.field("anchor"), flat.field("place").to_numpy()
                start, count, _, _ = unpack(place)
                begin = offsets[:-1][owner] + start
                blobs = [raw[a:b] for a, b in zip(begin.tolist(), (begin + count - 1 + length).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([anchor, part.column("doc").take(pa.array(owner)), pa.array(place), pa.array(blobs, pa.binary())], ["anchor", "doc", "place", "bytes"])
    return run


def range_minima(values: np.ndarray):
    """Answers smallest value in (a, b] for arrays of a < b."""
    levels = [values]
    while (1 << len(levels)) <= len(values):
        half = 1 << (len(levels) - 1)
        levels.append(np.minimum(levels[-1][:-half], levels[-1][half:]))

    def smallest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out, level = np.empty(len(a), values.dtype), np.log2(np.maximum(b - a, 1)).astype(int)
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            out[at] = np.minimum(levels[k][a[at] + 1], levels[k][b[at] - (1 << k) + 1])
        return out
    return smallest


def induced_repeats(anchor: np.ndarray, doc: np.ndarray, place: np.ndarray, blobs: list[bytes], length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first start, end) of the strings that occurred before, by induced sorting of the contexts' suffixes."""
    start, _, ahead, _ = unpack(place)
    n, most = len(blobs), int(ahead.max())
    sizes = np.array([len(b) for b in blobs])
    right = sizes - ahead
    raw, base = np.frombuffer(b"".join(blobs) + bytes(length + 8), np.uint8), np.cumsum(sizes) - sizes
    behind = np.minimum(right, length)
    wide = -(-length // 8) * 8
    tail = raw[np.minimum((base + ahead)[:, None] + np.arange(wide), len(raw) - 1)]
    tail = np.where(np.arange(wide) < behind[:, None], tail, 0).astype(np.uint8)
    group = np.unique(anchor, return_inverse=True)[1].astype(np.int64)
    words = np.ascontiguousarray(tail).view(">u8").astype(np.uint64)
    rank = np.lexsort((behind, *words.T[::-1], group))  # the rows in the order of their suffixes at the anchor
    differs = tail[rank[1:]] != tail[rank[:-1]]
    prefix = np.where(differs.any(axis=1), differs.argmax(axis=1), wide)
    prefix = np.minimum(prefix, np.minimum(behind[rank[1:]], behind[rank[:-1]]))
    prefix = np.concatenate([[0], np.where(group[rank[1:]] == group[rank[:-1]], prefix, 0)]).astype(np.int16)
    hit = np.zeros((n, most + 1), bool)
    for back in range(most + 1):
        if back:  # induce the order one byte further left from the one behind it
            smallest = range_minima(prefix)
            live = np.flatnonzero(ahead[rank] >= back)
            rows = rank[live]
            key = (group[rows] << 8) | raw[base[rows] + ahead[rows] - back]
            order = np.argsort(key, kind="stable")
            key, live = key[order], live[order]
            prefix = np.zeros(len(live), np.int16)
            joined = np.flatnonzero(key[1:] == key[:-1])
            prefix[joined + 1] = smallest(live[joined], live[joined + 1]) + 1
            rank = rank[live]
        run = np.cumsum(prefix < length)
        size = np.bincount(run)
        many = np.flatnonzero(size[run] > 1)
        if len(many):
            rows = rank[many]
            order, _, is_later = later((run[many],), doc[rows], start[rows] + ahead[rows] - back)
            hit[rows[order[is_later]], back] = True
    edges = np.diff(np.pad(hit, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, low = np.nonzero(edges == 1)
    _, high = np.nonzero(edges == -1)
    return row, (start + ahead)[row] - (high - 1), (start + ahead)[row] - low + length


def _sorter(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Streams a shard that is sorted by anchor; whole anchors are sorted together, about SHARD_ROWS rows at once."""
        def solved(table: pa.Table) -> pa.RecordBatch:
            table = table.combine_chunks()
            doc = table.column("doc").to_numpy()
            row, low, high = induced_repeats(table.column("anchor").to_numpy(), doc, table.column("place").to_numpy(), table.column("bytes").to_pylist(), length, gram)
            return pa.RecordBatch.from_arrays([pa.array(doc[row]), pa.array(low), pa.array(high)], ["doc", "low", "high"])

        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows >= SHARD_ROWS:
                table = pa.Table.from_batches(held)
                keys = table.column("anchor").to_numpy()
                cut = int(np.searchsorted(keys, keys[-1], side="left"))  # the last anchor may go on
                if cut:
                    yield solved(table.slice(0, cut))
                held = table.slice(cut).to_batches()
                rows -= cut
        if rows:
            yield solved(pa.Table.from_batches(held))
    return run


def keyed(docs: DataFrame, id_col: str, text_col: str, others: list[str]) -> DataFrame:
    """(doc, text, carry) with a key per row that orders as the ids do; carry holds the id and the ``others``.

    The key is the id itself where ids are unique; else the rows are numbered by id and text and written to the shared
    folder first, so rows that repeat an id come one after another like documents of their own.
    """
    carry = F.struct(docs[id_col].alias("c0"), *[docs[c].alias(f"c{i + 1}") for i, c in enumerate(others)])
    rows = picked(docs, doc=docs[id_col].cast("long"), text=text_col, carry=carry)
    if not _repeats_ids(rows):
        return rows
    path = fresh_dir(docs.sparkSession, "keyed")
    order = (key_long(F.col("doc")), F.xxhash64("text"))
    ranged = rows.repartitionByRange(conf_parts(rows), *order).sortWithinPartitions(*order)
    ranged.withColumn("doc", F.monotonically_increasing_id()).write.parquet(path)
    return docs.sparkSession.read.schema(rows.schema).parquet(path)


def _repeats_ids(rows: DataFrame) -> bool:
    odd = rows.groupBy("doc").agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR doc IS NULL")
    return bool(odd.limit(1).count())


def hot_anchors(rows: DataFrame, length: int, gram: int, sample: int, least: int) -> np.ndarray:
    """Anchors with many different contexts among one document in ``sample``; at most HOT_MOST by the bound on the share."""
    some = rows.where(F.pmod(F.xxhash64("doc"), F.lit(sample)) == 0).select("doc", "text").mapInArrow(_anchors(length, gram, np.empty(0, np.uint64), False), ANCHORS)
    seen = checkpointed(some.groupBy("anchor", "context").agg(F.lit(1).alias("one")).groupBy("anchor").agg(F.count(F.lit(1)).alias("n")))
    total = seen.agg(F.sum("n").alias("n")).first()["n"] or 0
    found = seen.where(F.col("n") >= max(least, total // HOT_MOST)).select("anchor").toArrow().column("anchor").to_numpy()
    return found.astype(np.int64).view(np.uint64)


def repeated_spans(rows: DataFrame, length: int = LENGTH, gram: int = GRAM, sample: int = SAMPLE, hot_contexts: int = HOT_CONTEXTS) -> DataFrame:
    """(doc, low, high): byte ranges that are made of strings with an earlier occurrence; they may overlap."""
    size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    parts = max(conf_parts(rows), size // PART_BYTES + 1)
    hot = hot_anchors(rows, length, gram, sample, hot_contexts)
    found = rows.select("doc", "text").mapInArrow(_anchors(length, gram, hot, True), ANCHORS)
    contests = checkpointed(found.repartition(parts, "anchor").mapInArrow(_contests, "anchor long, doc long, place long, repeated boolean"))
    start, count = F.shiftright("place", 15), F.shiftright("place", 8).bitwiseAND(127)
    plain = contests.where("repeated").select("doc", start.alias("low"), (start + count - 1 + length).alias("high"))
    wanted = contests.where("NOT repeated").groupBy("doc").agg(F.collect_list(F.struct("anchor", "place")).alias("wanted"))  # bounded by the document
    fetched = rows.select("doc", shrunk(F.col("text")).alias("text")).join(wanted, "doc").mapInArrow(_fetch(length), "anchor long, doc long, place long, bytes binary")
    induced = fetched.repartition(parts, "anchor").sortWithinPartitions("anchor").mapInArrow(_sorter(length, gram), "doc long, low long, high long")
    return plain.unionByName(induced)


def _cut(as_text: bool):
    """Cuts the spans out; what stays is given as bytes, or as text without the pieces of characters that a cut leaves over."""
    kind = pa.string() if as_text else pa.binary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in grown(batch):
                n_removed, n_spans, digests, kept = [], [], [], []
                spans = part.column("spans")
                for text, cuts in zip(part.column("text"), spans, strict=True):
                    raw = text.as_py() or b""
                    pieces, at, removed, runs = [], 0, 0, 0
                    if cuts.is_valid:
                        low, high = cuts.values.field("low").to_numpy(), cuts.values.field("high").to_numpy()
                        order = np.argsort(low, kind="stable")
                        low, reach = low[order], np.maximum.accumulate(high[order])
                        new = np.append(True, low[1:] > reach[:-1])
                        for a, b in zip(low[new].tolist(), reach[np.append(np.flatnonzero(new)[1:] - 1, len(low) - 1)].tolist(), strict=True):
                            pieces.append(raw[at:a])
                            at, removed, runs = b, removed + b - a, runs + 1
                    pieces.append(raw[at:])
                    rest = b"".join(pieces)
                    n_removed.append(removed)
                    n_spans.append(runs)
                    digests.append(hashlib.sha256(rest).hexdigest())
                    kept.append(None if not text.is_valid else rest.decode(errors="ignore") if as_text else rest)
                yield pa.RecordBatch.from_arrays([part.column("carry"), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(digests), pa.array(kept, kind)],
                                                 ["carry", "n_removed", "n_spans", "kept_sha256", "kept"])
        release()
    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, hot_contexts: int = HOT_CONTEXTS) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes that stay).

    A null text is empty; texts shorter than ``length`` stay whole; a null id sorts before all others; rows that repeat an
    id count as documents one after another, ordered by their texts' hashes; an empty table gives no rows.
    """
    cut = cut_documents(docs, length, gram, id_col, text_col, [], sample, hot_contexts)
    return cut.select(F.col("carry.c0").alias("doc_id"), (F.coalesce(F.octet_length("kept"), F.lit(0)) + F.col("n_removed")).cast("long").alias("n_bytes"), "n_removed", "n_spans", "kept_sha256", "kept")


def cut_documents(docs: DataFrame, length: int, gram: int, id_col: str, text_col: str, others: list[str], sample: int = SAMPLE, hot_contexts: int = HOT_CONTEXTS,
                  as_text: bool = False) -> DataFrame:
    """(carry, n_removed, n_spans, kept_sha256, kept) of every row; kept is text if asked for."""
    rows = keyed(docs, id_col, text_col, others)
    spans = repeated_spans(rows, length, gram, sample, hot_contexts).groupBy("doc").agg(F.collect_list(F.struct("low", "high")).alias("spans"))
    joined = rows.withColumn("text", shrunk(F.col("text"))).join(spans, "doc", "left").select("carry", "text", "spans")
    kind = "string" if as_text else "binary"
    return joined.mapInArrow(_cut(as_text), f"carry {rows.schema['carry'].dataType.simpleString()}, n_removed long, n_spans long, kept_sha256 string, kept {kind}")


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """The documents with repeated strings cut out of their texts and n_chars counted anew, all columns in their order.

    Pieces of characters that a cut leaves over are dropped; documents of which nothing is left go, empty ones stay.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    cut = cut_documents(docs, length, gram, "doc_id", "text", others, as_text=True)
    left = cut.where((F.col("n_removed") == 0) | (F.col("kept") != "")).withColumnRenamed("kept", "text")
    at = {"doc_id": F.col("carry.c0"), "text": F.col("text")} | {c: F.col(f"carry.c{i + 1}") for i, c in enumerate(others)}
    if "n_chars" in at:
        at["n_chars"] = F.char_length("text").cast(docs.schema["n_chars"].dataType)
    return left.select(*[at[c].alias(c) for c in docs.columns])


def op2_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept")
