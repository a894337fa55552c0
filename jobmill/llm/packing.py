"""Best-fit packing of tokenized documents into sequences of a fixed length.

Tokenizing.  A text is split before every single blank that stands in front of a visible character; no token of the
byte-level vocabulary crosses such a place, so equal words have equal ids and each is encoded once per task.

Packing is best-fit decreasing in bulk-synchronous rounds.  Documents are range-sorted by length, so documents of one
length are a run of consecutive ranks, and sequences opened alike are a run of consecutive numbers with the same gap.
In each round the documents of the next smaller length sweep over the gaps: a gap's successor run is the smallest one
they fit, a rank decides which of them takes which sequence, gaps shrink, and the next round begins.  Lengths and gaps
are whole numbers up to the capacity, so the state of all rounds is two lists of runs whose size the capacity bounds
whatever the number of documents; the rounds yield a short table of rank ranges, and every task places its own
documents by looking up their ranks.  The result equals placing documents one by one.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobmill.llm.common import conf_parts, key_long, picked, prefix_sums, release, slices, span_hash, utf8
from jobmill.session import checkpointed

CAPACITY, END_ID = 1024, 2
SPECIAL = "<|endoftext|>"
CACHE_WORDS = 200_000
_VISIBLE = np.array([0x21 <= b <= 0x7E or b >= 0xC3 and b not in (0xE1, 0xE2, 0xE3) for b in range(256)])  # certainly no white space begins so
_encoders: dict[tuple, Encoder] = {}


class Encoder:
    """Ids of texts under the public byte-level vocabulary, with a bounded memory of words."""

    def __init__(self, ranks_path: str, json_path: str):
        import public_tokenizers
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.core = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.width = np.zeros(len(ranks) + 1, np.int64)
        for token, rank in ranks.items():
            self.width[rank] = len(token)
        self.json_path, self.whole = json_path, None
        self.forget()

    def forget(self) -> None:
        self.slots: dict[int, int] = {}
        self.ids, self.starts, self.counts, self.used, self.n = np.empty(1 << 16, np.uint32), np.empty(1 << 12, np.int64), np.empty(1 << 12, np.int64), 0, 0

    def keep(self, ids: np.ndarray, counts: np.ndarray) -> None:
        """Append words with their ids one after another."""
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        while self.n + len(counts) > len(self.starts):
            self.starts, self.counts = np.concatenate([self.starts, np.empty_like(self.starts)]), np.concatenate([self.counts, np.empty_like(self.counts)])
        self.ids[self.used:self.used + len(ids)] = ids
        self.counts[self.n:self.n + len(counts)] = counts
        self.starts[self.n:self.n + len(counts)] = self.used + np.cumsum(counts) - counts
        self.used, self.n = self.used + len(ids), self.n + len(counts)

    def words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the words, and for every text the number of words before it."""
        cut = np.zeros(len(data), bool)
        if len(data) > 1:
            cut[:-1] = (data[:-1] == 0x20) & _VISIBLE[data[1:]]
        first = offsets[:-1][offsets[:-1] < offsets[1:]]
        inner = offsets[1:-1]
        inner = inner[(inner > 0) & (inner < len(data))]
        cut[inner - 1] = False  # a blank at the end of a text is followed by nothing
        cut[first] = True
        starts = np.flatnonzero(cut)
        return starts, np.append(starts[1:], len(data)) if len(starts) else starts, np.searchsorted(starts, offsets)

    def learn(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, first_of_text: np.ndarray) -> None:
        """Encode new words: those that begin with a blank in one call, the others one by one."""
        raw = data.tobytes()
        joined = np.flatnonzero(~first_of_text)
        for i in np.flatnonzero(first_of_text):
            ids = self.core.encode_ordinary(raw[starts[i]:ends[i]].decode())
            self.slots[int(hashes[i])] = self.n
            self.keep(np.array(ids, np.uint32), np.array([len(ids)]))
        if len(joined):
            ids = np.array(self.core.encode_ordinary(b"".join([raw[s:e] for s, e in zip(starts[joined].tolist(), ends[joined].tolist(), strict=True)]).decode()), np.uint32)
            reached = np.cumsum(self.width[ids])
            stops = np.searchsorted(reached, np.cumsum(ends[joined] - starts[joined]), side="left") + 1
            self.slots.update(zip(hashes[joined].tolist(), range(self.n, self.n + len(joined)), strict=True))
            self.keep(ids, np.diff(stops, prepend=0))

    def encode(self, column: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each text closed by ``end_id``, and the n + 1 offsets of the texts."""
        data, offsets = utf8(column)
        if len(self.slots) > CACHE_WORDS:
            self.forget()
        starts, ends, before = self.words(data, offsets)
        hashes, at, inverse = np.unique(span_hash(prefix_sums(data), starts, ends), return_index=True, return_inverse=True)
        known = np.fromiter((self.slots.get(h, -1) for h in hashes.tolist()), np.int64, len(hashes))
        if (new := np.flatnonzero(known < 0)).size:
            pick = at[new]
            self.learn(data, starts[pick], ends[pick], hashes[new], ~((data[starts[pick]] == 0x20) & _VISIBLE[data[np.minimum(starts[pick] + 1, len(data) - 1)]] & (ends[pick] - starts[pick] > 1)))
            known[new] = np.fromiter((self.slots[h] for h in hashes[new].tolist()), np.int64, len(new))
        slots = known[inverse]
        counts, begins = self.counts[slots], self.starts[slots]
        sums = np.concatenate([[0], np.cumsum(counts)])
        flat = self.ids[np.repeat(begins - sums[:-1], counts) + np.arange(sums[-1])]
        lengths = np.diff(sums[before])
        out = np.full(len(flat) + len(lengths), end_id, np.uint32)
        bounds = np.concatenate([[0], np.cumsum(lengths + 1)])
        out[np.arange(len(flat)) + np.repeat(np.arange(len(lengths)), lengths)] = flat
        if SPECIAL.encode() in data.tobytes():
            return self._with_special(column, out, bounds, end_id)
        return out, bounds

    def _with_special(self, column: pa.Array, out: np.ndarray, bounds: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Texts that hold the special token's string go to the tokenizer whole, which gives it its own id."""
        from tokenizers import Tokenizer

        self.whole = self.whole or Tokenizer.from_file(self.json_path)
        parts = [out[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        for i, text in enumerate(column.to_pylist()):
            if text and SPECIAL in text:
                parts[i] = np.array([*self.whole.encode(text, add_special_tokens=False).ids, end_id], np.uint32)
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])


def encoder(ranks_path: str, json_path: str) -> Encoder:
    key = (ranks_path, json_path)
    if key not in _encoders:
        _encoders[key] = Encoder(*key)
    return _encoders[key]


def _cutter(ranks_path: str, json_path: str, capacity: int, end_id: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(ranks_path, json_path)
        for batch in batches:
            for part in slices(batch):
                ids, bounds = tool.encode(part.column("text"), end_id)
                lengths = np.diff(bounds)
                pieces = -(-lengths // capacity)
                owner = np.repeat(np.arange(len(lengths)), pieces)
                number = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                head = lengths - (pieces - 1) * capacity
                start = np.where(number == 0, 0, head[owner] + (number - 1) * capacity)
                size = np.where(number == 0, head[owner], capacity)
                raw = memoryview(np.ascontiguousarray(ids.astype("<u4"))).cast("B")
                begin = bounds[:-1][owner] + start
                crc = [zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(begin.tolist(), (begin + size).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(owner)), pa.array(number, pa.int32()), pa.array(start), pa.array(size), pa.array(crc, pa.int64())],
                                                 ["doc_id", "piece", "start", "length", "ids_crc32"])
        tool.forget()  # the worker goes on to other work
        release()
    return cut


def token_pieces(docs: DataFrame, ranks_path: str, json_path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of at most ``capacity`` ids; only longer documents are cut, and the odd piece comes first."""
    return picked(docs, doc_id=docs[id_col].cast("long"), text=text_col).mapInArrow(_cutter(ranks_path, json_path, capacity, end_id), "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit_rounds(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """The rank ranges of best-fit decreasing over ``counts`` (length: number of pieces), and the sequences used.

    Rows (first rank, pieces per sequence, first sequence, offset, length), ranks counting from the longest piece.
    """
    gaps: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by gap: runs (first sequence, how many)
    flows, rank, opened = [], 0, 0

    def put(length: int, left: int, gap: int, first: int, many: int) -> tuple[int, int]:
        """Fill ``many`` sequences from ``first`` on; returns the pieces left and the sequences not used."""
        nonlocal rank
        each = gap // length
        for per in (each, left % each):  # whole sequences, then one for the rest
            take = min(many, left // per) if per else 0
            if take and (per == each or take == 1):
                flows.append((rank, per, first, capacity - gap, length))
                gaps[gap - per * length].append((first, take))
                rank, left, first, many = rank + take * per, left - take * per, first + take, many - take
        return left, many

    for length in sorted(counts, reverse=True):
        left = counts[length]
        for gap in range(length, capacity + 1):
            if not left:
                break
            runs, gaps[gap] = gaps[gap], []
            for first, many in runs:
                rest = many
                if left:
                    left, rest = put(length, left, gap, first, many)
                if rest:
                    gaps[gap].append((first + many - rest, rest))
        if left:
            fresh = -(-left // (capacity // length))
            put(length, left, capacity, opened, fresh)
            opened += fresh
    return np.array(flows, np.int64).reshape(-1, 5), opened


PLACE_BITS = 33  # the row's number within its partition, below the partition's number, in a monotonically increasing id


def _placer(flows: np.ndarray, before: np.ndarray):
    """Looks up every row by the rank that it carries, so rows may come in any order and in any partition."""
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("_at").to_numpy()
            ranks = before[at >> PLACE_BITS] + (at & ((1 << PLACE_BITS) - 1))
            row = flows[np.searchsorted(flows[:, 0], ranks, side="right") - 1]
            nth = ranks - row[:, 0]
            kept = batch.drop_columns(["_at"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(row[:, 2] + nth // row[:, 1]), pa.array(row[:, 3] + nth % row[:, 1] * row[:, 4])],
                                             [*kept.schema.names, "sequence_id", "offset"])
    return place


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (any columns but _at, among them doc_id, piece, length) with sequence_id and offset.

    The result may be coalesced, united or filtered like any other table.
    """
    pieces = checkpointed(pieces)  # else the range sort would make the pieces twice
    order = (F.col("length").desc(), key_long(F.col("doc_id")), F.col("piece"))
    ranged = checkpointed(pieces.repartitionByRange(conf_parts(pieces), *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    counts = {r["length"]: r["n"] for r in ranged.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``capacity`` rows
    if not counts:
        return ranged.drop("_at").withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    flows, _ = best_fit_rounds(counts, capacity)
    sizes = {r["p"]: r["n"] for r in ranged.groupBy(F.shiftright("_at", PLACE_BITS).alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}  # a number per partition
    before = np.zeros(max(sizes) + 2, np.int64)
    for p, n in sizes.items():
        before[p + 1] = n
    before = np.cumsum(before)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranged.schema if f.name != "_at")
    return ranged.mapInArrow(_placer(flows, before), f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, ranks_path: str | None = None, json_path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null text counts as empty and is the end id alone; repeated rows are packed each; a null doc_id is carried; an
    empty table gives no rows; other columns are ignored.
    """
    import public_tokenizers

    ranks_path, json_path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), json_path or public_tokenizers.path("byte_bpe_50k.json")
    return pack_pieces(token_pieces(docs, ranks_path, json_path, capacity, end_id, id_col, text_col), capacity)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
