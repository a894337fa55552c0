"""Substring search by postings of trigrams.

A posting says which listings of a block hold three characters in a row.  A task cuts its listings into blocks and makes the postings
of each where the listings are, as bits or distances of their places in the block, so no row for a listing and a trigram is moved or
written.  Postings are laid out by buckets of the trigram and sorted within them, so a search opens the buckets of its own trigrams
alone, and of their files only the row groups that hold them.  The keys of a block stand under the empty trigram.
The listings that hold all of them are then tested for the whole query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from jobmill import constants as K
from jobmill.functions.text import first_present
from jobmill.operators.predicates import searched_text

BUCKETS = 256
LENGTH = 3
BLOCK, CHARS = 1 << 16, 1 << 22  # listings of a block and characters of their texts, at most
KEYS = ""  # the trigram that stands for the keys of a block


def _bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


def _shrunk(data: bytes) -> bytes:
    return len(data).to_bytes(4, "little") + pa.Codec("zstd").compress(data, asbytes=True)


def _grown(data: bytes) -> bytes:
    return pa.Codec("zstd").decompress(data[4:], int.from_bytes(data[:4], "little"), asbytes=True)


def _planes(numbers: np.ndarray) -> bytes:
    """The lowest bytes of all numbers, then the next ones: small numbers leave runs of zeros."""
    return np.ascontiguousarray(numbers.view(np.uint8).reshape(len(numbers), numbers.itemsize).T).tobytes()


def _numbers(data: bytes, kind: str) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def packed_places(places: np.ndarray, size: int) -> bytes:
    """Rising places in a block of ``size`` rows, as bits where they lie close and as distances where they do not."""
    if len(places) * 32 > size:
        bits = np.zeros(size, bool)
        bits[places] = True
        return b"b" + _shrunk(np.packbits(bits).tobytes())
    return b"d" + _shrunk(_planes(np.diff(places, prepend=0).astype("<u2" if size <= 1 << 16 else "<u4")))


def unpacked_places(data: bytes, size: int) -> np.ndarray:
    """A flag for each row of the block."""
    if data[:1] == b"b":
        return np.unpackbits(np.frombuffer(_grown(data[1:]), np.uint8), count=size).astype(bool)
    out = np.zeros(size, bool)
    out[np.cumsum(_numbers(_grown(data[1:]), "<u2" if size <= 1 << 16 else "<u4").astype(np.int64))] = True
    return out


def packed_keys(keys: pa.Array) -> bytes:
    if pa.types.is_integer(keys.type):
        return b"i" + _shrunk(_planes(np.diff(keys.to_numpy(zero_copy_only=False).astype("<i8"), prepend=0)))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, pa.schema([("key", keys.type)])) as writer:
        writer.write_batch(pa.RecordBatch.from_arrays([keys], ["key"]))
    return b"a" + _shrunk(sink.getvalue().to_pybytes())


def unpacked_keys(data: bytes) -> pa.Array:
    if data[:1] == b"i":
        return pa.array(np.cumsum(_numbers(_grown(data[1:]), "<i8")))
    return pa.ipc.open_stream(_grown(data[1:])).read_all().column(0).combine_chunks()


def grams_of(texts: list[str]) -> list[tuple[str, np.ndarray]] | None:
    """Each trigram with the places of the texts that hold it; None for texts of too many different characters to be numbered together."""
    chars = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
    used = np.zeros(0x110000, bool)
    used[chars] = True
    letters, n = np.flatnonzero(used), max(1, len(texts))
    size = len(letters)
    if size ** LENGTH * n >= 1 << 63:
        return None
    ids, owner = (np.cumsum(used) - 1)[chars], np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    last = len(chars) - LENGTH + 1
    if last < 1:
        return []
    key = ids[:last]
    for i in range(1, LENGTH):
        key = key * size + ids[i:last + i]
    key = np.sort((key * n + owner[:last])[owner[:last] == owner[LENGTH - 1:]])
    key = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
    gram, place = np.divmod(key, n)
    starts = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]])) if len(gram) else np.empty(0, np.int64)
    names = np.stack([letters[gram[starts] // size ** (LENGTH - 1 - i) % size] for i in range(LENGTH)], axis=1).astype("<u4")
    return [(name.tobytes().decode("utf-32-le"), part) for name, part in zip(names, np.split(place, starts[1:]), strict=False)]


def _indexed(rows: int, chars: int):
    """Listings (key, _text) -> gram, block, held: the postings of each block and, under the empty trigram, its keys."""
    def run(batches):
        n = TaskContext.get().partitionId() << 32

        def postings_of(keys: list[pa.Array], texts: list[str]):
            nonlocal n
            found, column = grams_of(texts), pa.concat_arrays(keys)
            if found is None:
                half = len(texts) // 2
                yield from postings_of([column[:half]], texts[:half])
                yield from postings_of([column[half:]], texts[half:])
                return
            found = [(KEYS, packed_keys(column)), *((gram, packed_places(places, len(texts))) for gram, places in found)]
            yield pa.RecordBatch.from_arrays([pa.array([g for g, _ in found], pa.string()), pa.array(np.full(len(found), n)), pa.array([h for _, h in found], pa.binary())], ["gram", "block", "held"])
            n += 1

        keys, texts, size = [], [], 0
        for batch in batches:
            start, column = 0, batch.column(0)
            for i, value in enumerate(batch.column("_text").cast(pa.binary()).to_pylist()):
                text = value.decode("utf-8", "replace")
                if texts and (len(texts) >= rows or size + len(text) > chars):
                    yield from postings_of([*keys, column[start:i]], texts)
                    keys, texts, size, start = [], [], 0, i
                texts.append(text)
                size += len(text)
            keys.append(column[start:])
        if texts:
            yield from postings_of(keys, texts)
    return run


def postings(listings: DataFrame, key: str, house: str = K.DEFAULT_HOUSE) -> DataFrame:
    """(bucket, gram, block, held) for each block of listings and each distinct trigram of their searched texts.

    Rows without a key take no part.  A task's rows are sorted first, so that like texts lie together, their trigrams come in runs, and a
    task that runs again makes the same blocks.
    """
    texts = listings.select(key, searched_text(house).alias("_text")).where(F.col(key).isNotNull() & F.col("_text").isNotNull())
    rows = texts.sortWithinPartitions("_text", key).mapInArrow(_indexed(BLOCK, CHARS), "gram string, block long, held binary")
    return rows.select(_bucket(F.col("gram")).alias("bucket"), "gram", "block", "held")


def write_postings(listings: DataFrame, key: str, path: str, house: str = K.DEFAULT_HOUSE) -> None:
    """The posting table of a snapshot, written beside it."""
    rows = postings(listings, key, house).hint("rebalance", "bucket")
    rows.sortWithinPartitions("bucket", "gram").write.partitionBy("bucket").parquet(path)


def _holders(grams: list[str], key: str, kind: pa.DataType):
    """The keys of a block's listings that hold all trigrams."""
    def run(table: pa.Table) -> pa.Table:
        held = dict(zip(table.column("gram").to_pylist(), table.column("held").to_pylist(), strict=True))
        if any(g not in held for g in grams):
            return pa.table({key: pa.array([], kind)})
        keys = unpacked_keys(held[KEYS])
        every = np.ones(len(keys), bool)
        for g in grams:
            every &= unpacked_places(held[g], len(keys))
        return pa.table({key: keys.filter(pa.array(every)).cast(kind)})
    return run


def search_postings(spark: SparkSession, path: str, listings: DataFrame, key: str, query: str, source: str = "all", house: str = K.DEFAULT_HOUSE) -> DataFrame:
    """The rows that ``search_listings`` finds, by way of the postings; a query of fewer than three characters reads all listings."""
    from pyspark.sql.pandas.types import to_arrow_type

    wanted = query.strip().lower()
    found = listings.where(searched_text(house).contains(wanted))
    if source != "all":
        found = found.where(first_present("source", F.lit(house)) == source)
    grams = sorted({wanted[i:i + LENGTH] for i in range(len(wanted) - LENGTH + 1)})
    if not grams:
        return found
    opened = [KEYS, *grams]
    buckets = [r["b"] for r in spark.createDataFrame([(g,) for g in opened], "gram string").select(_bucket(F.col("gram")).alias("b")).distinct().collect()]  # of one query
    held = spark.read.parquet(path).where(F.col("bucket").isin(buckets) & F.col("gram").isin(opened))
    schema = StructType([StructField(key, listings.schema[key].dataType)])
    holders = held.groupBy("block").applyInArrow(_holders(grams, key, to_arrow_type(schema[key].dataType)), schema)
    hits = holders.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n = 1").select(key)  # a key that repeats names no listing
    return found.join(hits, key, "left_semi")
