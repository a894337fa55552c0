"""Helpers of the operators: bytes of Arrow strings, words and hashes as numpy arrays, small aggregates."""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobmill.session import fresh_dir

CHUNK_BYTES = 1 << 20
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93  # odd, so it has an inverse modulo 2**64
_MASK = (1 << 64) - 1
LONG_SPAN = 256
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


BYTE_CODES = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * GOLDEN)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B**i and B**-i modulo 2**64 for i below ``n``, grown on demand and kept for the worker."""
    have = _powers.get("p")
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + 1)
        for name, base in (("p", _BASE), ("i", pow(_BASE, -1, 1 << 64))):
            out = np.ones(1, np.uint64)
            while len(out) < size:  # doubling: no Python loop over positions
                out = np.concatenate([out, out * np.uint64(pow(base, len(out), 1 << 64))])
            _powers[name] = out[:size]
    return _powers["p"], _powers["i"]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and its n + 1 offsets; a null counts as the empty string."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1] if len(column) else np.zeros(1)
    offsets = offsets.astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES):
    """Cut a batch between rows into parts of about ``limit`` bytes of text; a longer text is a part alone."""
    _, offsets = utf8(batch.column(column))
    start = 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1)
        yield batch.slice(start, end - start)
        start = end


def runs(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true bytes; a run ends where its text ends."""
    if not len(mask):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    before = np.empty(len(mask), bool)
    before[0] = False
    before[1:] = mask[:-1]
    firsts = offsets[:-1][offsets[:-1] < len(mask)]
    before[firsts] = False
    after = np.empty(len(mask), bool)
    after[-1] = False
    after[:-1] = mask[1:]
    after[firsts[firsts > 0] - 1] = False
    return np.flatnonzero(mask & ~before), np.flatnonzero(mask & ~after) + 1


class Sums(NamedTuple):
    """Bytes with the running sums of code(byte) * B**position."""

    data: np.ndarray
    sums: np.ndarray


def prefix_sums(data: np.ndarray) -> Sums:
    """Sums from which the hash of any shorter substring follows in two reads."""
    p, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_CODES[data] * p[:len(data)], out=out[1:])
    return Sums(data, out)


def span_hash(within: Sums, starts: np.ndarray, ends: np.ndarray, short: bool = False) -> np.ndarray:
    """64-bit hashes of the substrings [start, end), equal for equal bytes wherever they stand.

    Modulo 2**64, texts of 1,024 bytes can be made to collide whatever the base; substrings from ``LONG_SPAN`` bytes on are therefore
    hashed by themselves, with a cryptographic hash.  ``short`` says that there are none.
    """
    _, inverse = powers(len(within.sums))
    value = (within.sums[ends] - within.sums[starts]) * inverse[starts]
    value = mix(value ^ ((ends - starts).astype(np.uint64) * GOLDEN))
    long = () if short else np.flatnonzero(ends - starts >= LONG_SPAN)
    if len(long):
        raw = memoryview(np.ascontiguousarray(within.data))
        value[long] = [int.from_bytes(hashlib.blake2b(raw[a:b], digest_size=8).digest(), "little") for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)]
    return value


def shrunk(text) -> F.Column:
    """A text column compressed row by row, for joins that move whole texts."""
    @F.arrow_udf("binary")
    def compress(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import zstandard

        tool = zstandard.ZstdCompressor(level=6, write_content_size=True, write_checksum=False)
        for column in batches:
            yield pa.array([None if t is None else tool.compress(t.encode()) for t in column.to_pylist()], pa.binary())
    return compress(text)


def grown(batch: pa.RecordBatch):
    """Slices of a batch whose ``text`` was shrunk, with the texts' bytes back in place."""
    import zstandard

    tool = zstandard.ZstdDecompressor()
    for part in slices(batch, limit=CHUNK_BYTES // 2):
        texts = pa.array([None if t is None else tool.decompress(t) for t in part.column("text").to_pylist()], pa.large_binary())
        yield part.set_column(part.schema.get_field_index("text"), "text", texts)


def release() -> None:
    """Give memory that a finished task no longer uses back to the system; Spark keeps the worker for other tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def table_of(*spans: tuple[int, int]) -> np.ndarray:
    """A table of 256 flags that is true for the given byte ranges, ends included."""
    out = np.zeros(256, bool)
    for lo, hi in spans:
        out[lo:hi + 1] = True
    return out


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder, whose size the optimizer then knows from its files."""
    path = fresh_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def key_long(column) -> F.Column:
    """A row's id as a long for ordering; null sorts before every id."""
    return F.coalesce(column.cast("long"), F.lit(-(1 << 63)))


def conf_parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def picked(df: DataFrame, **columns) -> DataFrame:
    """Only the columns an operator works on, under its own names, so that no other column can clash."""
    return df.select(*[(df[c] if isinstance(c, str) else c).alias(name) for name, c in columns.items()])
