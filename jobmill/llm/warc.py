"""WARC archives: one gzip member per record, written by Spark's own committer and read sequentially.

``write_archives`` renders a record per page in Arrow-fed tasks and hands the finished gzip members to Spark's text writer,
so archives appear through the normal task commit in any store Spark can reach and a lost executor leaves no
half-written file.  The writer ends each row with one separator byte.  The last byte of a gzip member is the
top byte of its length field, which is zero below 16 MiB: the member goes out without it and the separator is
that byte.  A record of 16 MiB or more is followed by an empty member, whose last byte is zero as well.

``read_archives`` opens the files through Spark, walks each one with an incremental inflater, frames records by
their content length, and compares block and payload digests.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobmill.llm.common import picked
from jobmill.session import checkpointed, fresh_dir

LEAST_SHARED = 100  # payloads below this are always written out
STEP = 1 << 16
LEVEL = 4
READ_SCHEMA = ("page_id long, record_id string, uri string, record_type string, refers_to long, payload_bytes long, "
               "payload_digest string, payload binary, block_ok boolean, payload_ok boolean")


def _header(value: str) -> str:
    """A header value must stay on its line."""
    return value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def _unheader(value: str) -> str:
    return value.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def _b32(digest: bytes) -> str:
    return "sha1:" + base64.b32encode(digest).decode()


def render(page_id, uri, payload: bytes | None, digest: str, size: int, refers_to) -> bytes:
    """One WARC/1.1 record; a revisit has an empty block and names the record it repeats."""
    block = payload or b""
    kind = "revisit" if refers_to is not None else "response"
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
             "WARC-Date: 1970-01-01T00:00:00Z", "Content-Type: text/html; charset=utf-8"]
    if uri is not None:
        lines.append(f"WARC-Target-URI: {_header(uri)}")
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += [f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {size}", f"WARC-Block-Digest: {_b32(hashlib.sha1(block).digest())}",
              f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(record: bytes) -> bytes:
    """The record as one gzip member whose last byte is zero (see the module text)."""
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    out = packer.compress(record) + packer.flush()
    if out[-1]:
        empty = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
        out += empty.flush()
    return out


def _render_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = [batch.column(i) for i in range(batch.num_columns)]
        out, held = [], 0
        for i in range(batch.num_rows):
            page_id, uri, html, digest, size, refers = (c[i].as_py() for c in columns)
            out.append(member(render(page_id, uri, None if refers is not None else (html or "").encode(), digest, size, refers))[:-1])
            held += len(out[-1])
            if held > 8 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])
                out, held = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])


def with_revisits(pages: DataFrame, least: int = LEAST_SHARED) -> DataFrame:
    """Pages with their payload digest, size, and the page they repeat (null unless they are a revisit).

    Of equal payloads of ``least`` bytes or more the smallest page_id is the response.  The digests that occur more
    than once are counted with map-side combining and written out before the join, so both join sides are plain
    exchanges and adaptive execution may split a payload shared by a third of all pages.  Rows without a page_id, and
    further rows of the response's own page_id, are responses.
    """
    size = F.coalesce(F.octet_length("html"), F.lit(0)).cast("long")
    facts = pages.select("page_id", "url", "html", size.alias("size"), F.sha2(F.encode(F.coalesce("html", F.lit("")), "UTF-8"), 256).alias("digest"))
    shared = (facts.where((F.col("size") >= least) & F.col("page_id").isNotNull()).groupBy("digest")
              .agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first_id"))
    joined = facts.join(checkpointed(shared), "digest", "left")
    return joined.withColumn("refers_to", F.when((F.col("first_id") < F.col("page_id")) & (F.col("size") >= least), F.col("first_id")))


def write_archives(pages: DataFrame, path: str, least: int = LEAST_SHARED, records_per_file: int = 50_000) -> None:
    """Write one record per page below ``path``; the files are plain multi-member gzip WARC archives.

    Null html is an empty payload, a null url leaves the target out, a null page_id leaves the number out of the
    record id; repeated rows give repeated records; an empty table gives an archive without records.
    """
    ready = with_revisits(picked(pages, page_id="page_id", url="url", html="html"), least)
    rendered = ready.select("page_id", "url", F.when(F.col("refers_to").isNull(), F.col("html")).alias("html"), "digest", "size", "refers_to")
    (rendered.mapInArrow(_render_batches, "record binary").select(F.col("record").cast("string").alias("value"))
     .write.option("lineSep", "\x00").option("compression", "none").option("maxRecordsPerFile", records_per_file).text(path))


class BadArchive(ValueError):
    """The bytes are not a sequence of whole gzip members with whole records."""


def members(blob: bytes) -> Iterator[bytes]:
    """Inflate a file step by step; every gzip member is yielded once it ends."""
    at, view = 0, memoryview(blob)
    while at < len(view):
        inflater, parts = zlib.decompressobj(31), []
        while not inflater.eof:
            piece = view[at:at + STEP]
            if not len(piece):
                raise BadArchive("a gzip member ends early")
            parts.append(inflater.decompress(piece))
            at += len(piece)
        at -= len(inflater.unused_data)
        yield b"".join(parts)


def parse(record: bytes) -> dict:
    """One record, framed by its Content-Length, with both digests checked."""
    head, gap, rest = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not gap or not lines[0].startswith("WARC/"):
        raise BadArchive("no WARC header")
    fields = {}
    for line in lines[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    size = int(fields["content-length"])
    block = rest[:size]
    if len(block) != size or rest[size:] != b"\r\n\r\n":
        raise BadArchive("the block does not have its stated length")
    number = lambda text: int(text[len("<urn:page:"):-1]) if text and text != "<urn:page:>" else None
    digest = fields["warc-payload-digest"].removeprefix("sha256:")
    kind = fields["warc-type"]
    return {"page_id": number(fields["warc-record-id"]), "record_id": fields["warc-record-id"], "uri": _unheader(fields["warc-target-uri"]) if "warc-target-uri" in fields else None,
            "record_type": kind, "refers_to": number(fields.get("warc-refers-to")), "payload_bytes": int(fields["x-payload-length"]), "payload_digest": digest,
            "payload": None if kind == "revisit" else block, "block_ok": _b32(hashlib.sha1(block).digest()) == fields["warc-block-digest"],
            "payload_ok": None if kind == "revisit" else hashlib.sha256(block).hexdigest() == digest and size == int(fields["x-payload-length"])}


def _reader(keep_payload: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("record_id", pa.string()), ("uri", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
                            ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()), ("block_ok", pa.bool_()), ("payload_ok", pa.bool_())])
        for batch in batches:
            for blob in batch.column(0):
                rows, held = [], 0
                for record in members(blob.as_buffer()):
                    if not record:
                        continue
                    row = parse(record)
                    held += len(row["payload"] or b"") if keep_payload else 200
                    rows.append(row if keep_payload else row | {"payload": None})
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)
    return read


def read_archives(spark: SparkSession, path: str, keep_payload: bool = True) -> DataFrame:
    """All records below ``path``; a damaged archive raises, a wrong digest shows in block_ok or payload_ok."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.where("length > 0").select("content").mapInArrow(_reader(keep_payload), READ_SCHEMA)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all pages to archives in the shared folder, read them back and return what the records say."""
    path = fresh_dir(spark, "warc")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    back = read_archives(spark, path, keep_payload=False)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "block_ok", "payload_ok")


SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY 1)
SELECT p.page_id, p.payload_bytes, p.payload_digest, CASE WHEN f.first_id < p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN f.first_id < p.page_id THEN f.first_id END AS refers_to, true AS block_ok, CASE WHEN f.first_id < p.page_id THEN NULL ELSE true END AS payload_ok
FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest AND p.payload_bytes >= 100
"""
