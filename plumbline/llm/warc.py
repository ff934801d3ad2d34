"""WARC archives with a Zstandard dictionary, written and read by Spark tasks.

A task buffers records up to an archive's size, trains a dictionary on them, embeds it in a
leading skippable frame and compresses every record into a frame of its own, so records can be
read by offset. A payload that was archived already under a smaller id becomes a revisit record.
Tasks name archives by attempt and return manifest rows; only archives in the manifest of
successful tasks are read, so retried or lost tasks leave nothing behind that counts.

Defined results: a null payload is empty, a null url is empty; of equal payloads of at least
``min_revisit_bytes`` bytes the row with the smallest id is the response (all rows of that id, if
it repeats) and the others revisit it; null ids come last, and are responses if no id is known;
an empty table writes no archive and reads back empty.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import read, shared_folder, stored

#: Record bytes in an archive, and of its dictionary.
ARCHIVE_BYTES = 8 << 20
DICT_BYTES = 32 << 10
#: Record bytes that the dictionary is trained on, spread over the archive.
TRAIN_BYTES = 1 << 20
PIECE = 4 << 10
VERSION = b"WARC/1.1\r\n"
LEVEL = 3
#: Archives carry this date in every record, so that reruns write the same bytes.
DATE = "1970-01-01T00:00:00Z"

# Fixed values of the formats.
SKIPPABLE = 0x184D2A5D
ID_PREFIX = "urn:plumbline:page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = b"\r\n"


def with_revisits(pages: DataFrame, id_col: str, payload_col: str, min_revisit_bytes: int = 0) -> DataFrame:
    """``pages`` with _payload (binary), _sha1 (hex) and _refers (the smallest id with that payload, else null)."""
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    hashed = pages.withColumn("_payload", payload).withColumn("_sha1", F.sha1("_payload"))
    large = F.octet_length("_payload") >= min_revisit_bytes
    firsts = hashed.where(large).groupBy("_sha1").agg(F.min(id_col).alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    # stored, so that the join reads two plain exchanges and Spark can split a hot payload's rows
    firsts = stored(firsts.select(F.col("_sha1").alias("_s"), "_first"), "warc-firsts")
    joined = hashed.join(firsts, F.col("_sha1") == F.col("_s"), "left").drop("_s")
    return joined.withColumn("_refers", F.when(~F.col("_first").eqNullSafe(F.col(id_col)), F.col("_first"))).drop("_first")


def record(page_id: int | None, url: str, payload: bytes | None, size: int, sha1_hex: str, refers: int | None) -> bytes:
    """A response record, or a revisit of ``refers`` that leaves the payload out."""
    digest = base64.b32encode(bytes.fromhex(sha1_hex)).decode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = http if refers is not None else http + (payload or b"")
    fields = [
        ("WARC-Type", "response" if refers is None else "revisit"),
        ("WARC-Record-ID", f"<{ID_PREFIX}{'' if page_id is None else page_id}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", url.replace("\r", "").replace("\n", "")),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if refers is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{ID_PREFIX}{refers}>")]
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", len(block))])
    return VERSION + head.encode() + CRLF + block + CRLF + CRLF


def archive(records: list[bytes]) -> bytes:
    """The bytes of one archive: dictionary frame, then a frame for each record."""
    import zstandard

    raw = _dictionary(records)
    dictionary = zstandard.ZstdCompressionDict(raw)
    packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_checksum=True)
    return b"".join([struct.pack("<II", SKIPPABLE, len(raw)) + raw, *(packer.compress(r) for r in records)])


def _dictionary(records: list[bytes]) -> bytes:
    """A dictionary trained on pieces spread evenly over all bytes of the records; where these are too few or too uniform to train on, the dictionary is the records' heads themselves."""
    import zstandard

    ends = list(accumulate(map(len, records)))
    every = max(PIECE, ends[-1] * PIECE // TRAIN_BYTES) if ends else PIECE
    samples, next_at = [], 0
    for r, end in zip(records, ends, strict=True):
        while next_at < end:
            at = next_at - (end - len(r))
            samples.append(r[at : at + PIECE])
            next_at += every
    try:
        return zstandard.train_dictionary(min(DICT_BYTES, max(256, sum(map(len, samples)) // 8)), samples, k=512, d=8).as_bytes()
    except zstandard.ZstdError:
        share = max(64, DICT_BYTES // max(len(records), 1))
        # what every record begins with stands first: no head is taken for a trained dictionary's mark, and none is too short
        return VERSION + b"".join(dict.fromkeys(r[:share] for r in records))[:DICT_BYTES]


def records_of(data: bytes) -> Iterator[bytes]:
    """The records of an archive's bytes, in order."""
    import zstandard

    at, dictionary = 0, None
    view = memoryview(data)
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == SKIPPABLE:
        size = struct.unpack_from("<I", data, 4)[0]
        dictionary = zstandard.ZstdCompressionDict(bytes(view[8 : 8 + size]))
        at = 8 + size
    reader = zstandard.ZstdDecompressor(dict_data=dictionary)
    while at < len(data):
        frame, parts = reader.decompressobj(), []
        while not frame.eof:
            piece = view[at : at + 16384]
            if not len(piece):
                raise ValueError("the archive ends within a record")
            parts.append(frame.decompress(piece))
            at += len(piece) - len(frame.unused_data)
        yield b"".join(parts)


def parse(raw: bytes) -> dict:
    """A record's page_id, url, type, digest, refers_to, payload and the payload's length."""
    head, _, rest = raw.partition(CRLF + CRLF)
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(CRLF + CRLF)
    length = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not have its digest")
    number = lambda x: int(x) if (x := x.strip("<>").removeprefix(ID_PREFIX)) else None
    return {
        "page_id": number(fields["WARC-Record-ID"]), "url": fields["WARC-Target-URI"], "payload_bytes": length, "payload_digest": digest,
        "record_type": kind, "refers_to": number(fields["WARC-Refers-To"]) if kind == "revisit" else None, "payload": payload if kind == "response" else None,
    }


def write_archives(
    pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", archive_bytes: int = ARCHIVE_BYTES, min_revisit_bytes: int = 0
) -> DataFrame:
    """Archives of all rows under ``folder`` (a URI that tasks can write to); returns the stored manifest (name, records, bytes)."""
    rows = with_revisits(pages.select(id_col, url_col, payload_col), id_col, payload_col, min_revisit_bytes)
    rows = rows.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), F.when(F.col("_refers").isNull(), F.col("_payload")).alias("payload"), F.octet_length("_payload").alias("size"), "_sha1", F.col("_refers").cast("bigint").alias("refers"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)

        def put(records: list[bytes]) -> pa.RecordBatch:
            name = f"{uuid.uuid4().hex}.warc.zst"
            data = archive(records)
            with store.open_output_stream(f"{base}/{name}", compression=None) as out:
                out.write(data)
            return pa.RecordBatch.from_pydict({"name": [name], "records": pa.array([len(records)], pa.int64()), "bytes": pa.array([len(data)], pa.int64())})

        held, size = [], 0
        for b in batches:
            for x in b.to_pylist():
                raw = record(x["id"], x["url"], x["payload"], x["size"], x["_sha1"], x["refers"])
                held.append(raw)
                size += len(raw)
                if size >= archive_bytes:
                    yield put(held)
                    held, size = [], 0
        if held:
            yield put(held)

    return stored(rows.mapInArrow(write, "name string, records bigint, bytes bigint"), "warc-manifest")


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """Every record of the manifest's archives: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload."""
    spark = manifest.sparkSession
    files = spark.read.schema("path string, modificationTime timestamp, length bigint, content binary").format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder)
    known = manifest.select("name")
    chosen = files.withColumn("name", F.element_at(F.split("path", "/"), -1)).join(known, "name", "left_semi").select("content")
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0):
                rows = []
                for raw in records_of(data.as_py()):
                    rows.append(parse(raw))
                    if len(rows) == 256:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return chosen.mapInArrow(unpack, "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/plumbline/warc-{uuid.uuid4().hex}"
    manifest = write_archives(read(spark, sf_dir, "pages"), folder)
    if not manifest.take(1):
        return spark.createDataFrame([], "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")
    return read_archives(manifest, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
