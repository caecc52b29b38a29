"""WARC archives as seekable Zstandard bundles.

A bundle is one file: records are grouped into independent frames of about FRAME bytes, and a skippable frame at the end
holds the seek table of the public seekable format (compressed and plain size of each frame). An index maps record
identifiers to (bundle, frame, offset in the frame, length), so one record is read by decompressing one frame.

Each task writes bundles of its own in a shared folder, under names that no other attempt uses; the index, which Spark
commits, lists those of the attempts that counted. Bundles of failed attempts are never read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_folder, small_batches, table, written

FRAME = 1 << 18
#: A task of the read-back takes the frames of about so many plain bytes.
READ_BYTES = 1 << 25
BUNDLE = 1 << 28
REVISIT_BYTES = 1000
#: Fixed values of the seekable format and of the archive standard.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"


def record_id(page_id: int | None) -> str:
    return f"<urn:x-page:{'none' if page_id is None else page_id}>"


def page_of(identifier: str) -> int | None:
    said = identifier.strip("<>").rsplit(":", 1)[1]
    return None if said == "none" else int(said)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None, revisit: bool = False) -> bytes:
    """A response, or a revisit of the response with the same payload; a revisit has the HTTP headers and no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {quote(url or 'urn:none', safe=':/?#[]@!$&()*+,;=%~')}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(hashlib.sha1(payload).digest()).decode()}",
        *([f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Profile: {REVISIT_PROFILE}"] if revisit else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_records(data: bytes) -> Iterator[tuple[int, dict[str, str], dict[str, str], bytes]]:
    """(offset, archive headers, HTTP headers, payload) of the records in a frame."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        head = dict(line.split(": ", 1) for line in lines[1:])
        n = int(head["Content-Length"])
        block = data[end + 4 : end + 4 + n]
        cut = block.index(b"\r\n\r\n")
        yield at, head, dict(line.split(": ", 1) for line in block[:cut].decode().split("\r\n")[1:]), block[cut + 4 :]
        at = end + 4 + n + 4


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The footer for frames given as (compressed, plain) sizes."""
    body = b"".join(struct.pack("<II", c, d) for c, d in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(file, size: int) -> list[tuple[int, int, int]]:
    """(start, compressed, plain) of each frame, from a seekable file's footer."""
    file.seek(size - 9)
    n, flags, magic = struct.unpack("<IBI", file.read(9))
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    each = 12 if flags & 0x80 else 8
    file.seek(size - 9 - n * each)
    data, out, start = file.read(n * each), [], 0
    for i in range(n):
        c, d = struct.unpack_from("<II", data, i * each)
        out.append((start, c, d))
        start += c
    return out


def read_frame(uri: str, frame: int, tables: dict | None = None) -> bytes:
    fs, path = pafs.FileSystem.from_uri(uri)
    with fs.open_input_file(path) as file:
        known = {} if tables is None else tables
        if uri not in known:
            known[uri] = read_seek_table(file, file.size())
        start, size, plain = known[uri][frame]
        file.seek(start)
        data = zstandard.ZstdDecompressor().decompressobj().decompress(file.read(size))
        if len(data) != plain:
            raise ValueError(f"frame {frame} of {uri} has {len(data)} bytes, not {plain}")
        return data


def read_record(uri: str, frame: int, offset: int, length: int) -> bytes:
    """One record by its place in the index."""
    return read_frame(uri, frame)[offset : offset + length]


class _Bundle:
    def __init__(self, folder: str, level: int):
        self.uri = f"{folder}/bundle-{uuid.uuid4().hex}.warc.zst"
        fs, path = pafs.FileSystem.from_uri(self.uri)
        fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
        self.out, self.zstd = fs.open_output_stream(path, compression=None), zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.frames, self.held, self.size, self.written = [], [], 0, 0

    def add(self, data: bytes) -> tuple[int, int]:
        if self.size and self.size + len(data) > FRAME:
            self.flush()
        place = len(self.frames), self.size
        self.held.append(data)
        self.size += len(data)
        return place

    def flush(self) -> None:
        if self.held:
            packed = self.zstd.compress(b"".join(self.held))
            self.out.write(packed)
            self.frames.append((len(packed), self.size))
            self.written += len(packed)
            self.held, self.size = [], 0

    def close(self) -> None:
        self.flush()
        self.out.write(seek_table(self.frames))
        self.out.close()


INDEX = "page_id bigint, record_id string, record_type string, bundle string, frame bigint, offset bigint, length bigint"


def write_bundles(pages: DataFrame, folder: str, level: int = 3) -> DataFrame:
    """The committed index of the records of pages (page_id, url, html, refers_to, revisit), written below folder. Rows of
    equal page_id have records of equal names, which the index tells apart by their places."""
    names = [f.split()[0] for f in INDEX.split(", ")]

    def run(batches):
        bundle, rows = None, []

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n in ("record_id", "record_type", "bundle") else pa.int64()) for n, c in zip(names, zip(*rows, strict=True), strict=True)], names=names)

        for b in small_batches(batches):
            for page, url, html, refers, again in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to", "revisit")), strict=True):
                if bundle is None or bundle.written > BUNDLE:
                    if bundle is not None:
                        bundle.close()
                        yield batch(rows)  # rows leave when their bundle is whole
                        rows = []
                    bundle = _Bundle(folder, level)
                data = record(page, url, (html or "").encode("utf-8", "surrogatepass"), refers, bool(again))
                frame, offset = bundle.add(data)
                rows.append((page, record_id(page), "revisit" if again else "response", bundle.uri, frame, offset, len(data)))
        if bundle is not None:
            bundle.close()
            yield batch(rows)

    return written(pages.select("page_id", "url", "html", "refers_to", "revisit").mapInArrow(run, INDEX))


def read_bundles(index: DataFrame) -> DataFrame:
    """The records of an index's bundles, frame by frame: (page_id, payload_bytes, payload_digest, record_type, refers_to, bundle, frame, offset).

    Frames are dealt by the bytes that they unpack to, in ranges of bundles, so a task reads neighbouring frames of few files.
    """
    schema = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, bundle string, frame bigint, offset bigint"
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]

    def run(batches):
        tables: dict = {}
        for b in batches:
            for uri, frame in zip(b.column("bundle").to_pylist(), b.column("frame").to_pylist(), strict=True):
                rows = []
                for at, head, http, payload in parse_records(read_frame(uri, frame, tables)):
                    said = base64.b32decode(head["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                    again = head["WARC-Type"] == "revisit"
                    if not again and hashlib.sha1(payload).hexdigest() != said:
                        raise ValueError(f"payload of {head['WARC-Record-ID']} differs from its digest")
                    refers = page_of(head["WARC-Refers-To"]) if again else None
                    rows.append((page_of(head["WARC-Record-ID"]), int(http["Content-Length"]) if again else len(payload), said, head["WARC-Type"], refers, uri, frame, at))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[f.split()[0] for f in schema.split(", ")])

    # an explicit number of ranges, which Spark does not merge: the rows are few and short, the frames they name are not
    total = index.agg(F.sum("length")).first()[0] or 0
    tasks = max(-(-total // READ_BYTES), index.sparkSession.sparkContext.defaultParallelism)
    frames = index.select("bundle", "frame").distinct().repartitionByRange(tasks, "bundle", "frame")
    return frames.mapInArrow(run, schema)


def revisits(pages: DataFrame, least_bytes: int = REVISIT_BYTES) -> DataFrame:
    """pages (page_id, url, html) with refers_to and revisit: of equal payloads of least_bytes or more the largest page_id
    answers and the others refer to it. Decisions are made on ids and digests alone; payloads are dealt by page_id."""
    digest = F.sha1(F.coalesce(F.col("html"), F.lit("")).cast("binary"))
    size = F.octet_length(F.coalesce(F.col("html"), F.lit("")))
    light = pages.select("page_id", digest.alias("d_"), size.alias("n_")).filter(F.col("n_") >= least_bytes)
    light = written(light)
    groups = light.groupBy("d_", "n_").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("k_")).filter("k_ > 1 and refers_to is not null").select("d_", "n_", "refers_to")
    again = light.join(groups, ["d_", "n_"]).filter(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select(F.col("page_id").alias("p_"), "d_", "refers_to").distinct()
    own = pages.select("page_id", "url", "html", digest.alias("own_"))
    joined = own.join(again, F.col("page_id").eqNullSafe(F.col("p_")) & (F.col("own_") == F.col("d_")), "left")
    return joined.select("page_id", "url", "html", "refers_to", F.col("d_").isNotNull().alias("revisit"))


def archive(pages: DataFrame, folder: str | None = None, level: int = 3) -> DataFrame:
    """The index of an archive of pages (page_id, url, html), in folder or a new shared one.

    Null html is an empty payload; a null page_id or url is kept as such; repeated rows each give a record, all of them
    responses if they have the largest page_id; an empty table gives an empty index. Other columns are not read.
    """
    return write_bundles(revisits(pages), folder or shared_folder(pages.sparkSession), level)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to bundles and read back."""
    index = archive(table(spark, sf_dir, "pages"))
    return read_bundles(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP6_SQL = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS last_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= {REVISIT_BYTES} AND page_id <> last_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= {REVISIT_BYTES} AND page_id <> last_id THEN last_id END AS refers_to
FROM m
"""
