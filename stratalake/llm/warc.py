"""WARC archives whose records are Zstandard frames that share a dictionary in a leading skippable frame."""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalake.core.storage import fresh_path, materialize

#: Fixed values of the .warc.zst convention: the magic number of the skippable frame that holds the dictionary.
SKIPPABLE_MAGIC = 0x184D2A5D
#: Bytes of sampled records from which the dictionary is built, its size, and the size at which a task starts another archive.
SAMPLE_BYTES, DICTIONARY_BYTES, ARCHIVE_BYTES = 4 << 20, 64 << 10, 8 << 20
#: The date of records whose pages tell none.
EPOCH = "1970-01-01T00:00:00Z"

_FIELDS = {"record_id": pa.string(), "date": pa.string(), "page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "body": pa.binary()}


def payload_digest(payload: bytes) -> str:
    """Bare upper-case base32 of SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _header_value(text: str) -> str:
    """Line breaks and controls can't stand in a header; they are percent-encoded, as is the per cent sign before them."""
    return re.sub(r"[\x00-\x1F\x7F]|%(?=0|1|7F)", lambda m: f"%{ord(m[0]):02X}", text)


def _unheader(text: str) -> str:
    return re.sub(r"%(0[0-9A-F]|1[0-9A-F]|7F|25)", lambda m: chr(int(m[1], 16)), text)


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, record_id: str | None = None, date: str = EPOCH) -> bytes:
    """One WARC/1.1 record: a response with the payload, or a revisit that names the response and has no payload."""
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{record_id or f'urn:page:{page_id}'}>", f"WARC-Date: {date}"]
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if url is not None:
        lines.append(f"WARC-Target-URI: {_header_value(url)}")
    lines += [f"WARC-Payload-Digest: sha1:{payload_digest(payload)}", f"X-Payload-Length: {len(payload)}"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        payload = b""
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + payload + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """The headers and the body of a record. A response's digest and size are the body's own; a ValueError if the header
    says otherwise. Of a revisit, that has no body, they are what its headers tell."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    size = int(fields["Content-Length"])
    body, told = rest[:size], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    response = fields["WARC-Type"] == "response"
    if len(body) != size or rest[size:] != b"\r\n\r\n" or (response and (payload_digest(body), size) != (told, int(fields["X-Payload-Length"]))):
        raise ValueError(f"the record {fields['WARC-Record-ID']} isn't what its headers say")
    return {
        "record_id": fields["WARC-Record-ID"].strip("<>"),
        "date": fields["WARC-Date"],
        "page_id": int(fields["X-Page-ID"]) if "X-Page-ID" in fields else None,
        "url": _unheader(fields["WARC-Target-URI"]) if "WARC-Target-URI" in fields else None,
        "payload_bytes": size if response else int(fields["X-Payload-Length"]),
        "payload_digest": payload_digest(body) if response else told,
        "record_type": fields["WARC-Type"],
        "refers_to": int(fields["WARC-Refers-To"].removeprefix("<urn:page:").rstrip(">")) if "WARC-Refers-To" in fields else None,
        "body": body,
    }


def dictionary_frame(dictionary: bytes) -> bytes:
    """The skippable frame that opens an archive; empty where there is no dictionary."""
    return struct.pack("<II", SKIPPABLE_MAGIC, len(dictionary)) + dictionary


def read_archive(content: bytes) -> Iterator[bytes]:
    """The records of an archive, each from a frame of its own."""
    magic, size = struct.unpack_from("<II", content)
    if magic != SKIPPABLE_MAGIC:
        raise ValueError("the archive doesn't begin with a dictionary frame")
    own = zstandard.ZstdCompressionDict(content[8 : 8 + size]) if size else None
    reader = zstandard.ZstdDecompressor(dict_data=own)
    rest = memoryview(content)[8 + size :]
    while len(rest):
        one = reader.decompressobj()
        yield one.decompress(rest)
        rest = rest[len(rest) - len(one.unused_data) :]


def train_dictionary(records: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A Zstandard dictionary of records; empty if they are too few or too short to train one."""
    try:
        return zstandard.train_dictionary(size, records).as_bytes()
    except zstandard.ZstdError:
        return b""


def _sample(pages: DataFrame, most: int) -> list[bytes]:
    """Records of some `most` bytes in all, drawn by a hash of the page; a record counts up to 1 / 32 of them."""
    total, n = pages.agg(F.sum(F.octet_length("html")), F.count("*")).first()
    part = min(1.0, most / max(1, total or 0))
    drawn = pages.where(F.pmod(F.xxhash64("page_id", "url"), F.lit(1 << 20)) < F.lit(part * (1 << 20)))
    cut = drawn.select("page_id", "url", F.substring(F.col("html").cast("binary"), 1, most // 32).alias("html")).limit(int(2 * part * n) + 64)
    return [record_bytes(r["page_id"], r["url"], bytes(r["html"] or b""), None) for r in sorted(cut.collect(), key=lambda r: (r["page_id"] is None, r["page_id"] or 0, r["url"] or ""))]


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0, sample_bytes: int = SAMPLE_BYTES, dictionary_bytes: int = DICTIONARY_BYTES, archive_bytes: int = ARCHIVE_BYTES, level: int = 3, date: str = EPOCH) -> DataFrame:
    """Writes a record for each page to .warc.zst files under path; returns a row (file, records) for each file.

    Of records with equal payloads of `least` bytes or more, those with the largest page_id are responses and the
    others, with smaller or null ids, revisit it. Only digests are grouped; a payload travels once, to its archive. Every
    record bears the date. A record's id is its page's; those of a page_id and payload that several rows have, and of null
    page_ids, end in the archive's name and their number there, so no two are equal.

    An archive's final name holds the attempt that wrote it, and only those that the table of files lists count: an
    attempt that is lost, or runs beside another, leaves files that nobody reads. Null html is an empty payload. An empty
    table writes nothing.
    """
    spark = pages.sparkSession
    named = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    dictionary = train_dictionary(_sample(named, sample_bytes), dictionary_bytes)
    digest = F.sha1(F.coalesce(F.col("html"), F.lit("")).cast("binary"))
    keyed = named.withColumn("digest", digest).withColumn("size", F.coalesce(F.octet_length("html"), F.lit(0)))
    # Each page_id of a payload, then each payload: the largest page_id, and whether several rows have that.
    pages_of = keyed.select("digest", "page_id", "size").where(F.col("size") >= least).groupBy("digest", "page_id").agg(F.count("*").alias("rows"))
    top = pages_of.groupBy("digest").agg(F.max("page_id").alias("top"), F.max(F.struct("page_id", "rows"))["rows"].alias("tops"))
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("top")), F.col("top"))
    # Without a bound on revisits' size nobody has counted the rows of small payloads: they count as several.
    laid = keyed.join(top, "digest", "left").select("page_id", "url", "html", refers.alias("refers_to"), (F.coalesce("tops", F.lit(2)) == 1).alias("single"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex
        store, root = pa.fs.FileSystem.from_uri(path)
        store.create_dir(root, recursive=True)
        pack = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        files: list[tuple[str, int]] = []
        out, size, n = None, 0, 0

        def name() -> str:
            return f"part-{part:06d}-{len(files):05d}-{attempt}.warc.zst"

        def close() -> None:
            nonlocal out, size, n
            out.close()
            store.move(f"{root}/.{name()}", f"{root}/{name()}")
            files.append((name(), n))
            out, size, n = None, 0, 0

        for batch in batches:
            for page_id, url, html, refers_to, single in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    out = store.open_output_stream(f"{root}/.{name()}", compression=None)
                    out.write(dictionary_frame(dictionary))
                own = f"urn:page:{page_id}" if single and refers_to is None and page_id is not None else f"urn:page:{page_id}:{name()}:{n}"
                frame = pack.compress(record_bytes(page_id, url, (html or "").encode("utf-8", "surrogatepass"), refers_to, own, date))
                out.write(frame)
                size, n = size + len(frame), n + 1
                if size >= archive_bytes:
                    close()
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in files], pa.string()), pa.array([k for _, k in files], pa.int64())], ["file", "records"])

    return materialize(laid.mapInArrow(run, "file string, records long"), "warc-files")


def read_archives(files: DataFrame, path: str) -> DataFrame:
    """A row for each record of the archives that write_archives listed: its headers and its body, from which a response's
    size and digest are reckoned."""
    spark = files.sparkSession
    schema = "record_id string, date string, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, body binary"
    if not files.take(1):
        return spark.createDataFrame([], schema)
    found = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.warc.zst").load(path)
    listed = found.withColumn("file", F.element_at(F.split("path", "/"), -1)).join(files.select("file"), "file", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in _FIELDS.items()], list(_FIELDS))
        for batch in batches:
            for content in batch.column(0):
                rows: list[dict] = []
                held = 0
                for raw in read_archive(content.as_py()):
                    rows.append(parse_record(raw))
                    held += len(raw)
                    if held > 4 << 20:
                        yield batch_of(rows)
                        rows, held = [], 0
                yield batch_of(rows)

    return listed.select("content").mapInArrow(run, schema)


def archive_digest(pages: DataFrame, **options) -> DataFrame:
    """Writes pages to fresh archives and reads them back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    All of it comes from the archives: a response's size and digest from its body, a revisit's from the response that it
    refers to, whose digest has to be the one that the revisit's header tells."""
    path = fresh_path(pages.sparkSession, "warc")
    read = read_archives(write_archives(pages, path, **options), path)
    records = materialize(read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"), "warc-records")
    responses = records.where("record_type = 'response'")
    wanted = records.where("record_type = 'revisit'")
    # Several rows of one page_id can be responses to one payload.
    originals = responses.where("page_id IS NOT NULL").groupBy(F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("of_digest")).agg(F.max("payload_bytes").alias("of_bytes"))
    same = (wanted["refers_to"] == originals["refers_to"]) & (wanted["payload_digest"] == originals["of_digest"])
    known = F.when(F.col("of_digest").isNull(), F.raise_error(F.lit("a revisit's response isn't in the archives"))).otherwise(F.col("of_bytes"))
    revisits = wanted.join(originals, same, "left").select("page_id", known.cast("long").alias("payload_bytes"), F.coalesce("of_digest", "payload_digest").alias("payload_digest"), "record_type", wanted["refers_to"])
    return responses.unionByName(revisits)
