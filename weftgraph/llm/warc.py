"""WARC archives compressed with Zstandard and a dictionary: a writer and a reader.

File format (``.warc.zst``): a skippable frame with magic number 0x184D2A5D whose content is the dictionary, itself a
Zstandard frame or raw; then one Zstandard frame for each record, compressed with that dictionary. The writer puts one
``warcinfo`` record first. Frames are found by walking over block headers, so a record is decoded alone and memory holds one
record at a time.

Writer: each task writes files of its own, named at random, and tells their paths and numbers of records; only told files
belong to the archive, so a task that was lost and run again leaves a file behind that nobody reads. Of records with equal
payloads the one with the largest page_id is the response; the others are revisits that hold no payload. Payloads
are compared by SHA-256. Which records revisit is found without moving payloads: only what payloads occur twice is joined,
by broadcast up to ``BROADCAST_ROWS`` rows and by a shuffle beyond.

Reader: checks magic numbers, frame lengths, the version line, mandatory and repeated fields, Content-Length against the
frame, the end of the record, block and payload digests. What fails raises ``WarcError``, or becomes a row with ``error``
if the reader isn't strict. ``resolved`` joins revisits to their responses and raises if one is missing or differs.

Defined cases: a null payload is the empty one; rows tie on page_id by url, and rows equal in both and in their payload are all
responses; a row with a null page_id comes before all others; a null url leaves Target-URI out, and characters that
a header can't hold are percent-encoded; an empty table gives an archive without files. Columns other than those named
aren't read. A record must fit a worker's memory, whatever its length.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.common import join_unique, materialise, shared_dir, slices

# Fixed values of the formats.
DICTIONARY_FRAME, RAW_DICTIONARY, FRAME = 0x184D2A5D, 0xEC30A437, 0xFD2FB528
VERSION = re.compile(rb"WARC/1\.[01]")
MANDATORY = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_TYPE = "application/http; msgtype=response"

LEVEL = 3
#: Rows the dictionary is trained on (the first that Spark reads; they bear on the archive's size alone), their total and its size.
DICTIONARY_ROWS, SAMPLE_BYTES, DICTIONARY_BYTES = 400, 8 << 20, 64 << 10
#: A new file begins after so many bytes.
FILE_BYTES = 128 << 20
BROADCAST_ROWS = 1 << 17
CHUNK = 1 << 20


class WarcError(ValueError):
    pass


def digest(data: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _field(value: str) -> str:
    return "".join(c if "!" <= c <= "~" and c not in "<>" else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in value)


def record(kind: str, record_id: str, date: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = [("WARC-Type", kind), ("WARC-Record-ID", record_id), ("WARC-Date", date), *fields, ("WARC-Block-Digest", f"sha1:{digest(block)}"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def http_block(payload: bytes, shown: bytes) -> bytes:
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + shown


def train(samples: list[bytes]) -> bytes:
    """A dictionary for records like the samples; empty if there are too few to learn from."""
    kept, size = [], 0
    for s in samples:
        if size + len(s) <= SAMPLE_BYTES:
            kept.append(s)
            size += len(s)
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, size // 8), kept).as_bytes() if size else b""
    except zstandard.ZstdError:
        return b""


class ArchiveWriter:
    def __init__(self, stream, dictionary: bytes):
        self.stream, self.records, self.size = stream, 0, 0
        if dictionary:
            packed = zstandard.ZstdCompressor(level=19).compress(dictionary)
            self._put(struct.pack("<II", DICTIONARY_FRAME, len(packed)) + packed)
        self.packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None, write_checksum=True)

    def _put(self, data: bytes) -> None:
        self.stream.write(data)
        self.size += len(data)

    def add(self, data: bytes) -> None:
        self._put(self.packer.compress(data))
        self.records += 1


class _Source:
    """Bytes of a stream by exact length."""

    def __init__(self, stream):
        self.stream, self.data, self.at = stream, b"", 0

    def peek(self, ahead: int, n: int) -> bytes:
        """n bytes from ``ahead`` bytes on, or fewer at the end."""
        while len(self.data) - self.at < ahead + n:
            more = self.stream.read(max(CHUNK, ahead + n))
            if not more:
                break
            self.data, self.at = self.data[self.at :] + more, 0
        return self.data[self.at + ahead : self.at + ahead + n]

    def take(self, n: int) -> bytes:
        found = self.peek(0, n)
        if len(found) < n:
            raise WarcError(f"the file ends within a frame, {n - len(found)} bytes early")
        self.at += n
        return found


def frame_length(source: _Source) -> int:
    """Bytes of the Zstandard frame that begins here, from its header and those of its blocks."""
    head = source.peek(0, 18)
    try:
        at = zstandard.frame_header_size(head)
        checksum = zstandard.get_frame_parameters(head).has_checksum
    except (zstandard.ZstdError, ValueError) as e:
        raise WarcError(f"no frame header: {e}") from None
    last = False
    while not last:
        block = source.peek(at, 3)
        if len(block) < 3:
            raise WarcError("the file ends within a frame")
        bits = int.from_bytes(block, "little")
        last, kind, size = bool(bits & 1), bits >> 1 & 3, bits >> 3
        if kind == 3:
            raise WarcError("a block of a reserved type")
        at += 3 + (1 if kind == 1 else size)
    return at + 4 * checksum


def frames(stream) -> Iterator[tuple[int, bytes]]:
    """Offset and content of every data frame. The dictionary is that of the leading skippable frame, if there is one."""
    source, offset, unpacker = _Source(stream), 0, zstandard.ZstdDecompressor()
    while head := source.peek(0, 8):
        if len(head) < 8:
            raise WarcError(f"{len(head)} bytes at offset {offset} are no frame")
        magic, size = struct.unpack("<II", head)
        if magic & 0xFFFFFFF0 == DICTIONARY_FRAME & 0xFFFFFFF0:
            content = source.take(8 + size)[8:]
            if not offset and magic == DICTIONARY_FRAME:
                if content[:4] == struct.pack("<I", FRAME):
                    content = unpacker.decompressobj().decompress(content)
                if content[:4] != struct.pack("<I", RAW_DICTIONARY):
                    raise WarcError("the leading skippable frame holds no dictionary")
                unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content))
            offset += 8 + size
        elif magic == FRAME:
            try:
                packed = source.take(frame_length(source))
                content = unpacker.decompressobj().decompress(packed)
            except (WarcError, zstandard.ZstdError) as e:
                raise WarcError(f"frame at offset {offset}: {e}") from None
            yield offset, content
            offset += len(packed)
        else:
            raise WarcError(f"magic number {magic:#x} at offset {offset}")


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Fields by lower-case name, and the block, of a record that fills its frame."""
    end = data.find(b"\r\n\r\n")
    lines = data[: max(end, 0)].split(b"\r\n")
    if end < 0 or not VERSION.fullmatch(lines[0]):
        raise WarcError("no version line or no end of the header")
    fields: dict[str, str] = {}
    name = ""
    for line in lines[1:]:
        if line[:1] in (b" ", b"\t") and name:  # a folded line
            fields[name] += " " + line.strip().decode("utf-8", "replace")
            continue
        key, colon, value = line.partition(b":")
        name = key.decode("utf-8", "replace").lower()
        if not colon or not name or re.search(r"\s", name):
            raise WarcError(f"header line {line[:40]!r}")
        if name in fields and name != "warc-concurrent-to":
            raise WarcError(f"field {name} is repeated")
        fields[name] = value.strip().decode("utf-8", "replace")
    for need in MANDATORY:
        if need.lower() not in fields:
            raise WarcError(f"field {need} is missing")
    if not re.fullmatch(r"[0-9]+", fields["content-length"], re.ASCII):
        raise WarcError("Content-Length is no number")
    block, said = data[end + 4 : -4], int(fields["content-length"])
    if len(data) < end + 8 or data[-4:] != b"\r\n\r\n" or len(block) != said:
        raise WarcError(f"Content-Length {said}, but the block has {max(0, len(data) - end - 8)} bytes")
    _check(fields.get("warc-block-digest"), block, "block")
    return fields, block


def _check(said: str | None, data: bytes, what: str) -> str | None:
    """The bare digest of a field, after comparing it with the data where its algorithm is known."""
    if said is None:
        return None
    algorithm, _, value = said.rpartition(":")
    if algorithm.lower() == "sha1" and value != digest(data):
        raise WarcError(f"the {what} digest differs")
    return value


ROW = "path string, offset long, record_type string, record_id string, url string, page_id long, refers_to_id string, payload_bytes long, payload_digest string, payload binary, error string"


def row(path: str, offset: int, data: bytes) -> dict:
    """A record as a row of ``ROW``. A revisit has the length and digest of the full payload and no payload."""
    fields, block = parse(data)
    kind, head, body, size = fields["warc-type"], b"", block, len(block)
    if fields.get("content-type", "").lower().startswith("application/http"):
        head, gap, body = block.partition(b"\r\n\r\n")
        if not gap:
            raise WarcError("no end of the HTTP header")
        size = len(body)
        said = re.search(rb"(?im)^content-length:[ \t]*([0-9]+)[ \t]*\r?$", head)
        if kind == "revisit":
            size = int(said[1]) if said else None
        elif said and int(said[1]) != size:
            raise WarcError(f"HTTP Content-Length {int(said[1])}, but the payload has {size} bytes")
    value = fields.get("warc-payload-digest")
    shown = value.rpartition(":")[2] if kind == "revisit" and value else _check(value, body, "payload")
    if kind == "revisit" and (not shown or "warc-refers-to" not in fields):
        raise WarcError("a revisit without payload digest or Refers-To")
    page = fields.get("page-id")
    return {"path": path, "offset": offset, "record_type": kind, "record_id": fields["warc-record-id"], "url": fields.get("warc-target-uri"), "page_id": int(page) if page and re.fullmatch(r"-?\d+", page, re.ASCII) else None, "refers_to_id": fields.get("warc-refers-to"), "payload_bytes": size, "payload_digest": shown, "payload": None if kind == "revisit" else body, "error": None}


def read_archives(paths: DataFrame, strict: bool = True) -> DataFrame:
    """A row of ``ROW`` for every record of the files in ``path``. Unless strict, a bad record is a row with ``error``; so is
    a bad frame, after which its file is left."""
    schema = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("record_type", pa.string()), ("record_id", pa.string()), ("url", pa.string()), ("page_id", pa.int64()), ("refers_to_id", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()), ("error", pa.string())])

    # frames are decoded here: by the file's name alone the file system would take them for one plain stream
    def records(path: str) -> Iterator[dict]:
        system, name = pyarrow.fs.FileSystem.from_uri(path)
        offset = 0
        with system.open_input_stream(name, compression=None) as stream:
            try:
                for offset, data in frames(stream):
                    try:
                        yield row(path, offset, data)
                    except WarcError as e:
                        if strict:
                            raise WarcError(f"{path}, record at {offset}: {e}") from None
                        yield {"path": path, "offset": offset, "error": str(e)}
            except WarcError as e:
                if strict:
                    raise WarcError(f"{path}: {e}") from None
                yield {"path": path, "offset": offset, "error": str(e)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                held, size = [], 0
                for found in records(path):
                    held.append(found)
                    size += len(found.get("payload") or b"") + 256
                    if size >= CHUNK:
                        yield pa.RecordBatch.from_pylist(held, schema=schema)
                        held, size = [], 0
                yield pa.RecordBatch.from_pylist(held, schema=schema)

    return paths.select("path").mapInArrow(run, ROW)


def resolved(records: DataFrame) -> DataFrame:
    """page_id, url, record_type, refers_to, payload_bytes, payload_digest of responses and revisits; a revisit that has no
    response, or one with another length or digest, raises."""
    kept = ["page_id", "url", "record_type", "payload_bytes", "payload_digest"]
    known = records.where(F.col("record_type").isin("response", "revisit")).select("record_id", "refers_to_id", *kept)
    known = materialise(known, "warc-records")
    again = known.where(F.col("record_type") == "revisit")
    first = known.where(F.col("record_type") == "response").groupBy(F.col("record_id").alias("refers_to_id"))
    first = first.agg(F.first("page_id").alias("refers_to"), F.first("payload_bytes").alias("bytes"), F.first("payload_digest").alias("digest"))
    # the checks need each revisit's response; sizes say how many found theirs
    met = materialise(join_unique(again, first, "refers_to_id"), "warc-revisits")
    if (lost := again.count() - met.count()) > 0:
        raise WarcError(f"{lost} revisits refer to no response")
    if not met.where((F.col("bytes") != F.col("payload_bytes")) | (F.col("digest") != F.col("payload_digest"))).isEmpty():
        raise WarcError("revisits whose payload differs from that of their response")
    none = F.lit(None).cast("long").alias("refers_to")
    return known.where(F.col("record_type") == "response").select(*kept, none).unionByName(met.select(*kept, "refers_to"))


def write_archives(pages: DataFrame, folder: str, payload: str = "html", page_id: str = "page_id", url: str = "url", least: int = 0, date: str | None = None) -> DataFrame:
    """Write the pages below ``folder`` (a URI that driver and executors share): path, records, bytes of its files. Payloads of
    fewer than ``least`` bytes are always responses."""
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    own = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(payload), F.lit("")).alias("payload"))
    keyed = own.withColumn("key", F.unhex(F.sha2(F.encode("payload", "UTF-8"), 256)))
    long = F.octet_length("payload") >= least
    shared = keyed.where(long).groupBy("key").agg(F.max(F.struct("page_id", "url")).alias("kept"), F.count("*").alias("times")).where("times > 1").select("key", "kept")
    shared = materialise(shared, "warc-shared")
    placed = keyed.join(F.broadcast(shared) if shared.count() <= BROADCAST_ROWS else shared, "key", "left")
    here = F.struct("page_id", "url")
    placed = placed.select("page_id", "url", "payload", "key", F.when(long & F.col("kept").isNotNull() & ~here.eqNullSafe(F.col("kept")), F.col("kept")).alias("kept"))
    dictionary = train([http_block(b := r.payload.encode(), b) for r in own.select("payload").where(F.octet_length("payload") <= SAMPLE_BYTES // 16).limit(DICTIONARY_ROWS).collect()])

    def name_of(key: bytes, page: int | None, target: str | None) -> str:
        return f"<{uuid.uuid5(uuid.NAMESPACE_URL, f'{key.hex()} {page} {target}').urn}>"

    def records(batch: pa.RecordBatch) -> Iterator[bytes]:
        for page, target, text, key, kept in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "key", "kept")), strict=True):
            data = text.encode("utf-8", "replace")
            fields = [("WARC-Payload-Digest", f"sha1:{digest(data)}"), ("Content-Type", HTTP_TYPE)]
            fields += [("WARC-Target-URI", _field(target))] if target else []
            fields += [("Page-ID", str(page))] if page is not None else []
            if kept:
                fields += [("WARC-Profile", SAME_PAYLOAD), ("WARC-Refers-To", name_of(key, kept["page_id"], kept["url"]))]
                fields += [("WARC-Refers-To-Target-URI", _field(kept["url"]))] if kept["url"] else []
            yield record("revisit" if kept else "response", name_of(key, page, target), date, fields, http_block(data, b"" if kept else data))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, below = pyarrow.fs.FileSystem.from_uri(folder)
        writer = path = None

        def close() -> pa.RecordBatch:
            writer.stream.close()
            return pa.record_batch({"path": [f"{folder}/{path}"], "records": pa.array([writer.records]), "bytes": pa.array([writer.size])})

        for batch in slices(batches):
            for data in records(batch):
                if writer is None:
                    path = f"{uuid.uuid4().hex}.warc.zst"
                    system.create_dir(below, recursive=True)
                    writer = ArchiveWriter(system.open_output_stream(f"{below}/{path}", compression=None), dictionary)
                    writer.add(record("warcinfo", f"<{uuid.uuid4().urn}>", date, [("Content-Type", "application/warc-fields"), ("WARC-Filename", path)], b"format: WARC File Format 1.1\r\n"))
                writer.add(data)
                if writer.size >= FILE_BYTES:
                    yield close()
                    writer = None
        if writer is not None:
            yield close()

    return materialise(placed.mapInArrow(run, "path string, records long, bytes long"), "warc-files")


def folder_uri(spark: SparkSession, label: str) -> str:
    """A new folder's URI below the shared one."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toUri().toString()


def op11(pages: DataFrame, least: int = 0) -> DataFrame:
    spark = pages.sparkSession
    files = write_archives(pages, folder_uri(spark, "warc"), least=least)
    # a file a task: files are large, their list is not
    paths = files.select("path").repartition(max(1, files.count()), "path")
    found = read_archives(paths)
    return resolved(found).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")
