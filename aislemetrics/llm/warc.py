"""WARC archives, each with a Zstandard dictionary of its own records.

An archive is a skippable frame that holds the dictionary, then one Zstandard frame for each record,
so that a record can be read alone and small records still share what they have in common. Tasks write
archives of bounded size straight to a shared folder; there is no shuffle of pages. The dictionary is
built from records spread evenly over the first ``BUFFER_BYTES`` of the archive. ``write`` returns a
manifest; an archive counts only if the manifest names it, so that files of lost or repeated task
attempts do no harm.

Of records with equal payloads (by SHA-256) of at least ``least`` bytes the one with the smallest
page_id is a response, the others are revisits that refer to it and carry no payload, but the digest
and, in the kept HTTP header, the payload's length. ``read`` takes every record from the archives: it
checks length and digest of each response and resolves each reference to the response's record.

Cases: a null html is an empty payload, a null url gives no target. Null page_ids come after all
others. Of rows that repeat the smallest page_id and its payload one is the response and the others
revisit it. Control characters and blanks of urls and ids are percent-encoded. A payload of any length
is one record; an archive ends after the record that fills it. Other columns are ignored. An empty
table gives no archive and no rows.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Callable, Iterator
from hashlib import sha256
from urllib.parse import quote, unquote

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aislemetrics.llm.common import BROADCAST_BYTES, written

LEAST = 100  # bytes of a payload that can be revisited
ARCHIVE_BYTES = 512 << 20  # records of an archive before compression
BUFFER_BYTES = 16 << 20  # records that an archive holds back until its dictionary is built from them
DICTIONARY_BYTES = 64 << 10
SAMPLES = 2_000  # buffered records that the dictionary is built from, evenly spread
SAMPLE_BYTES = 4 << 10  # bytes of such a record that the dictionary builder sees
LEVEL = 3
DATE = "2000-01-01T00:00:00Z"  # pages carry no date of capture
BLOCK = 64 << 10
# Fixed values of the formats.
DICTIONARY_FRAME = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SAFE = "".join(map(chr, range(0x21, 0x7F))).replace("%", "")


def _record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=sha256('|'.join(parts).encode('utf-8', 'surrogatepass')).digest()[:16])}>"


def record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """One WARC record of named fields and a block."""
    head = "".join(f"{name}: {value}\r\n" for name, value in [*fields, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Fields (names in lower case) and block of a record."""
    head, rest = data.split(b"\r\n\r\n", 1)
    version, *lines = head.decode().split("\r\n")
    fields = {name.lower(): value for name, value in (line.split(": ", 1) for line in lines)}
    block = rest[: int(fields["content-length"])]
    if not version.startswith("WARC/") or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("not a WARC record")
    return fields, block


def http_block(payload: bytes, body: bool) -> bytes:
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    return head.encode() + (payload if body else b"")


def parse_http(block: bytes) -> tuple[int, bytes]:
    """Length of the payload by its header, and the payload."""
    head, payload = block.split(b"\r\n\r\n", 1)
    length = next(int(line.split(b":")[1]) for line in head.split(b"\r\n") if line.lower().startswith(b"content-length:"))
    return length, payload


def build_dictionary(records: list[bytes]) -> zstandard.ZstdCompressionDict:
    """Dictionary of evenly spread records; of too few to build one, their heads as they are."""
    step = max(1, len(records) // SAMPLES)
    samples = [r[:SAMPLE_BYTES] for r in records[::step]]
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(1024, sum(map(len, samples)) // 8)), samples)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(samples)[-DICTIONARY_BYTES:].ljust(8, b"\r"), dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def records_of(source) -> Iterator[bytes]:
    """Records of an open archive, one at a time."""
    magic, size = struct.unpack("<II", source.read(8))
    if magic != DICTIONARY_FRAME:
        raise ValueError("no dictionary frame at the start")
    raw = source.read(size)
    full = raw[:4] == struct.pack("<I", 0xEC30A437)
    kind = zstandard.DICT_TYPE_FULLDICT if full else zstandard.DICT_TYPE_RAWCONTENT
    expand = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw, dict_type=kind))
    rest = source.read(BLOCK)
    while rest:
        frame, out = expand.decompressobj(), []
        while not frame.eof:
            if not rest:
                raise ValueError("archive ends within a record")
            out.append(frame.decompress(rest))
            rest = frame.unused_data if frame.eof else source.read(BLOCK)
        yield b"".join(out)
        rest = rest or source.read(BLOCK)


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


_MANIFEST = pa.schema([("path", pa.string()), ("records", pa.int64()), ("record_bytes", pa.int64()), ("bytes", pa.int64())])


class _Archive:
    """An archive in the making: records are held until the dictionary is built, then written at once."""

    def __init__(self, folder: str):
        self.name = uuid.uuid4().hex  # a new one for every attempt of a task
        self.path = f"{folder}/{self.name}.warc.zst"
        self.held, self.press, self.sink = [], None, None
        self.records = self.size = self.written = 0
        fields = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", _record_id(self.name)), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")]
        self.held.append(record(fields, b"format: WARC File Format 1.1\r\n"))

    def _begin(self) -> None:
        dictionary = build_dictionary(self.held)
        place, root = opened(self.path)
        self.sink = place.open_output_stream(root, compression=None)
        self.press = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_checksum=True)
        raw = dictionary.as_bytes()
        self.written += self.sink.write(struct.pack("<II", DICTIONARY_FRAME, len(raw)) + raw)
        for r in self.held:
            self.written += self.sink.write(self.press.compress(r))
        self.held = []

    def add(self, data: bytes) -> None:
        self.records += 1
        self.size += len(data)
        if self.press is not None:
            self.written += self.sink.write(self.press.compress(data))
            return
        self.held.append(data)
        if self.size >= BUFFER_BYTES:
            self._begin()

    def close(self) -> pa.RecordBatch:
        if self.press is None:
            self._begin()
        self.sink.close()
        row = [self.path, self.records, self.size, self.written]
        return pa.record_batch([pa.array([v], f.type) for v, f in zip(row, _MANIFEST)], schema=_MANIFEST)


def _archives(folder: str, most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, root = opened(folder)
        place.create_dir(root, recursive=True)
        archive = None
        for batch in batches:
            small = ("kind", "page_id", "first_id", "digest", "copied")
            urls, payloads = batch.column("url"), batch.column("payload")
            for i, (kind, page, first, digest, copied) in enumerate(zip(*[batch.column(c).to_pylist() for c in small])):
                archive = archive or _Archive(folder)
                payload, url = payloads[i].as_py(), urls[i].as_py()
                shared = copied and kind == "response"
                own = _record_id("response", str(page), digest) if shared else _record_id(archive.name, str(archive.records))
                fields = [("WARC-Type", kind), ("WARC-Record-ID", own), ("WARC-Date", DATE), ("WARC-Payload-Digest", f"sha256:{digest}")]
                if page is not None:
                    fields.append(("X-Page-Id", quote(page, safe=SAFE)))
                if url is not None:
                    fields.append(("WARC-Target-URI", quote(url, safe=SAFE + "%")))
                if kind == "revisit":
                    fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _record_id("response", str(first), digest))]
                fields.append(("Content-Type", "application/http;msgtype=response"))
                archive.add(record(fields, http_block(payload, kind == "response")))
                if archive.size >= most:
                    yield archive.close()
                    archive = None
        if archive:
            yield archive.close()

    return run


def kinds(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id (as text), url, payload, digest, kind, first_id of every page; ``copied``: other rows have its payload."""
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    marks = rows.filter(F.octet_length("payload") >= least).groupBy("digest", "page_id").agg(F.count("*").alias("n"))
    firsts = marks.groupBy("digest").agg(F.sum("n").alias("rows"), F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "n")).alias("first"))
    firsts = written(firsts.filter("rows > 1").select("digest", F.col("first.page_id").alias("first_id"), F.col("first.n").alias("firsts")))
    counts = firsts.agg(F.count("*").alias("n"), F.coalesce(F.max("firsts"), F.lit(0)).alias("most")).first()
    small = counts.n * 200 <= BROADCAST_BYTES  # a digest, an id and two numbers; ids are short
    joined = rows.join(F.broadcast(firsts) if small else firsts, "digest", "left")
    copied = F.col("firsts").isNotNull()
    is_first = F.col("page_id").eqNullSafe(F.col("first_id"))
    kind = F.when(~copied | is_first, F.lit("response")).otherwise(F.lit("revisit"))
    named = ["page_id", "url", "payload", "digest", "kind", "first_id", "copied"]
    out = joined.withColumns({"kind": kind, "copied": copied})
    if counts.most > 1:
        # rows that repeat the smallest id with its payload: one of them is the response
        tied = copied & is_first & (F.col("firsts") > 1)
        ties = written(out.filter(tied).withColumn("row", F.monotonically_increasing_id()))
        one = ties.groupBy("digest").agg(F.min("row").alias("one"))
        ties = ties.join(one, "digest").withColumn("kind", F.when(F.col("row") == F.col("one"), "response").otherwise("revisit"))
        out = out.filter(~tied).select(*named).unionByName(ties.select(*named))
    return out.select(*[F.col(c).cast("string").alias(c) if c.endswith("_id") else F.col(c) for c in named])


def write(pages: DataFrame, folder: str, least: int = LEAST, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Archives of ``pages`` (page_id, url, html) in the shared ``folder``; the manifest: path, records, record_bytes, bytes."""
    schema = "path string, records long, record_bytes long, bytes long"
    return written(kinds(pages, least).mapInArrow(_archives(folder, archive_bytes), schema))


_READ = "page_id string, url string, record_id string, payload_bytes long, payload_digest string, record_type string, refers_to_id string, payload binary"


def _read(keep: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def rows(path: str) -> Iterator[tuple]:
        place, file = opened(path)
        with place.open_input_stream(file, compression=None) as source:
            for data in records_of(source):
                fields, block = parse_record(data)
                if fields["warc-type"] == "warcinfo":
                    continue
                length, payload = parse_http(block)
                digest = fields["warc-payload-digest"].removeprefix("sha256:")
                full = fields["warc-type"] == "response"
                if full and (len(payload) != length or sha256(payload).hexdigest() != digest):
                    raise ValueError(f"payload of {fields['warc-record-id']} in {path} is damaged")
                page = fields.get("x-page-id")
                page = None if page is None else unquote(page)
                yield (page, fields.get("warc-target-uri"), fields["warc-record-id"], length, digest, fields["warc-type"], fields.get("warc-refers-to"), payload if full and keep else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
        schema = pa.schema([(c.split()[0], types[c.split()[1]]) for c in _READ.split(", ")])

        def table(found: list[tuple]) -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*found), schema)], schema=schema)

        for batch in batches:
            for path in batch.column("path").to_pylist():
                found, size = [], 0
                for row in rows(path):
                    found.append(row)
                    size += 500 + len(row[-1] or b"")
                    if size > BUFFER_BYTES:
                        yield table(found)
                        found, size = [], 0
                if found:
                    yield table(found)

    return run


def read(manifest: DataFrame, payloads: bool = False) -> DataFrame:
    """Every record of the archives that ``manifest`` names.

    page_id and refers_to (text), url, record_id, payload_bytes, payload_digest, record_type and, if
    asked for, the payload of responses. Payloads are never shuffled.
    """
    # one archive for each small piece of the manifest, so that archives are read in parallel
    spread = manifest.select("path").repartition(max(1, min(manifest.count(), 4096)), "path")
    found = spread.mapInArrow(_read(payloads), _READ)
    if not payloads:
        found = written(found.drop("payload"))
    targets = found.filter("record_type = 'response'").select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"), F.lit(True).alias("known"))
    needed = found.filter("record_type = 'revisit'").select("refers_to_id").distinct()
    targets = targets.join(needed, "refers_to_id", "left_semi")
    out = found.join(targets, "refers_to_id", "left")
    lost = (F.col("record_type") == "revisit") & F.col("known").isNull()
    sound = F.when(lost, F.raise_error(F.lit("a revisit refers to no response"))).otherwise(F.col("record_type"))
    return out.withColumn("record_type", sound).drop("known", "refers_to_id")
