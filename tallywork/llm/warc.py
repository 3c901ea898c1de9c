"""WARC records in Zstandard archives, written and read back.

An archive begins with a skippable frame that holds the dictionary; each record is one frame after it. The reader takes
the dictionary from there (itself compressed or not), decodes frame by frame and checks version, headers, lengths,
terminator and payload digest. What is wrong is named in a row's error, never raised; a frame that can't be decoded
ends its archive, since nothing tells where the next begins.

Archives are rows (archive, content) of at most ARCHIVE_BYTES before compression, as spark.read.format("binaryFile")
gives for files, so they go wherever Spark can write.

A null html is an empty payload; a null url leaves the record's own id as target. Of records with equal payloads of at
least REVISIT_BYTES the smallest page_id is the response, as often as that row is repeated; the others revisit it. A
null page_id is never the smallest unless there is no other. A very long page is a record of its own in an archive of its own. An empty table gives
no record; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywork.llm.common import stored

#: Payloads below this are always written whole.
REVISIT_BYTES = 100
ARCHIVE_BYTES = 16 << 20
DICTIONARY_BYTES = 32 << 10
#: The dictionary of an archive is trained on so many of its records at most.
DICTIONARY_RECORDS = 200
DATE = "1970-01-01T00:00:00Z"
#: Fixed values of the formats: magic numbers of the dictionary's skippable frame and of a frame; revisit profile.
DICTIONARY_FRAME, SKIPPABLE, FRAME = 0x184D2A5D, 0x184D2A50, 0xFD2FB528
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n\r\n"
REQUIRED = ("warc-type", "warc-record-id", "warc-date", "content-length")
FIELDS = "archive string, position long, record_type string, record_id string, target_uri string, refers_to string, payload_bytes long, payload_digest string, payload binary, error string"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None) -> bytes:
    """One record; first is the page whose payload this one repeats."""
    own = f"urn:x-page:{'none' if page_id is None else page_id}"
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m.group()):02X}", url) if url else own
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if first is None else b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: <{own}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha256:{digest}"]
    if first is not None:
        head += [f"WARC-Refers-To: <urn:x-page:{first}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + END + block + END


def dictionary(records: list[bytes]) -> bytes:
    """Trained if there are enough records for that, else what the first of them begin with."""
    sample = records[:DICTIONARY_RECORDS]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, sample).as_bytes()
    except zstandard.ZstdError:
        return b"".join(r[:1024] for r in sample)[:DICTIONARY_BYTES]


def archive(records: list[bytes]) -> bytes:
    raw = dictionary(records)
    body = zstandard.ZstdCompressor(level=9).compress(raw)
    compress = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(raw), write_checksum=True).compress
    return b"".join([struct.pack("<II", DICTIONARY_FRAME, len(body)), body, *map(compress, records)])


def written(pages: DataFrame) -> DataFrame:
    """Archives (archive, content) of pages (page_id, url, html)."""
    known = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    marked = known.withColumn("digest", F.sha2("payload", 256)).withColumn("long_enough", F.octet_length("payload") >= REVISIT_BYTES)
    groups = marked.where("long_enough").groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    firsts = stored(groups.select(F.col("digest").alias("same"), "first"), "firsts")
    rows = marked.join(firsts, F.col("digest") == F.col("same"), "left").select("page_id", "url", "payload", "digest", "first")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, held, size = TaskContext.get().partitionId(), 0, [], 0

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f"part-{part:06d}-{number:06d}.warc.zst"]), pa.array([archive(held)], pa.binary())], ["archive", "content"])

        for b in batches:
            for values in zip(*b.columns, strict=True):
                page_id, url, payload, digest, first = (v.as_py() for v in values)
                held.append(record(page_id, url, payload, digest, None if first is None or first == page_id else first))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield row()
                    number, held, size = number + 1, [], 0
        if held:
            yield row()

    return rows.mapInArrow(write, "archive string, content binary")


def frames(data: memoryview, dictionary_data: zstandard.ZstdCompressionDict | None, at: int) -> Iterator[tuple[int, bytes]]:
    """Position and content of each frame from at on."""
    plain = zstandard.ZstdDecompressor(dict_data=dictionary_data) if dictionary_data else zstandard.ZstdDecompressor()
    while at < len(data):
        if at + 8 <= len(data) and struct.unpack_from("<I", data, at)[0] & 0xFFFFFFF0 == SKIPPABLE:
            at += 8 + struct.unpack_from("<I", data, at + 4)[0]
            continue
        inner, out, begin = plain.decompressobj(), [], at
        while not inner.eof:
            if at >= len(data):
                raise zstandard.ZstdError("the last frame is cut short")
            piece = data[at : at + 16384]
            out.append(inner.decompress(piece))
            at += len(piece) - len(inner.unused_data)
        yield begin, b"".join(out)


def headers(lines: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in lines.decode("utf-8", "replace").split("\r\n"):
        name, colon, value = line.partition(":")
        if not colon or not name.strip():
            raise ValueError(f"a header without a name: {line[:80]!r}")
        out.setdefault(name.strip().lower(), value.strip())
    return out


def parsed(data: bytes) -> dict:
    """A record's fields; ValueError tells what is wrong with it."""
    head, blank, rest = data.partition(END)
    version, _, lines = head.partition(b"\r\n")
    if not re.fullmatch(rb"WARC/1\.[01]", version):
        raise ValueError(f"not a WARC version: {version[:40]!r}")
    if not blank:
        raise ValueError("the headers don't end")
    h = headers(lines)
    if missing := [x for x in REQUIRED if x not in h]:
        raise ValueError(f"missing headers: {', '.join(missing)}")
    if not re.fullmatch(r"[0-9]+", h["content-length"]):
        raise ValueError(f"not a length: {h['content-length'][:40]!r}")
    length = int(h["content-length"])
    if len(rest) != length + len(END) or rest[length:] != END:
        raise ValueError(f"Content-Length is {length}, the block has {max(0, len(rest) - len(END))} bytes or no end")
    block, revisit = rest[:length], h["warc-type"] == "revisit"
    out = {"record_type": h["warc-type"], "record_id": h["warc-record-id"].strip("<>"), "target_uri": h.get("warc-target-uri"), "refers_to": h["warc-refers-to"].strip("<>") if "warc-refers-to" in h else None}
    payload, n = block, None
    if h.get("content-type", "").startswith("application/http"):
        http, _, payload = block.partition(END)
        said = headers(http.partition(b"\r\n")[2]).get("content-length", "")
        n = int(said) if said.isdigit() else None
        if not revisit and n is not None and n != len(payload):
            raise ValueError(f"HTTP says {n} bytes, the payload has {len(payload)}")
    digest = h.get("warc-payload-digest", "")
    if revisit:
        if out["refers_to"] is None:
            raise ValueError("a revisit that refers to nothing")
        return out | {"payload_bytes": n, "payload_digest": digest.removeprefix("sha256:") or None, "payload": None}
    real = hashlib.sha256(payload).hexdigest()
    if digest.startswith("sha256:") and digest != f"sha256:{real}":
        raise ValueError("the payload doesn't match its digest")
    return out | {"payload_bytes": len(payload), "payload_digest": real, "payload": payload}


def records(content: bytes) -> Iterator[dict]:
    data, at, known = memoryview(content), 0, None
    try:
        if len(data) >= 8 and struct.unpack_from("<I", data)[0] == DICTIONARY_FRAME:
            size = struct.unpack_from("<I", data, 4)[0]
            if 8 + size > len(data):
                raise zstandard.ZstdError("the dictionary is cut short")
            raw, at = bytes(data[8 : 8 + size]), 8 + size
            if raw[:4] == struct.pack("<I", FRAME):
                raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
            known = zstandard.ZstdCompressionDict(raw)
        for at, one in frames(data, known, at):
            try:
                yield {"position": at, "error": None} | parsed(one)
            except ValueError as e:
                yield {"position": at, "error": str(e)}
    except zstandard.ZstdError as e:
        yield {"position": at, "error": str(e)}


def read(archives: DataFrame, payloads: bool = True, batch_bytes: int = 4 << 20) -> DataFrame:
    """A row a record of archives (archive, content); without payloads that column is null."""
    names = [x.split()[0] for x in FIELDS.split(", ")]
    kinds = {"position": pa.int64(), "payload_bytes": pa.int64(), "payload": pa.binary()}

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(held: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in held], kinds.get(n, pa.string())) for n in names], names)

        for b in batches:
            for name, content in zip(*b.columns, strict=True):
                held, size = [], 0
                for r in records(content.as_py()):
                    held.append(r | {"archive": name.as_py()} | ({} if payloads else {"payload": None}))
                    size += len(held[-1].get("payload") or b"") + 200
                    if size > batch_bytes:
                        yield batch(held)
                        held, size = [], 0
                if held:
                    yield batch(held)

    return archives.select("archive", "content").mapInArrow(rows, FIELDS)


def read_files(spark, path: str) -> DataFrame:
    """Records of .warc.zst files. Spark reads a file whole, so each must be below 2 GB."""
    return read(spark.read.format("binaryFile").load(path).select(F.col("path").alias("archive"), "content"))
