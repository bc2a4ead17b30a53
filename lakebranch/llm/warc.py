"""WARC archives of individually compressed records with an embedded dictionary.

An archive begins with a skippable frame (magic 0x184D2A5D) that holds a Zstandard dictionary built from the archive's first
records; each record follows as a frame of its own, so any one can be read by itself. A record whose payload another one has is
a revisit: it holds the HTTP head only and names that other record. Where there are too few records to build a dictionary from,
the leading frame is left out.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import urllib.parse
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from lakebranch.llm import shared

MAGIC, DICTIONARY_MAGIC = 0x184D2A5D, 0xEC30A437
#: A dictionary's size, and how many bytes of records it is built from at most.
DICTIONARY_BYTES, SAMPLE_BYTES = 32 << 10, 2 << 20
#: Records are trained on in pieces of at most so many bytes.
PIECE_BYTES = 1 << 16
#: Uncompressed bytes after which an archive ends.
ARCHIVE_BYTES = 32 << 20
LEVEL = 3
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SAFE = "!#$%&'()*+,/:;=?@[]~-._"


def record_id(key: str | None) -> str:
    return "<urn:record:null>" if key is None else f"<urn:record:id:{urllib.parse.quote(key, safe='')}>"


def key_of(record: str) -> str | None:
    return None if record == "<urn:record:null>" else urllib.parse.unquote(record.removeprefix("<urn:record:id:").removesuffix(">"))


def record(key: str | None, url: str | None, payload: bytes, digest: str, kind: str, refers_to: str | None) -> bytes:
    """One WARC record; digest is the payload's SHA-1 in base32."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if kind == "revisit" else head + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(key)}", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {urllib.parse.quote(url or '', safe=_SAFE)}", f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if kind == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class Archive:
    """Writes records to a binary stream; the first are held back until they make a dictionary."""

    def __init__(self, stream):
        self.stream, self.held, self.size, self.compressor, self.count, self.dictionary = stream, [], 0, None, 0, None

    def add(self, data: bytes) -> None:
        self.size += len(data)
        self.count += 1
        if self.compressor is None:
            self.held.append(data)
            if self.size >= SAMPLE_BYTES:
                self.start()
        else:
            self.stream.write(self.compressor.compress(data))

    def start(self) -> None:
        try:
            made = zstandard.train_dictionary(DICTIONARY_BYTES, [x[i : i + PIECE_BYTES] for x in self.held for i in range(0, len(x), PIECE_BYTES)], d=8, k=256, steps=1)
            data, self.dictionary = made.as_bytes(), "trained"
        except zstandard.ZstdError:  # too few records, or too alike: their beginning is the dictionary, itself compressed
            raw = b"".join(self.held)[:DICTIONARY_BYTES]
            made = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            data, self.dictionary = zstandard.ZstdCompressor(level=LEVEL).compress(raw), "raw"
        self.stream.write(struct.pack("<II", MAGIC, len(data)) + data)
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=made)
        for x in self.held:
            self.stream.write(self.compressor.compress(x))
        self.held = []

    def close(self) -> None:
        if self.compressor is None:
            self.start()
        self.stream.close()


def read_archive(stream: io.RawIOBase) -> Iterator[tuple[dict[str, str], dict[str, str], bytes]]:
    """(WARC fields, HTTP fields, payload) of each record of an archive, in order."""
    head = stream.read(8)
    made = None
    if len(head) == 8 and (found := struct.unpack("<II", head))[0] == MAGIC:
        data = stream.read(found[1])
        if data[:4] == b"\x28\xb5\x2f\xfd":
            data = zstandard.ZstdDecompressor().decompress(data)
        made = zstandard.ZstdCompressionDict(data)
    else:
        stream.seek(0)
    opened = zstandard.ZstdDecompressor(dict_data=made) if made else zstandard.ZstdDecompressor()
    records = io.BufferedReader(opened.stream_reader(stream, read_across_frames=True), 1 << 18)

    def fields() -> dict[str, str]:
        out = {}
        while (line := records.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode().rstrip("\r\n").partition(": ")
            out[name] = value
        return out

    while line := records.readline():
        if not line.startswith(b"WARC/1."):
            raise ValueError(f"no WARC record begins with {line[:40]!r}")
        warc = fields()
        left = int(warc["Content-Length"])
        block = records.read(left)
        head_, _, payload = block.partition(b"\r\n\r\n")
        http = dict(x.split(": ", 1) for x in head_.decode().split("\r\n")[1:])
        if records.read(4) != b"\r\n\r\n" or len(block) != left:
            raise ValueError("a WARC record is cut off")
        yield warc, http, payload


def planned(df: DataFrame, id_column: str, url_column: str, payload_column: str, least: int) -> DataFrame:
    """(id, url, payload, digest, record_type, refers_to): of equal payloads of least bytes or more, the greatest id is the response.

    Digests and ids are grouped without payloads. Payloads then meet their digest's greatest id in one shuffle, dealt by digest and id,
    so that the copies of one payload are spread over all tasks however many they are.
    """
    rows = df.select(
        F.col(id_column).alias("id"), F.col(url_column).cast("string").alias("url"), F.encode(F.coalesce(F.col(payload_column), F.lit("")), "UTF-8").alias("payload")
    ).withColumns({"digest": F.unhex(F.sha1("payload")), "salt": F.xxhash64("id", "url")})
    heads = rows.groupBy("digest", "salt").agg(F.max("id").alias("head"))
    greatest = heads.groupBy("digest").agg(F.max("head").alias("head"))
    heads = heads.select("digest", "salt").join(greatest, "digest")
    revisit = (F.octet_length("payload") >= least) & ~F.col("id").eqNullSafe(F.col("head"))
    return rows.join(heads, ["digest", "salt"]).select(
        "id", "url", "payload", "digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("head")).alias("refers_to")
    )


def write_archives(
    df: DataFrame, folder: str, id_column: str = "page_id", url_column: str = "url", payload_column: str = "html", least: int = 0
) -> DataFrame:
    """Writes a record for each row to archives in folder; gives (path, records, dictionary) of each archive; dictionary is trained, or raw where the
    records are too few or too alike for that.

    A null payload is empty, a null url an empty URI; a null id is less than any other. Rows that share both id and payload are
    all responses if the id is the payload's greatest. An empty table makes no archive. Names hold the task attempt, so a task
    that runs again leaves what another attempt wrote alone, and only files of attempts that succeeded are listed.
    """
    plan = planned(df, id_column, url_column, payload_column, least)
    plan = plan.withColumns({c: F.col(c).cast("string") for c in ("id", "refers_to")})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = pafs.FileSystem.from_uri(folder)
        files.create_dir(root)
        task, archive, n, out = TaskContext.get(), None, 0, []
        for batch in batches:
            for key, url, payload, digest, kind, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if archive is None:
                    name = f"{task.partitionId():05d}-{task.taskAttemptId()}-{n}.warc.zst"
                    archive, n = Archive(files.open_output_stream(f"{root}/{name}", compression=None)), n + 1
                    out.append([f"{folder}/{name}", archive])
                archive.add(record(key, url, payload, base64.b32encode(digest).decode(), kind, refers))
                if archive.size >= ARCHIVE_BYTES:
                    archive.close()
                    archive = None
        if archive is not None:
            archive.close()
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.string()), pa.array([a.count for _, a in out], pa.int64()), pa.array([a.dictionary for _, a in out], pa.string())], ["path", "records", "dictionary"])

    return shared.written(plan.mapInArrow(run, "path string, records long, dictionary string"), "archives")


def read_archives(archives: DataFrame, id_type: str = "bigint", payloads: bool = False) -> DataFrame:
    """(id, url, payload_bytes, payload_digest, record_type, refers_to[, payload]) of the records of archives (path).

    Each archive is read as a stream by one task. A response whose payload doesn't have the recorded digest is an error.
    """
    n = archives.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                files, name = pafs.FileSystem.from_uri(path)
                out, size = [], 0
                with files.open_input_file(name) as stream:
                    for warc, http, payload in read_archive(stream):
                        digest = warc["WARC-Payload-Digest"].removeprefix("sha1:")
                        response = warc["WARC-Type"] == "response"
                        if response and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                            raise ValueError(f"{path}: {warc['WARC-Record-ID']} doesn't have its digest")
                        refers = warc.get("WARC-Refers-To")
                        out.append((
                            key_of(warc["WARC-Record-ID"]), urllib.parse.unquote(warc["WARC-Target-URI"]), int(http["Content-Length"]), digest, warc["WARC-Type"],
                            key_of(refers) if refers else None, payload if payloads and response else None,
                        ))
                        size += len(payload) if payloads else 0
                        if size >= shared.BATCH_BYTES or len(out) >= 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
                            out, size = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    names = ["id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]
    schema = "id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string, payload binary"
    out = archives.select("path").repartition(max(1, n)).mapInArrow(run, schema)
    out = out.withColumns({c: F.col(c).cast(id_type) for c in ("id", "refers_to")})
    return out if payloads else out.drop("payload")
