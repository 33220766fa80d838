"""WARC records in ZIP-packaged archives: written, then read by ranges without extraction.

An archive is a ZIP file with stored members only: ``archive/data.warc.gz`` (one gzip member per record) and
``indexes/index.cdxj`` (place and length of each record). The reader finds members by the central directory, ZIP64
included, reads the index, and then each record by its own range.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pandas as pd
import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweave.llm.common import stage
from claimweave.session import stage_path

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
ARCHIVE_BYTES = 256 * 1024 * 1024
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
FULL32, FULL16 = 0xFFFFFFFF, 0xFFFF


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record: a response with its payload, or a revisit that names the record it repeats."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%-._~')}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Payload-Length: {len(payload)}"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(raw: bytes) -> dict:
    """Header fields and payload of a record; a response's digest is compared with its payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError("not a WARC record")
    field = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(field["Content-Length"])]
    payload = block.partition(b"\r\n\r\n")[2]
    urn = lambda x: int(x[10:-1]) if x and x[10:-1] else None
    digest = field["WARC-Payload-Digest"].removeprefix("sha1:")
    if field["WARC-Type"] == "response" and digest != digest32(payload):
        raise ValueError(f"payload of {field['WARC-Record-ID']} does not match its digest")
    return {"page_id": urn(field["WARC-Record-ID"]), "url": field.get("WARC-Target-URI"), "record_type": field["WARC-Type"], "payload": payload, "payload_digest": digest, "payload_bytes": int(field.get("WARC-Payload-Length", len(payload))), "refers_to": urn(field.get("WARC-Refers-To", ""))}


class ArchiveWriter:
    """One archive, streamed; ``close`` adds the index and the directory."""

    def __init__(self, folder: str):
        fs, at = FileSystem.from_uri(folder)
        fs.create_dir(at, recursive=True)
        name = f"{uuid.uuid4().hex}.wacz"
        self.path = f"{folder.rstrip('/')}/{name}"
        self.stream = fs.open_output_stream(f"{at}/{name}")
        self.zip = zipfile.ZipFile(self.stream, "w", zipfile.ZIP_STORED)
        self.data = self.zip.open(zipfile.ZipInfo(DATA), "w", force_zip64=True)
        self.places: list[tuple[int, int]] = []
        self.size = 0

    def add(self, raw: bytes) -> None:
        z = zlib.compressobj(1, zlib.DEFLATED, 31)
        packed = z.compress(raw) + z.flush()
        self.data.write(packed)
        self.places.append((self.size, len(packed)))
        self.size += len(packed)

    def close(self) -> None:
        self.data.close()
        with self.zip.open(zipfile.ZipInfo(INDEX), "w", force_zip64=True) as f:
            for at, n in self.places:
                f.write(json.dumps({"filename": DATA, "offset": at, "length": n}).encode() + b"\n")
        self.zip.close()
        self.stream.close()


@dataclass
class Member:
    name: str
    size: int
    start: int


def members(f, size: int) -> list[Member]:
    """Stored members of the ZIP file in ``f`` (seekable), by its central directory; places beyond 32 bits by ZIP64."""
    tail = min(size, 22 + FULL16)
    f.seek(size - tail)
    end = f.read(tail)
    at = end.rfind(b"PK\x05\x06")
    if at < 0:
        raise ValueError("no end of central directory")
    n, length, start = struct.unpack("<HII", end[at + 10 : at + 20])
    if n == FULL16 or length == FULL32 or start == FULL32:
        f.seek(size - tail + at - 20)
        mark, _, where, _ = struct.unpack("<4sIQI", f.read(20))
        if mark != b"PK\x06\x07":
            raise ValueError("no ZIP64 locator")
        f.seek(where)
        wide = f.read(56)
        if wide[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end of central directory")
        n, length, start = struct.unpack("<QQQ", wide[32:56])
    f.seek(start)
    central, at, out = f.read(length), 0, []
    for _ in range(n):
        if central[at : at + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        method, packed, plain, n_name, n_extra, n_note = struct.unpack("<10xH8xIIHHH", central[at : at + 34])
        (local,) = struct.unpack("<I", central[at + 42 : at + 46])
        name = central[at + 46 : at + 46 + n_name].decode()
        extra = central[at + 46 + n_name : at + 46 + n_name + n_extra]
        at += 46 + n_name + n_extra + n_note
        while len(extra) >= 4:
            kind, k = struct.unpack("<HH", extra[:4])
            if kind == 1:
                wide = iter(struct.unpack(f"<{k // 8}Q", extra[4 : 4 + k // 8 * 8]))
                plain = next(wide) if plain == FULL32 else plain
                packed = next(wide) if packed == FULL32 else packed
                local = next(wide) if local == FULL32 else local
            extra = extra[4 + k :]
        if method != 0:
            raise ValueError(f"{name} is not stored")
        f.seek(local)
        head = f.read(30)
        if head[:4] != b"PK\x03\x04":
            raise ValueError("broken local header")
        n_name, n_extra = struct.unpack("<HH", head[26:30])
        out.append(Member(name, packed, local + 30 + n_name + n_extra))
    return out


def _write(folder: str, archive_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: ArchiveWriter | None = None
        done: list[tuple[str, int]] = []
        for batch in batches:
            for page_id, url, html, last in zip(*[batch.column(c) for c in ("page_id", "url", "html", "last")], strict=True):
                if now is None:
                    now = ArchiveWriter(folder)
                page, first = page_id.as_py(), last.as_py()
                payload = (html.as_py() or "").encode()
                now.add(record(page, url.as_py(), payload, digest32(payload), None if first is None or first == page else first))
                if now.size >= archive_bytes:
                    now.close()
                    done.append((now.path, len(now.places)))
                    now = None
        if now is not None:
            now.close()
            done.append((now.path, len(now.places)))
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], names=["path", "n_records"])

    return run


def written(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", folder: str | None = None, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Archives of one record per row → (path, n_records), the list of those that finished.

    Of rows with equal payloads, the ones with the largest page_id are responses and the others revisits of it; where
    no id is known all are responses. A null html is an empty payload, an empty table gives no archive. Attempts write
    files of their own, and only finished tasks are listed, so lost executors leave no half archive in the list.
    ``folder`` must be one that every executor reaches; without it, the session's shared folder.
    """
    p = pages.select(F.col(page_id).cast("bigint").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html).cast("string"), F.lit("")).alias("html"))
    p = p.withColumn("d", F.unhex(F.sha1(F.col("html").cast("binary"))))
    last = stage(p.groupBy("d").agg(F.max("page_id").alias("last")), "warc-last")
    rows = p.join(last, "d").select("page_id", "url", "html", "last")
    where = folder or stage_path(pages.sparkSession, "warc")
    return stage(rows.mapInArrow(_write(where, archive_bytes), "path string, n_records bigint"), "warc-list")


def _locate(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        for path in f.path:
            fs, at = FileSystem.from_uri(path)
            with fs.open_input_file(at) as file:
                found = {m.name: m for m in members(file, file.size())}
                file.seek(found[INDEX].start)
                index = io.BytesIO(file.read(found[INDEX].size))
            rows = [(path, found[x["filename"]].start + x["offset"], x["length"]) for x in map(json.loads, index)]
            yield pd.DataFrame(rows, columns=["path", "at", "length"])


def _ranges(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        for path, part in f.groupby("path"):
            fs, at = FileSystem.from_uri(path)
            with fs.open_input_file(at) as file:
                out = [parsed(zlib.decompress(file.read_at(n, start), 31)) for start, n in zip(part["at"].tolist(), part["length"].tolist(), strict=True)]
            yield pd.DataFrame(out).astype({"page_id": "Int64", "refers_to": "Int64"})


RECORD = "page_id bigint, url string, record_type string, payload binary, payload_digest string, payload_bytes bigint, refers_to bigint"


def read_back(archives: DataFrame) -> DataFrame:
    """(path) → one row per record: page_id, url, record_type, payload (empty for revisits), digest, bytes, refers_to."""
    places = archives.select("path").repartition(F.col("path")).mapInPandas(_locate, "path string, at bigint, length bigint")
    return stage(places, "warc-places").repartitionByRange("path", "at").mapInPandas(_ranges, RECORD)


def _bits(hex_digits: str) -> str:
    return f"array_to_string(list_transform(string_split({hex_digits}, ''), lambda c: ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'][('0x' || c)::INT + 1]), '')"


SQL = f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS n, sha1(coalesce(html, '')) AS d FROM pages),
b AS (SELECT *, {_bits('d')} AS bits, max(page_id) OVER (PARTITION BY d) AS last FROM p)
SELECT page_id, n AS payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + list_sum(list_transform(range(0, 5), lambda k: substr(bits, (5 * i + k + 1)::INT, 1)::INT * [16, 8, 4, 2, 1][k + 1]))::INT]), '') AS payload_digest,
  CASE WHEN last IS NULL OR last = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN last = page_id THEN NULL ELSE last END AS refers_to
FROM b
"""


