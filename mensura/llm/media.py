"""Media columns: content-addressed payloads in tar shards, with range reads of headers.

Each task writes its payloads as 8-bit grey PNG images into tar shards in the shared folder, one
member per distinct payload of the shard, named by its digest; rows carry digest, shard, offset and
length. A shard's name is new for every attempt of a task, so an attempt that is lost leaves only
an unused file, and the rows are committed by Spark's writer. Metadata columns come from range reads of the
images' first 33 bytes; features from reading the whole range and decoding it.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import batch, slowly, small_batches, stored

#: Samples per image row.
WIDTH = 192
#: Header bytes of an image: signature and the first chunk.
HEADER = 33
#: A shard is closed once it holds so many bytes.
SHARD_BYTES = 64 << 20
_SIGNATURE = b"\x89PNG\r\n\x1a\n"

_INDEX = pa.schema([("row", pa.int64()), ("n_bytes", pa.int64()), ("digest", pa.string()), ("shard", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
_FEATURES = pa.schema([("row", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()),
                       ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()),
                       ("media_width", pa.int32()), ("media_height", pa.int32()), ("media_bits", pa.int32())])


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(payload: bytes) -> bytes:
    """A grey 8-bit image whose samples are the bytes of ``payload`` (a positive multiple of 192)."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    raw = np.zeros((len(rows), WIDTH + 1), np.uint8)  # each row starts with filter 0: samples as they are
    raw[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(raw.tobytes(), 3)) + _chunk(b"IEND", b"")


def png_header(start: bytes) -> tuple[int, int, int]:
    """(width, height, bits) from an image's first 33 bytes."""
    if start[:8] != _SIGNATURE or start[12:16] != b"IHDR":
        raise ValueError("not an image of this store")
    return struct.unpack(">IIB", start[16:25])


def from_png(image: bytes) -> bytes:
    """The samples of an image that ``to_png`` made."""
    width, height, _ = png_header(image[:HEADER])
    at, packed = 8, []
    while at < len(image):
        (size,), kind = struct.unpack(">I", image[at : at + 4]), image[at + 4 : at + 8]
        if kind == b"IDAT":
            packed.append(image[at + 8 : at + 8 + size])
        at += 12 + size
    return np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, width + 1)[:, 1:].tobytes()


def padded(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + b" " * (-len(raw) % WIDTH or (0 if raw else WIDTH))


def feature(payload: bytes) -> str:
    """Mean, spread and the share of samples in eight ranges, to fixed digits."""
    counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    values, n = np.arange(256), len(payload)
    mean = int((counts * values).sum()) / n
    spread = max(0.0, int((counts * values * values).sum()) / n - mean * mean) ** 0.5
    shares = counts.reshape(8, 32).sum(axis=1) / n
    return f"mean={mean:.4f};sd={spread:.4f};ranges=" + ",".join(f"{s:.4f}" for s in shares)


class _Shard:
    """A tar file in the shared folder, written front to back."""

    def __init__(self, folder: str):
        self.name = f"{folder}/{uuid.uuid4().hex}.tar"
        files, path = pa.fs.FileSystem.from_uri(self.name)
        self.out = files.open_output_stream(path)
        self.size, self.known = 0, {}

    def put(self, digest: str, image: bytes) -> int:
        if digest not in self.known:
            info = tarfile.TarInfo(digest + ".png")
            info.size = len(image)
            head = info.tobuf(tarfile.USTAR_FORMAT)
            self.known[digest] = self.size + len(head)
            self.out.write(head + image + b"\0" * (-len(image) % 512))
            self.size += len(head) + len(image) + -len(image) % 512
        return self.known[digest]

    def close(self) -> None:
        self.out.write(b"\0" * 1024)
        self.out.close()


def _write(folder: str):
    def run(batches):
        shard = None
        sizes: dict[str, int] = {}
        for b in batches:
            out = []
            for row, text in slowly(*b.columns):
                if shard is None or shard.size > SHARD_BYTES:
                    if shard is not None:
                        shard.close()
                    shard, sizes = _Shard(folder), {}
                n, payload = padded(text)
                digest = hashlib.sha256(payload).hexdigest()
                if digest not in sizes:
                    image = to_png(payload)
                    sizes[digest] = len(image)
                    shard.put(digest, image)
                out.append((row, n, digest, shard.name, shard.known[digest], sizes[digest]))
            if out:
                yield batch(_INDEX, *zip(*out))
        if shard is not None:
            shard.close()

    return run


def _read(batches):
    name = source = last = values = None
    for b in batches:
        out = []
        for row, n, digest, shard, offset, length in zip(*(c.to_pylist() for c in b.columns)):
            if shard != name:
                files, path = pa.fs.FileSystem.from_uri(shard)
                name, source = shard, files.open_input_file(path)
            if (shard, offset) != last:
                width, height, bits = png_header(source.read_at(HEADER, offset))
                image = source.read_at(length, offset)
                payload = from_png(image)
                found = hashlib.sha256(payload).hexdigest()
                if found != digest:
                    raise OSError(f"payload {digest} in {shard} reads as {found}")
                last = (shard, offset)
                values = (len(payload), found, zlib.crc32(payload[-16:]), len(image), hashlib.sha256(image).hexdigest(),
                          feature(payload), width, height, bits)
            out.append((row, n, *values))
        if out:
            yield batch(_FEATURES, *zip(*out))


def store_media(docs: DataFrame, row: str = "doc_id", text: str = "text", folder: str | None = None) -> DataFrame:
    """Stores every text; one row per document: (row, n_bytes, digest, shard, offset, length).

    A text is its UTF-8 bytes and then spaces up to a positive multiple of 192; null is empty. Equal
    payloads of a shard are stored once. Repeated rows are each returned, a null id is kept, other columns
    are ignored. No rows, no rows and no shards.
    """
    folder = folder or scratch_path(docs.sparkSession, "media")
    uri = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    uri = "file://" + uri[5:] if uri.startswith("file:/") and not uri.startswith("file://") else uri
    small_batches(docs.sparkSession)
    files, base = pa.fs.FileSystem.from_uri(uri)
    files.create_dir(base, recursive=True)
    docs = docs.select(F.col(row).cast("long").alias("row"), F.col(text).alias("text"))
    index = docs.mapInArrow(_write(uri), "row long, n_bytes long, digest string, shard string, offset long, length long")
    return stored(index, "media-index")


def media_columns(index: DataFrame) -> DataFrame:
    """Metadata (from header ranges) and features (from whole payloads) of what ``store_media`` stored,
    one row per document."""
    rows = index.sortWithinPartitions("shard", "offset")
    return rows.mapInArrow(
        _read, "row long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
        "media_sha256 string, feature string, media_width int, media_height int, media_bits int")
