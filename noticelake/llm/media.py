"""Media columns: content-addressed payloads in tar shards, rows with digest, offset and length.

A payload is stored losslessly as an 8-bit greyscale PNG, 64 samples a line, under its digest's name
in a tar shard. Every task writes its own shards into the shared folder and returns one manifest row
per input row; equal payloads of a shard are stored once. Reading goes the other way: a range read
of the image header alone fills the metadata columns, a range read of the member the payload.

Scale: a shard is closed at ``shard_bytes``, so tasks hold one shard's index and one batch. Shard
names are drawn anew by every attempt, the manifest names the attempt that ended well, and shards of
lost attempts, which it does not name, are deleted by tasks. Nothing is shuffled but shard names.
"""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticelake.llm.common import prepare
from noticelake.storage import cut, fresh_path

WIDTH = 64
#: Bytes of a PNG's signature and first chunk, which hold all of its metadata.
HEADER = 33
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def padded(data: bytes) -> bytes:
    """``data`` with zero bytes up to the next positive multiple of the line width."""
    return data + bytes(-len(data) % WIDTH if data else WIDTH)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(payload: bytes) -> bytes:
    """A greyscale PNG whose samples, line by line, are the payload's bytes."""
    height = len(payload) // WIDTH
    lines = np.zeros((height, WIDTH + 1), np.uint8)  # every line starts with filter type 0
    lines[:, 1:] = np.frombuffer(payload, np.uint8).reshape(height, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, height, 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 3)) + _chunk(b"IEND", b"")


def read_header(head: bytes) -> tuple[int, int, int, int]:
    """Width, height, bit depth and colour type from the first ``HEADER`` bytes of a PNG."""
    if head[:8] != _SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("not a PNG")
    return struct.unpack(">IIBB", head[16:26])


def from_png(data: bytes) -> bytes:
    """The samples of a PNG that ``to_png`` wrote."""
    width, height, depth, colour = read_header(data)
    if (width, depth, colour) != (WIDTH, 8, 0):
        raise ValueError("not a payload image")
    body, at = [], HEADER
    while at < len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        if kind == b"IDAT":
            body.append(data[at + 8 : at + 8 + size])
        at += size + 12
    lines = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, width + 1)
    if lines[:, 0].any():
        raise ValueError("unexpected line filter")
    return lines[:, 1:].tobytes()


def feature(payload: bytes, header: tuple[int, int, int, int]) -> str:
    """Format and size from the header; mean, spread and entropy of the samples."""
    counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    p = counts / counts.sum()
    level = np.arange(256)
    mean = float(p @ level)
    spread = float(np.sqrt(max(p @ (level - mean) ** 2, 0.0)))
    used = p[p > 0]
    return f"png:{header[0]}x{header[1]}x{header[2]}:mean={mean:.4f}:sd={spread:.4f}:bits={float(-(used * np.log2(used)).sum()) + 0.0:.4f}"


class _Shard:
    """A tar file in the making; its members start at known offsets."""

    def __init__(self, root: str):
        self.where = f"{root}/{uuid.uuid4().hex}.tar"
        self.store, path = fs.FileSystem.from_uri(self.where)
        self.store.create_dir(path.rsplit("/", 1)[0], recursive=True)
        self.sink = self.store.open_output_stream(path)
        self.at, self.known = 0, {}

    def add(self, digest: str, data: bytes) -> tuple[int, int]:
        if digest not in self.known:
            member = tarfile.TarInfo(f"{digest[:2]}/{digest}.png")
            member.size = len(data)
            head = member.tobuf(tarfile.USTAR_FORMAT)
            self.known[digest] = (self.at + len(head), len(data))
            self.at += self.sink.write(head + data + bytes(-len(data) % tarfile.BLOCKSIZE))
        return self.known[digest]

    def close(self) -> None:
        self.sink.write(bytes(2 * tarfile.BLOCKSIZE))
        self.sink.close()


def _uri(path: str) -> str:
    return path if ":" in path.split("/")[0] else f"file://{path}"


#: What the headers tell of a stored payload.
_METADATA = "width long, height long, depth long"
_MANIFEST = "key long, n_bytes long, payload_bytes long, digest string, shard string, offset long, length long"


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", shard_bytes: int = 1 << 24) -> DataFrame:
    """Writes the texts' payloads into tar shards; returns the stored manifest, a row per row.

    ``digest`` is the SHA-256 of the stored image, ``offset`` and ``length`` its place in ``shard``.
    Null counts as empty and is stored as one line of zeros. Repeated rows and null keys are kept.
    """
    spark = docs.sparkSession
    prepare(spark)
    root = _uri(fresh_path(spark, "media"))

    def write(batches):
        shard = None
        for batch in batches:
            rows = []
            for key_, value in zip(batch["key"].to_pylist(), batch["text"].to_pylist(), strict=True):
                raw = (value or "").encode("utf-8")
                payload = padded(raw)
                image = to_png(payload)
                digest = hashlib.sha256(image).hexdigest()
                shard = shard or _Shard(root)
                rows.append((key_, len(raw), len(payload), digest, shard.where, *shard.add(digest, image)))
                if shard.at >= shard_bytes:
                    shard.close()
                    shard = None
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["key", "n_bytes", "payload_bytes", "digest", "shard", "offset", "length"]) if rows else batch.slice(0, 0)
        if shard:
            shard.close()

    rows = docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    manifest = cut(rows.mapInArrow(write, _MANIFEST), "media-manifest")
    _sweep(manifest, root)
    return manifest


def _sweep(manifest: DataFrame, root: str) -> int:
    """Deletes the shards under ``root`` that the manifest does not name; returns how many."""
    spark = manifest.sparkSession
    if manifest.isEmpty():
        return 0
    there = spark.read.format("binaryFile").load(root).select(F.substring_index("path", "/", -1).alias("name"))
    lost = there.join(manifest.select(F.substring_index("shard", "/", -1).alias("name")).distinct(), "name", "left_anti")

    def delete(batches):
        for batch in batches:
            names = batch["name"].to_pylist()
            for name in names:
                store, path = fs.FileSystem.from_uri(f"{root}/{name}")
                store.delete_file(path)
            yield pa.RecordBatch.from_arrays([pa.array([len(names)], pa.int64())], ["n"])

    return lost.mapInArrow(delete, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


class _Open:
    """The shard that is being read, one at a time."""

    def __init__(self) -> None:
        self.name, self.file = None, None

    def at(self, shard: str):
        if shard != self.name:
            self.close()
            store, path = fs.FileSystem.from_uri(shard)
            self.name, self.file = shard, store.open_input_file(path)
        return self.file

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
        self.name, self.file = None, None


def headers(manifest: DataFrame) -> DataFrame:
    """The manifest with ``width``, ``height`` and ``depth``, from reads of the headers alone."""

    def read(batches):
        held = _Open()
        for batch in batches:
            got = []
            for shard, offset in zip(batch["shard"].to_pylist(), batch["offset"].to_pylist(), strict=True):
                got.append(read_header(held.at(shard).read_at(HEADER, offset)))
            for i, name in enumerate(("width", "height", "depth")):
                batch = batch.append_column(name, pa.array([g[i] for g in got], pa.int64()))
            yield batch
        held.close()

    return manifest.mapInArrow(read, f"{_MANIFEST}, {_METADATA}")


def read_back(manifest: DataFrame) -> DataFrame:
    """Reads every row's stored bytes: digests, the checksum of the last line, and the feature.

    ``manifest`` has the metadata columns that ``headers`` fills.
    """
    names = ["payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def of(data: bytes) -> tuple:
        payload = from_png(data)
        return hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(data), hashlib.sha256(data).hexdigest(), feature(payload, read_header(data))

    def read(batches):
        held, done = _Open(), {}
        for batch in batches:
            got = []
            for shard, offset, length in zip(batch["shard"].to_pylist(), batch["offset"].to_pylist(), batch["length"].to_pylist(), strict=True):
                if held.name != shard:
                    done = {}
                if offset not in done:
                    done[offset] = of(held.at(shard).read_at(length, offset))
                got.append(done[offset])
            columns = list(zip(*got, strict=True)) or [[]] * 5
            for name, values, kind in zip(names, columns, (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True):
                batch = batch.append_column(name, pa.array(list(values), kind))
            yield batch
        held.close()

    # rows of a shard lie together as they were written; a scan keeps them so, and nothing is shuffled
    return manifest.mapInArrow(read, f"{_MANIFEST}, {_METADATA}, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
