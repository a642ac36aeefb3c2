"""Media columns: content-addressed payloads in tar shards.

A document's text, padded with zeros to whole rows of 64 bytes, is stored losslessly as an 8-bit
grey PNG of that width. Each task appends the payloads it meets to tar shards in the shared folder,
each content once a task; rows carry digest, shard, offset and length. Contents that several tasks
stored are known by the first place. Reads go back by range: 33 bytes fill the columns that the
header tells, the rest is read where a feature needs the samples.

Shards are named by task attempt, and rows name the shard, so that lost executors and repeated
attempts leave at worst a shard that no row points to.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WIDTH = 64
HEADER = 33
#: Bytes after which a task begins another shard.
SHARD_BYTES = 256 << 20
LEVEL = 6
_MAGIC = b"\x89PNG\r\n\x1a\n"


def payload_of(text: bytes) -> bytes:
    return text + b"\0" * (-len(text) % WIDTH or (0 if text else WIDTH))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode(payload: bytes) -> bytes:
    """An 8-bit grey PNG, ``WIDTH`` samples wide."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)  # a zero before each row: no filter
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _MAGIC + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def header(start: bytes) -> tuple[int, int, int]:
    """Width, height and bit depth, from the first ``HEADER`` bytes."""
    if len(start) < HEADER or start[:8] != _MAGIC or zlib.crc32(start[12:29]) != struct.unpack(">I", start[29:33])[0]:
        raise ValueError("not the header of a stored payload")
    return struct.unpack(">IIB", start[16:25])


def decode(media: bytes) -> bytes:
    width, height, _ = header(media[:HEADER])
    at, data = HEADER, []
    while at < len(media):
        (size,) = struct.unpack(">I", media[at : at + 4])
        if media[at + 4 : at + 8] == b"IDAT":
            data.append(media[at + 8 : at + 8 + size])
        at += size + 12
    return np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, width + 1)[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Mean and deviation of the samples, and an average hash of eight by eight areas."""
    x = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    bands = np.array_split(np.arange(len(x)), 8)
    area = np.array([[x[b, c : c + 8].mean(dtype=float) if len(b) else 0.0 for c in range(0, WIDTH, 8)] for b in bands])
    bits = "".join("01"[int(v)] for v in (area > x.mean(dtype=float)).ravel())
    return f"{x.mean(dtype=float):.3f}/{x.std(dtype=float):.3f}/{int(bits, 2):016x}"


class _Shards:
    """A task's shards."""

    def __init__(self, folder: str) -> None:
        self.files, self.path = fs.FileSystem.from_uri(folder)
        self.files.create_dir(self.path, recursive=True)
        self.name, self.out, self.size = "", None, 0

    def add(self, name: str, data: bytes) -> tuple[str, int]:
        if self.out is None or self.size > SHARD_BYTES:
            self.close()
            self.name, self.size = f"{uuid.uuid4().hex}.tar", 0
            self.out = self.files.open_output_stream(f"{self.path}/{self.name}")
        info = tarfile.TarInfo(name)
        info.size = len(data)
        head = info.tobuf(tarfile.USTAR_FORMAT)
        self.out.write(head + data + b"\0" * (-len(data) % 512))
        at = self.size + len(head)
        self.size = at + len(data) + -len(data) % 512
        return self.name, at

    def close(self) -> None:
        if self.out is not None:
            self.out.write(b"\0" * 1024)
            self.out.close()
            self.out = None


def store(docs: DataFrame, folder: str) -> DataFrame:
    """Write all payloads; (doc_id, n_bytes, digest, shard, offset, length) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards, known = _Shards(folder), {}
        for batch in batches:
            data, bounds = common.utf8(batch.column(1))
            out = []
            for r in range(len(bounds) - 1):
                payload = payload_of(data[bounds[r] : bounds[r + 1]].tobytes())
                digest = hashlib.sha256(payload).hexdigest()
                if digest not in known:
                    media = encode(payload)
                    known[digest] = *shards.add(f"{digest}.png", media), len(media)
                out.append((int(bounds[r + 1] - bounds[r]), digest, *known[digest]))
            n, digest, shard, offset, length = zip(*out, strict=True) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.string()), pa.array(shard, pa.string()), pa.array(offset, pa.int64()), pa.array(length, pa.int64())], names=["doc_id", "n_bytes", "digest", "shard", "offset", "length"])
        shards.close()

    return common.cut(docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, digest string, shard string, offset long, length long"))


def media_table(stored: DataFrame) -> DataFrame:
    """(digest, shard, offset, length): the first place of each content."""
    return stored.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("m")).select("digest", "m.*")


def read_columns(media: DataFrame, folder: str, samples: bool = True) -> DataFrame:
    """``media`` with width, height and depth from range reads of the headers and, if ``samples``, what the stored bytes hold."""
    extra = "width long, height long, depth long" + ", payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" * samples
    names = [x.split()[0] for x in extra.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = fs.FileSystem.from_uri(folder)
        name, file = None, None
        for batch in batches:
            out: dict[str, list] = {k: [] for k in names}
            for shard, offset, length in zip(*(batch.column(k).to_pylist() for k in ("shard", "offset", "length")), strict=True):
                if shard != name:
                    name, file = shard, files.open_input_file(f"{path}/{shard}")
                row = header(file.read_at(HEADER, offset))
                if samples:
                    stored = file.read_at(length, offset)
                    payload = decode(stored)
                    row += len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(payload)
                for k, v in zip(names, row, strict=True):
                    out[k].append(v)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(v, pa.string() if k in ("payload_sha256", "media_sha256", "feature") else pa.int64()) for k, v in out.items())], names=[*batch.schema.names, *names])

    n = common.partitions_for(media.sparkSession)
    return media.select("digest", "shard", "offset", "length").repartitionByRange(n, "shard", "offset").sortWithinPartitions("shard", "offset").mapInArrow(run, "digest string, shard string, offset long, length long, " + extra)


def with_media(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """Store the payload of every row of ``docs`` and add its media columns, read back.

    A null or empty text is one row of zeros. Equal texts share one payload; repeated rows and null
    ids keep their rows. Only doc_id and text are read, so names of other columns can't clash.
    """
    folder = folder or common.shared_dir(docs.sparkSession) + "/media"
    stored = store(docs, folder)
    columns = read_columns(media_table(stored), folder)
    return stored.select("doc_id", "n_bytes", "digest").join(columns, "digest")


def op6(spark, sf_dir: str) -> DataFrame:
    """Store all documents as media, read them back and describe them."""
    common.small_batches(spark)
    out = with_media(common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height", "depth", "shard", "offset", "length")
