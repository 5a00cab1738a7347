"""Media columns: payloads in archives on shared storage, and a data source that streams them back.

An archive is a file of members (header, then the stored bytes) with an index of offsets at its end. Tasks write archives
of their own under attempt-proof names; a manifest table, committed by Spark, lists those of the tasks that succeeded. The
data source plans byte ranges over the archives of a manifest: a range owns the members whose headers begin in it. Readers
stream batches of about BATCH bytes through Arrow. A member that can't be read or fails its checksum is tried again by its
offset, apart from the others, TRIES times; then the read fails, or with on_error=row gives a row with the error.

Stored form of a payload: a grey PNG, 64 samples wide, of 8 bits; lossless, and without a time stamp, so that equal texts
have equal media.

Defined results: null and empty texts give one row of 64 zero samples; doc_id may be null or repeat; every row has its own
member; texts are whole; extra columns don't matter; an empty table makes no archive and gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import common

WIDTH, LEVEL = 64, 3
RANGE, BATCH, TRIES = 16 << 20, 4 << 20, 3
#: Ranges of a plan, about, beyond one an archive.
MOST = 50_000

#: Header of a member: mark, flags (1: doc_id is null), doc_id, bytes of the text, bytes stored, CRC-32 of these.
_HEADER = struct.Struct("<4sBqqqI")
_MARK, _END = b"LXM1", b"LXE1"
_TAIL = struct.Struct("<qq4s")


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes) -> bytes:
    """payload: a positive multiple of WIDTH bytes."""
    rows = np.zeros((len(payload) // WIDTH, WIDTH + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def from_png(media: bytes) -> bytes:
    """The samples of what to_png made."""
    at, data = 8, []
    while at < len(media):
        n, kind = struct.unpack_from(">I4s", media, at)
        body = media[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", media, at + 8 + n)[0]:
            raise ValueError("a chunk is damaged")
        if kind == b"IDAT":
            data.append(body)
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(-1, WIDTH + 1)
    if rows[:, 0].any():
        raise ValueError("filtered rows aren't expected")
    return rows[:, 1:].tobytes()


def payload_of(text: bytes | None) -> bytes:
    text = text or b""
    return text + bytes(-len(text) % WIDTH) if text else bytes(WIDTH)


def feature_of(payload: bytes) -> str:
    """Sixteen-bin histogram (shares of 255) and the mean step between neighbours, in hexadecimal."""
    x = np.frombuffer(payload, np.uint8)
    bins = np.bincount(x >> 4, minlength=16) * 255 // len(x)
    step = int(np.abs(np.diff(x.astype(np.int16))).sum()) // len(x)
    return bins.astype(np.uint8).tobytes().hex() + f"{step:02x}"


def _open(path: str):
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path)
    return system, inner


def _uri(path: str) -> str:
    return path if "://" in path else "file://" + path.removeprefix("file:") if path.startswith(("file:", "/")) else path


def _packed_member(doc_id: int | None, text: bytes | None, media: bytes) -> bytes:
    return _HEADER.pack(_MARK, doc_id is None, doc_id or 0, len(text or b""), len(media), zlib.crc32(media)) + media


def _packed_index(offsets: list[int], end: int) -> bytes:
    return np.array(offsets, "<i8").tobytes() + _TAIL.pack(end, len(offsets), _END)


def write_archives(docs: DataFrame) -> str:
    """Stores each row's text; returns the folder of the manifest (path, bytes, members)."""
    spark = docs.sparkSession
    folder = common.scratch(spark, "media")
    archives = _uri(f"{folder}/archives")
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(f"{folder}/archives")
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(p)

    def run(batches):
        out, offsets, system, path = None, [], None, f"{archives}/{uuid.uuid4().hex}.lxm"
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), common.as_bytes(batch.column(1)), strict=True):
                if out is None:
                    system, inner = _open(path)
                    out = system.open_output_stream(inner)
                media = to_png(payload_of(text))
                offsets.append(out.tell())
                out.write(_packed_member(doc_id, text, media))
        if out is not None:
            end = out.tell()
            out.write(_packed_index(offsets, end))
            size = out.tell()
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "bytes": [size], "members": [len(offsets)]})

    manifest = f"{folder}/manifest"
    docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "path string, bytes long, members long").write.parquet(manifest)
    return manifest


class Range(InputPartition):
    def __init__(self, path: str, start: int, end: int) -> None:
        self.path, self.start, self.end = path, start, end


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.manifest, self.range = _uri(options["path"]), int(options.get("range_bytes", RANGE))
        self.tries, self.fail = int(options.get("tries", TRIES)), options.get("on_error", "fail") == "fail"

    def partitions(self) -> list[Range]:
        import pyarrow.dataset as ds

        system, inner = _open(self.manifest)
        rows = ds.dataset(inner, filesystem=system, format="parquet", exclude_invalid_files=True).to_table(columns=["path", "bytes"]).to_pylist()
        step = max(self.range, sum(r["bytes"] for r in rows) // MOST)  # the driver lists the ranges, so their number is bounded
        found = [Range(r["path"], at, min(at + step, r["bytes"])) for r in sorted(rows, key=lambda r: r["path"]) for at in range(0, r["bytes"], step)]
        return found or [Range("", 0, 0)]

    def _member(self, system, inner: str, file, at: int) -> tuple:
        """(null, doc_id, text bytes, media, error), with new tries at this offset alone."""
        why = ""
        for attempt in range(self.tries):
            try:
                with _Held(file) if attempt == 0 else system.open_input_file(inner) as f:
                    f.seek(at)
                    mark, null, doc_id, n, stored, crc = _HEADER.unpack(f.read(_HEADER.size))
                    media = f.read(stored)
                if mark != _MARK or len(media) != stored or zlib.crc32(media) != crc:
                    raise ValueError("the member is damaged")
                return None if null else doc_id, n, media, None
            except (OSError, ValueError, struct.error) as x:
                why = f"{inner} at {at}: {x}"
        if self.fail:
            raise OSError(why)
        return None, None, None, why

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        system, inner = _open(partition.path)
        with system.open_input_file(inner) as file:
            file.seek(file.size() - _TAIL.size)
            end, n, mark = _TAIL.unpack(file.read(_TAIL.size))
            if mark != _END:
                raise OSError(f"{inner} has no index")
            file.seek(end)
            offsets = np.frombuffer(file.read(8 * n), "<i8")
            rows, size = [], 0
            for at in offsets[(offsets >= partition.start) & (offsets < partition.end)].tolist():
                rows.append(self._member(system, inner, file, at))
                size += len(rows[-1][2] or b"")
                if size >= BATCH:
                    yield _batch(rows)
                    rows, size = [], 0
            if rows:
                yield _batch(rows)


class _Held:  # a file that stays open after the block
    def __init__(self, file) -> None:
        self.file = file

    def __enter__(self):
        return self.file

    def __exit__(self, *_) -> None:
        return None


_SCHEMA = "doc_id long, n_bytes long, media binary, error string"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["doc_id", "n_bytes", "media", "error"])


class ArchiveSource(DataSource):
    """spark.read.format("lexigraph_archive").load(manifest folder)"""

    @classmethod
    def name(cls) -> str:
        return "lexigraph_archive"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)


def read_archives(spark: SparkSession, manifest: str, **options: str) -> DataFrame:
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("lexigraph_archive").options(**options).load(manifest)


def described(docs: DataFrame) -> DataFrame:
    """The operator over a table: stores all texts, reads them back, and describes payload and media."""
    rows = read_archives(docs.sparkSession, write_archives(docs))
    sha = lambda b: hashlib.sha256(b).hexdigest()

    def each(_, doc_id, n_bytes, media) -> tuple:
        payload = from_png(media)
        return doc_id, n_bytes, len(payload), sha(payload), zlib.crc32(payload[-WIDTH:]), len(media), sha(media), feature_of(payload)

    return common.map_rows(rows.select("doc_id", "n_bytes", "media"), "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string", each, rows=128)
