"""Token ids in seekable zstandard files.

Each document's token ids are one independent zstandard frame, and a file ends with a seek table in the public seekable format (a
skippable frame with the compressed and decompressed size and a checksum of every frame, and a footer), so a reader fetches and
decompresses only the documents it asks for. Tasks write one file after another without any shuffle, under a name that a second attempt of the
task doesn't share; the manifest names the files of the attempt that counted.

Defined results: an empty text is a frame of no tokens; a null text has no frame (its file, frame, n_tokens and checksum are null); a null doc_id is kept
as it is; repeated rows are written as often as they occur; an empty table gives an empty manifest; further columns are ignored; texts are
encoded whole.
"""

from __future__ import annotations

import base64
import os
import struct
import uuid

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm.common import Scratch, read_table

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
FILE_BYTES = 64 << 20
LEVEL = 3
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
_encoders: dict[str, object] = {}


def encoder(path: str = TOKENIZER):
    """The tokenizer of a ranks file, loaded once a process."""
    if path not in _encoders:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[path] = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def checksum(raw: bytes) -> int:
    return xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF


class FrameWriter:
    """Writes frames to a stream, and the seek table at close."""

    def __init__(self, stream, level: int = LEVEL):
        self.stream = stream
        self.zstd = zstandard.ZstdCompressor(level=level, write_checksum=False, write_content_size=True)
        self.entries: list[tuple[int, int, int]] = []
        self.bytes = 0

    def add(self, raw: bytes) -> tuple[int, int]:
        """(number of the frame, its checksum)."""
        frame = self.zstd.compress(raw)
        self.stream.write(frame)
        self.entries.append((len(frame), len(raw), checksum(raw)))
        self.bytes += len(frame)
        return len(self.entries) - 1, self.entries[-1][2]

    def close(self) -> None:
        table = b"".join(struct.pack("<III", *e) for e in self.entries)
        footer = struct.pack("<IBI", len(self.entries), 0x80, SEEKABLE)
        self.stream.write(struct.pack("<II", SKIPPABLE, len(table) + len(footer)) + table + footer)
        self.stream.close()


class FrameReader:
    """Reads single frames of a seekable file."""

    def __init__(self, uri: str):
        system, path = _open(uri)
        self.file = system.open_input_file(path)
        size = self.file.size()
        n, flags, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEKABLE or flags != 0x80:
            raise ValueError(f"{uri} has no seek table with checksums")
        raw = self.file.read_at(12 * n, size - 9 - 12 * n)
        self.table = np.frombuffer(raw, "<u4").reshape(n, 3)
        self.offset = np.concatenate([[0], np.cumsum(self.table[:, 0].astype(np.int64))])
        self.zstd = zstandard.ZstdDecompressor()

    def __len__(self) -> int:
        return len(self.table)

    def read(self, frame: int) -> bytes:
        packed, size, want = (int(x) for x in self.table[frame])
        raw = self.zstd.decompress(self.file.read_at(packed, int(self.offset[frame])), max_output_size=max(1, size))
        if len(raw) != size or checksum(raw) != want:
            raise ValueError(f"frame {frame} is damaged")
        return raw


def read_tokens(reader: FrameReader, frame: int, width: int = 2) -> np.ndarray:
    return np.frombuffer(reader.read(frame), "<u2" if width == 2 else "<u4")


_FIELDS = [("doc_id", pa.int64()), ("file", pa.string()), ("frame", pa.int32()), ("n_tokens", pa.int32()), ("checksum", pa.int64()), ("width", pa.int32())]
MANIFEST = "doc_id long, file string, frame int, n_tokens int, checksum long, width int"


def write_tokens(spark: SparkSession, docs: DataFrame, folder: str, tokenizer: str = TOKENIZER, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Lazily: the manifest whose evaluation writes the files. Call it through a written table, so that it's evaluated once."""

    def run(batches):
        enc = encoder(tokenizer)
        width = 2 if enc.n_vocab <= 1 << 16 else 4
        kind = "<u2" if width == 2 else "<u4"
        system, path = _open(folder)
        system.create_dir(path, recursive=True)
        context = TaskContext.get()
        part = context.partitionId() if context else 0
        stem = f"tokens-{part:06d}-{uuid.uuid4().hex}"
        writer, rows, n = None, [], 0
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if text is None:
                    rows.append((doc_id, None, None, None, None, width))
                    continue
                if writer is None:
                    name = f"{stem}-{n:04d}.zst"
                    n += 1
                    writer = FrameWriter(system.open_output_stream(f"{path}/{name}", compression=None))
                ids = enc.encode_ordinary(text)
                frame, check = writer.add(np.array(ids, kind).tobytes())
                rows.append((doc_id, name, frame, len(ids), check, width))
                if writer.bytes >= file_bytes:
                    writer.close()
                    writer = None
                    yield _batch(rows)
                    rows = []
        if writer is not None:
            writer.close()
        if rows:
            yield _batch(rows)

    return docs.select("doc_id", "text").mapInArrow(run, MANIFEST)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), _FIELDS)], [n for n, _ in _FIELDS])


def write_token_files(spark: SparkSession, docs: DataFrame, tokenizer: str = TOKENIZER) -> tuple[str, DataFrame]:
    """(folder, manifest); the files are complete when it returns."""
    scratch = Scratch(spark, "tokens")
    folder = scratch.path("data")
    return folder, scratch.table(write_tokens(spark, docs, folder, tokenizer), "manifest")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of the files that hold every document's tokens."""
    return write_token_files(spark, read_table(spark, sf_dir, "documents"))[1]
