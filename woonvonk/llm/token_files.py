"""Token ids as binary files with a shared zstandard dictionary, one frame per document, and an offset index.

A folder holds one dictionary and any number of files. A file is: header (magic, digest of the dictionary, bytes per id), the
frames of its documents one after the other, the index (doc_id, where its frame ends, where its ids end), and a footer
that says where the index starts. A reader needs the footer, the index and one frame to get at one document; a file
whose digest isn't that of the dictionary at hand is refused.

The dictionary is trained on the id arrays of a bounded sample of documents (about ``SAMPLE_ROWS``, those with the smallest
hashes, none longer than ``SAMPLE_CHARS``); it changes the size of the files, never what is read from them. All documents are
encoded and compressed where they are read; only the frames are dealt by ranges of (doc_id, order of arrival), so
documents lie in ascending doc_id order over files and ranges are even whatever doc_id holds. A task writes files under names
of its own, and the manifest, written by Spark, names those of the tasks that count; what a lost executor leaves behind
is never read. Places before a document are sums of one number per file.

Null texts are empty: the closing id alone. Null ids come first. Repeated rows are kept each, in order of arrival. No rows give
no files. Other columns of ``docs``, whatever their names, are not looked at.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from woonvonk.llm import bpe
from woonvonk.llm.common import table, written
from woonvonk.session import scratch_path

END = 2  # the id that closes every document
LEVEL = 3
DICTIONARY_BYTES = 110_000
SAMPLE_ROWS = 2_000
SAMPLE_CHARS = 65_536
# A file is closed at this many bytes of frames or documents.
FILE_BYTES = 64 << 20
FILE_DOCS = 1 << 20

MAGIC = b"TOKENS01"
HEADER = struct.Struct("<8s32sQ")
FOOTER = struct.Struct("<QQ8s")
MANIFEST = "shard long, part long, file string, n_docs long, n_ids long, n_bytes long"
INDEX = np.dtype([("doc_id", "<i8"), ("known", "<u8"), ("frame_end", "<u8"), ("ids_end", "<u8")])


def _place(path: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(path)


def trained(samples: list[bytes]) -> bytes:
    """A dictionary for id arrays like ``samples``; empty where there is too little to train on."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def _prepared(dictionary: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(dictionary) if dictionary else None


class FileWriter:
    """Writes one file; ``close`` gives its manifest row without shard and part."""

    def __init__(self, folder: str, dictionary: bytes, width: int):
        self.path = f"{folder}/{uuid.uuid4().hex}.tokens"
        place, name = _place(self.path)
        self.out = place.open_output_stream(name)
        self.out.write(HEADER.pack(MAGIC, hashlib.sha256(dictionary).digest(), width))
        self.rows: list[tuple[int, int, int, int]] = []
        self.size = self.n_ids = 0

    def add(self, doc_id: int | None, frame: bytes, n_ids: int) -> None:
        self.out.write(frame)
        self.size += len(frame)
        self.n_ids += n_ids
        self.rows.append((doc_id or 0, doc_id is not None, self.size, self.n_ids))

    def full(self, docs: int) -> bool:
        return self.size >= FILE_BYTES or len(self.rows) >= docs

    def close(self) -> tuple[str, int, int, int]:
        self.out.write(np.array(self.rows, INDEX).tobytes())
        self.out.write(FOOTER.pack(len(self.rows), HEADER.size + self.size, MAGIC))
        self.out.close()
        return self.path, len(self.rows), self.n_ids, self.size


class FileReader:
    """Reads one file of ``FileWriter``, whole or a document at a time."""

    def __init__(self, path: str, dictionary: bytes):
        place, name = _place(path)
        self.file = place.open_input_file(name)
        total = self.file.size()
        magic, digest, self.width = HEADER.unpack(self.file.read_at(HEADER.size, 0))
        n, at, end = FOOTER.unpack(self.file.read_at(FOOTER.size, total - FOOTER.size))
        if magic != MAGIC or end != MAGIC:
            raise ValueError(f"not a file of token ids: {path}")
        if digest != hashlib.sha256(dictionary).digest():
            raise ValueError(f"written with another dictionary: {path}")
        self.index = np.frombuffer(self.file.read_at(n * INDEX.itemsize, at), INDEX)
        self.decompress = zstandard.ZstdDecompressor(dict_data=_prepared(dictionary)).decompress

    def frame(self, i: int) -> bytes:
        start = int(self.index["frame_end"][i - 1]) if i else 0
        return self.file.read_at(int(self.index["frame_end"][i]) - start, HEADER.size + start)

    def ids(self, frame: bytes) -> np.ndarray:
        return np.frombuffer(self.decompress(frame), f"<u{self.width}").astype("<u4")

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, ids of the file before it, ids) of all documents, in order; reads some MB at a time."""
        ends = self.index["frame_end"].astype(np.int64)
        before = np.append(0, self.index["ids_end"][:-1]).astype(np.int64).tolist()
        ids, known = self.index["doc_id"].tolist(), self.index["known"].tolist()
        i = 0
        while i < len(ends):
            start = int(ends[i - 1]) if i else 0
            stop = max(i + 1, int(np.searchsorted(ends, start + (4 << 20), side="right")))
            held = memoryview(self.file.read_at(int(ends[stop - 1]) - start, HEADER.size + start))
            for k in range(i, stop):
                a = int(ends[k - 1]) - start if k else 0
                yield ids[k] if known[k] else None, before[k], self.ids(held[a : int(ends[k]) - start])
            i = stop

    def places(self, path: str, base: int) -> pa.RecordBatch:
        """Where each frame lies, and the ids before it with ``base`` in the files before."""
        frame_end, ids_end = (self.index[c].astype(np.int64) for c in ("frame_end", "ids_end"))
        size, n = np.diff(frame_end, prepend=0), np.diff(ids_end, prepend=0)
        doc_ids = pa.array(self.index["doc_id"], mask=self.index["known"] == 0)
        columns = [doc_ids, pa.array([path] * len(n)), *map(pa.array, (frame_end - size + HEADER.size, size, ids_end - n + base, n))]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "file", "frame", "size", "start", "n_tokens"])

    def close(self) -> None:
        self.file.close()


@dataclass
class TokenFiles:
    """A written folder: its files with what lies before them, and the dictionary they share."""

    manifest: DataFrame  # MANIFEST and ``start``: ids in all files before
    dictionary: bytes
    folder: str


def _sample(docs: DataFrame, settings, width: int) -> list[bytes]:
    """Id arrays of the sample; at most twice SAMPLE_ROWS of SAMPLE_CHARS reach the driver."""

    def run(batches):
        own = bpe.codec(settings.value)
        for batch in batches:
            for _, ids, ends in own.encode_all(batch.column(0)):
                rows = [r.astype(f"<u{width}").tobytes() for r in np.split(ids, ends[:-1])]
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], names=["ids"])

    # in expectation SAMPLE_ROWS of all rows, wherever they are; no task gets more than a few times that
    share = int((1 << 31) * min(1.0, SAMPLE_ROWS / max(1, docs.count())))
    h = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 31))
    chosen = docs.where(F.length("text").between(1, SAMPLE_CHARS) & (h < share)).limit(2 * SAMPLE_ROWS).select("text")
    return [bytes(r[0]) for r in chosen.mapInArrow(run, "ids binary").collect()]


def write(docs: DataFrame, folder: str, path: str = bpe.VOCABULARY, end: int = END, file_docs: int = FILE_DOCS) -> TokenFiles:
    """Write the ids of every row of ``docs`` (doc_id, text), closed by ``end``, as files in ``folder``."""
    spark = docs.sparkSession
    raw = bpe.model_settings(path)
    width = 2 if bpe.largest_id(raw) < 1 << 16 else 4
    settings = spark.sparkContext.broadcast(raw)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    dictionary = trained(_sample(docs, settings, width))
    place, name = _place(folder)
    place.create_dir(name, recursive=True)
    with place.open_output_stream(f"{name}/dictionary-{hashlib.sha256(dictionary).hexdigest()}") as out:
        out.write(dictionary)
    shared = spark.sparkContext.broadcast(dictionary)

    def compress(batches):
        own, task, row = bpe.codec(settings.value), TaskContext.get().partitionId(), 0
        press = zstandard.ZstdCompressor(level=LEVEL, dict_data=_prepared(shared.value)).compress
        for batch in batches:
            for first, ids, ends in own.encode_all(batch.column(1)):
                narrow, frames, at = ids.astype(f"<u{width}"), [], 0
                for stop in ends.tolist():
                    frames.append(press(np.append(narrow[at:stop], narrow.dtype.type(end)).tobytes()))
                    at = stop
                n = len(frames)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, n),
                        pa.array(np.full(n, task, np.int64)),
                        pa.array(np.arange(row, row + n)),
                        pa.array(np.diff(ends, prepend=0) + 1),
                        pa.array(frames, pa.binary()),
                    ],
                    names=["doc_id", "task", "row", "n_ids", "frame"],
                )
                row += n

    frames = written(docs.mapInArrow(compress, "doc_id long, task long, row long, n_ids long, frame binary"), "frames")
    size = frames.agg(F.sum(F.length("frame")).alias("s")).first().s or 0
    parts = max(spark.sparkContext.defaultParallelism, -(-size // FILE_BYTES))
    order = ["doc_id", "task", "row"]

    def save(batches):
        shard, part, file, done = TaskContext.get().partitionId(), 0, None, []
        for batch in batches:
            for doc_id, frame, n in zip(batch.column(0).to_pylist(), batch.column(4), batch.column(3).to_pylist()):
                file = file or FileWriter(folder, shared.value, width)
                file.add(doc_id, frame.as_buffer(), n)
                if file.full(file_docs):
                    done.append((shard, part, *file.close()))
                    part, file = part + 1, None
        if file:
            done.append((shard, part, *file.close()))
        if done:
            names = ["shard", "part", "file", "n_docs", "n_ids", "n_bytes"]
            yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*done)))))

    dealt = frames.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    listed = written(dealt.mapInArrow(save, MANIFEST), "manifest")
    # one row per file
    before = F.sum("n_ids").over(Window.orderBy("shard", "part").rowsBetween(Window.unboundedPreceding, -1))
    return TokenFiles(written(listed.withColumn("start", F.coalesce(before, F.lit(0))), "manifest"), dictionary, folder)


def _each_file(files: TokenFiles, run, schema: str) -> DataFrame:
    n = max(1, files.manifest.count())
    return files.manifest.repartitionByRange(n, "start", "file").select("file", "start").mapInArrow(run, schema)


def read(files: TokenFiles) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of all documents; ``start`` counts the ids of all documents before, ``ids`` is
    binary, little-endian unsigned 32-bit."""
    shared = files.manifest.sparkSession.sparkContext.broadcast(files.dictionary)

    def run(batches):
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                file, rows, held = FileReader(path, shared.value), [], 0
                for doc_id, before, ids in file.documents():
                    rows.append((doc_id, base + before, len(ids), ids.tobytes()))
                    held += len(ids)
                    if held >= 1 << 20 or len(rows) >= 10_000:
                        yield _rows(rows)
                        rows, held = [], 0
                if rows:
                    yield _rows(rows)
                file.close()

    return _each_file(files, run, "doc_id long, start long, n_tokens long, ids binary")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["doc_id", "start", "n_tokens", "ids"])


def index(files: TokenFiles) -> DataFrame:
    """(doc_id, file, frame, size, start, n_tokens): where each document's frame lies; no frame is read."""
    shared = files.manifest.sparkSession.sparkContext.broadcast(files.dictionary)

    def run(batches):
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                file = FileReader(path, shared.value)
                yield file.places(path, base)
                file.close()

    return _each_file(files, run, "doc_id long, file string, frame long, size long, start long, n_tokens long")


def fetch(files: TokenFiles, wanted: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of the documents that ``wanted`` (doc_id) names; reads their frames alone."""
    shared = files.manifest.sparkSession.sparkContext.broadcast(files.dictionary)
    found = index(files).join(wanted.select(F.col("doc_id").cast("long")).distinct(), "doc_id")

    def run(batches):
        path, file = None, None
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if r["file"] != path:
                    if file:
                        file.close()
                    path, file = r["file"], FileReader(r["file"], shared.value)
                ids = file.ids(file.file.read_at(r["size"], r["frame"]))
                rows.append((r["doc_id"], r["start"], len(ids), ids.tobytes()))
            if rows:
                yield _rows(rows)
        if file:
            file.close()

    dealt = found.repartition("file").sortWithinPartitions("file", "frame")
    return dealt.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = write(table(spark, sf_dir, "documents"), scratch_path(spark, "token-files"))
    return read(files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
