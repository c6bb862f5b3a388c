"""Line dedup that can be taken back: exact reference tables per line key, with sharded cuckoo filters in front.

A line's key is the stripped, ASCII-lower-cased line, held as a 128-bit digest. The exact tables hold one posting per
(key, document) and per key the number of documents and the largest of them. Keys that have reached the limit are also
in cuckoo filters, one per shard of the digest space, which accept insertions and deletions; a line that misses its
filter needs no look into the tables. ``insert`` and ``delete`` change tables and filters by the given documents only,
so taking documents out again restores the earlier answer.

Counts are made by map-side aggregation, so a line that stands in a third of all documents is one row per task.
Null or empty texts are one empty line. Rows without doc_id keep all lines and count for no key. Rows that repeat a
doc_id count as one document.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from woonvonk.llm.common import table, written

BLANKS = " \t\n\x0b\x0c\r"
MIN_CHARS = 40
MIN_DOCS = 5
SHARD_KEYS = 50_000
# Filters are sent to the executors up to this size; above it lines go to the exact join untested.
FILTER_BYTES = 64_000_000

KEY = ["k1", "k2"]


class CuckooFilter:
    """Fingerprints of 16 bits in buckets of four; each key has two buckets, one found from the other."""

    SLOTS, KICKS = 4, 500

    def __init__(self, n_keys: int = 0, data: bytes | None = None):
        if data is not None:
            self.slots = np.frombuffer(data, "<u2").reshape(-1, self.SLOTS).copy()
        else:
            size = 1 << max(4, math.ceil(math.log2(max(1, n_keys) / (self.SLOTS * 0.8))))
            self.slots = np.zeros((size, self.SLOTS), "<u2")

    @staticmethod
    def _mixed(x: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)

    def places(self, k1: np.ndarray, k2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        low = np.uint64(len(self.slots) - 1)
        print_ = (k2.astype(np.int64).view(np.uint64) >> np.uint64(48)).astype(np.uint16)
        print_[print_ == 0] = 1
        first = k1.astype(np.int64).view(np.uint64) & low
        return print_, first, (first ^ self._mixed(print_)) & low

    def has(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        print_, a, b = self.places(k1, k2)
        return ((self.slots[a] == print_[:, None]) | (self.slots[b] == print_[:, None])).any(axis=1)

    def insert(self, k1: np.ndarray, k2: np.ndarray) -> bool:
        """False when a key finds no room; the filter must then be built larger from the exact table."""
        low, turn = len(self.slots) - 1, 0
        for p, a, b in zip(*(x.tolist() for x in self.places(k1, k2))):
            for bucket in (a, b):
                free = np.flatnonzero(self.slots[bucket] == 0)
                if len(free):
                    self.slots[bucket, free[0]] = p
                    break
            else:
                bucket = b
                for _ in range(self.KICKS):
                    turn = (turn + 1) % self.SLOTS
                    p, self.slots[bucket, turn] = int(self.slots[bucket, turn]), p
                    bucket = (bucket ^ int(self._mixed(np.array([p]))[0])) & low
                    free = np.flatnonzero(self.slots[bucket] == 0)
                    if len(free):
                        self.slots[bucket, free[0]] = p
                        break
                else:
                    return False
        return True

    def delete(self, k1: np.ndarray, k2: np.ndarray) -> None:
        """Only keys that were inserted may be deleted."""
        for p, a, b in zip(*(x.tolist() for x in self.places(k1, k2))):
            for bucket in (a, b):
                own = np.flatnonzero(self.slots[bucket] == p)
                if len(own):
                    self.slots[bucket, own[0]] = 0
                    break

    @classmethod
    def of(cls, k1: np.ndarray, k2: np.ndarray) -> CuckooFilter:
        room = max(16, len(k1))
        while True:
            made = cls(room)
            if made.insert(k1, k2):
                return made
            room *= 2

    def data(self) -> bytes:
        return self.slots.tobytes()


def line_key(line: str) -> tuple[int, int] | None:
    """The digest of a line's key as two signed longs; None for keys under MIN_CHARS code points."""
    key = line.strip(BLANKS)
    if len(key) < MIN_CHARS:
        return None
    digest = hashlib.blake2b(key.encode().lower(), digest_size=16).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def postings(docs: DataFrame) -> DataFrame:
    """(k1, k2, doc_id): one row per document and key it holds."""

    def run(batches):
        for batch in batches:
            a, b, ids = [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if doc_id is None or not text:
                    continue
                for k1, k2 in {k for line in text.split("\n") if (k := line_key(line))}:
                    a.append(k1), b.append(k2), ids.append(doc_id)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, b, ids)], names=[*KEY, "doc_id"])

    return docs.select("doc_id", "text").mapInArrow(run, "k1 long, k2 long, doc_id long")


def counted(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEY).agg(F.count("*").alias("refs"), F.max("doc_id").alias("top"))


@dataclass
class LineIndex:
    """postings (k1, k2, doc_id), counts (k1, k2, refs, top), filters (shard, filter) over keys with MIN_DOCS refs."""

    postings: DataFrame
    counts: DataFrame
    filters: DataFrame
    n_shards: int


def shard_of(n_shards: int):
    return F.pmod(F.col("k1"), F.lit(n_shards)).cast("int")


def active(counts: DataFrame) -> DataFrame:
    return counts.where(F.col("refs") >= MIN_DOCS)


def build_filters(counts: DataFrame, n_shards: int) -> DataFrame:
    """One filter per shard. A shard holds about SHARD_KEYS keys whatever the corpus, so a group stays small."""

    def run(key, rows):
        import pandas as pd

        return pd.DataFrame({"shard": [key[0]], "filter": [CuckooFilter.of(rows["k1"].to_numpy(), rows["k2"].to_numpy()).data()]})

    keys = active(counts).select(*KEY, shard_of(n_shards).alias("shard"))
    return keys.groupBy("shard").applyInPandas(run, "shard int, filter binary")


def build(docs: DataFrame) -> LineIndex:
    held = written(postings(docs), "line-postings")
    counts = written(counted(held.distinct()), "line-counts")
    n_shards = max(1, math.ceil(active(counts).count() / SHARD_KEYS))
    return LineIndex(held, counts, written(build_filters(counts, n_shards), "line-filters"), n_shards)


def _changed_filters(index: LineIndex, before: DataFrame, after: DataFrame) -> DataFrame:
    """Filters with the keys put in and taken out that crossed the limit between two states of the touched keys."""
    limit = F.lit(MIN_DOCS)
    was = before.select(*KEY, F.col("refs").alias("was"))
    now = after.select(*KEY, F.col("refs").alias("now"))
    moved = (
        was.join(now, KEY, "full")
        .select(*KEY, (F.coalesce("was", F.lit(0)) >= limit).alias("had"), (F.coalesce("now", F.lit(0)) >= limit).alias("has"))
        .where("had <> has")
        .withColumn("shard", shard_of(index.n_shards))
    )

    def run(key, old, keys):
        import pandas as pd

        filter_ = CuckooFilter(data=old["filter"].iloc[0]) if len(old) else CuckooFilter(SHARD_KEYS)
        gone, new = keys[keys["had"]], keys[keys["has"]]
        filter_.delete(gone["k1"].to_numpy(), gone["k2"].to_numpy())
        if not filter_.insert(new["k1"].to_numpy(), new["k2"].to_numpy()):
            return pd.DataFrame({"shard": [key[0]], "filter": [b""]})
        return pd.DataFrame({"shard": [key[0]], "filter": [filter_.data()]})

    return index.filters.groupBy("shard").cogroup(moved.groupBy("shard")).applyInPandas(run, "shard int, filter binary")


def _with(index: LineIndex, held: DataFrame, touched: DataFrame) -> LineIndex:
    """The index with postings ``held``; only keys in ``touched`` may have changed."""
    held = written(held, "line-postings")
    keys = touched.select(*KEY).distinct()
    fresh = written(counted(held.join(keys, KEY, "left_semi")), "line-touched")
    before = index.counts.join(keys, KEY, "left_semi")
    counts = written(index.counts.join(keys, KEY, "left_anti").union(fresh), "line-counts")
    filters = written(_changed_filters(index, before, fresh), "line-filters")
    if filters.where(F.length("filter") == 0).limit(1).count():
        filters = written(build_filters(counts, index.n_shards), "line-filters")
    return LineIndex(held, counts, filters, index.n_shards)


def insert(index: LineIndex, docs: DataFrame) -> LineIndex:
    """The index with documents added; they must be new."""
    new = written(postings(docs).distinct(), "line-new")
    return _with(index, index.postings.distinct().union(new), new)


def delete(index: LineIndex, docs: DataFrame) -> LineIndex:
    """The index without the documents whose doc_id is in ``docs``."""
    ids = docs.select("doc_id").distinct()
    gone = written(index.postings.join(ids, "doc_id", "left_semi").select(*KEY, "doc_id"), "line-gone")
    return _with(index, index.postings.join(ids, "doc_id", "left_anti").select(*KEY, "doc_id"), gone)


def tested(index: LineIndex, keys: DataFrame) -> DataFrame:
    """The rows of ``keys`` (k1, k2, doc_id) whose key may be active; filters are broadcast behind a check of their size."""
    size = index.filters.agg(F.sum(F.length("filter"))).first()[0] or 0
    if size > FILTER_BYTES:
        return keys
    shared = keys.sparkSession.sparkContext.broadcast({r["shard"]: r["filter"] for r in index.filters.collect()})
    n_shards = index.n_shards

    def run(batches):
        own = {shard: CuckooFilter(data=data) for shard, data in shared.value.items()}
        for batch in batches:
            k1, k2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            shard, hit = k1 % n_shards, np.zeros(len(k1), bool)
            for s in np.unique(shard):
                if s in own:
                    rows = shard == s
                    hit[rows] = own[s].has(k1[rows], k2[rows])
            yield batch.filter(pa.array(hit))

    return keys.select(*KEY, "doc_id").mapInArrow(run, "k1 long, k2 long, doc_id long")


def apply(index: LineIndex, docs: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """``docs`` with repeated lines taken out of ``text``, and ``n_lines`` (before) and ``n_dropped``.

    ``keys`` are the documents' postings where they are at hand already. Input columns named like an output are replaced.
    """
    hits = tested(index, postings(docs) if keys is None else keys).distinct()
    lost = hits.join(active(index.counts), KEY).where("doc_id <> top")
    # a document's own lines: bounded by the document
    per_doc = lost.groupBy(F.col("doc_id").alias("__doc")).agg(F.collect_list(F.struct(*KEY)).alias("__lost"))
    per_doc = written(per_doc, "line-lost")
    kept = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    # dealt by document at every size; the lost keys are the small side, so the texts need no sort
    joined = docs.select(*kept).join(per_doc.hint("shuffle_hash"), F.col("doc_id") == F.col("__doc"), "left")

    @F.pandas_udf("struct<text:string,n_lines:long,n_dropped:long>")
    def without(texts, lost_keys):
        import pandas as pd

        rows = []
        for text, lost_ in zip(texts, lost_keys):
            lines, gone = (text or "").split("\n"), set()
            if lost_ is not None:
                gone = {(r["k1"], r["k2"]) for r in lost_}
            left = [line for line in lines if line_key(line) not in gone] if gone else lines
            rows.append(("\n".join(left), len(lines), len(lines) - len(left)))
        return pd.DataFrame(rows, columns=["text", "n_lines", "n_dropped"])

    out = joined.withColumn("__out", without("text", "__lost"))
    return out.select(
        *[F.col("__out.text").alias("text") if c == "text" else F.col(c) for c in kept], "__out.n_lines", "__out.n_dropped"
    )


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    index = build(docs)
    out = apply(index, docs, index.postings)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP6_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents),
keyed AS (
  SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
often AS (
  SELECT key, max(doc_id) AS top FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT k.*, coalesce(k.doc_id <> o.top, false) AS lost FROM keyed k LEFT JOIN often o ON k.key = o.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE lost) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""
