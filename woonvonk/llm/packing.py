"""Best-fit packing of token pieces into sequences of fixed length.

Best-fit decreasing looks at lengths only, and there are at most ``capacity`` of them. So the corpus is reduced to one
count per length, the plan is made on those counts, and every piece finds its place by its rank among the pieces of
its length. The plan handles runs of equal bins at once; its size depends on ``capacity``, not on the corpus. Placing
pieces needs one equi-join of narrow rows with the ranks' bases, no sort of the corpus and no driver-side rows but the
counts per length.
"""

from __future__ import annotations

import zlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from woonvonk.llm import bpe
from woonvonk.llm.common import table, written

CAPACITY = 2048
END = 0  # the id that closes every document

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task long, rank_in_task long"


class CapacityTree:
    """Segment tree over remaining capacities 0..n: finds the smallest capacity of at least x that has open bins."""

    def __init__(self, n: int):
        self.size = 1
        while self.size <= n:
            self.size *= 2
        self.any = [False] * (2 * self.size)

    def mark(self, at: int, some: bool) -> None:
        i = at + self.size
        self.any[i] = some
        while i > 1:
            i //= 2
            self.any[i] = self.any[2 * i] or self.any[2 * i + 1]

    def tightest(self, least: int) -> int | None:
        i = least + self.size
        if least >= self.size:
            return None
        if self.any[i]:
            return least
        while i > 1:
            if i % 2 == 0 and self.any[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.any[2 * i] else 2 * i + 1
                return i - self.size
            i //= 2
        return None


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Best-fit decreasing over (length, count): rows (length, first rank, first bin, per bin, offset), by length and rank.

    A row holds for the pieces from its first rank up to the next row's: piece ``k`` of them goes to bin
    ``first + k // per`` at ``offset + (k % per) * length``. A bin that takes one piece of a length is the tightest for
    the next one as long as another fits, so each bin takes ``remaining // length`` of them before the next bin does.
    """
    tree, open_bins, steps, new_bin = CapacityTree(capacity), [deque() for _ in range(capacity + 1)], [], 0

    def put(room: int, first: int, n: int) -> None:
        if room and n:
            open_bins[room].append((first, n))
            tree.mark(room, True)

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                room, per = capacity, capacity // length
                first, n = new_bin, -(-left // per)
                new_bin += n
            else:
                per = room // length
                first, n = open_bins[room].popleft()
                if not open_bins[room]:
                    tree.mark(room, False)
            full = min(n, left // per)
            rest = left - full * per if full < n else 0
            steps.append((length, rank, first, per, capacity - room))
            placed = full * per + rest
            put(room - per * length, first, full)
            used = full
            if rest:
                put(room - rest * length, first + full, 1)
                used += 1
            if used < n:
                put(room, first + used, n - used)
            rank += placed
            left -= placed
    return np.array(steps, np.int64).reshape(-1, 5)


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: only those over ``capacity`` are cut, and their first piece is the short one."""
    first = length % capacity or capacity
    return [(0, min(first, length))] + [(s, capacity) for s in range(first, length, capacity)]


def pieces(docs: DataFrame, path: str = bpe.VOCABULARY, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of every row of ``docs`` (doc_id, text), numbered per task and length.

    The numbers hold only for the run that wrote them; write the result before using it twice.
    """
    shared = docs.sparkSession.sparkContext.broadcast(bpe.model_settings(path))

    def run(batches):
        own, task, seen = bpe.codec(shared.value), TaskContext.get().partitionId(), [0] * (capacity + 1)
        for batch in batches:
            rows, doc_ids = [], batch.column(0).to_pylist()
            for first, ids, ends in own.encode_all(batch.column(1)):
                at = 0
                for doc_id, end in zip(doc_ids[first : first + len(ends)], ends.tolist()):
                    whole, at = np.append(ids[at:end], np.uint32(END)), end
                    for k, (start, n) in enumerate(cut(len(whole), capacity)):
                        rows.append((doc_id, k, start, n, zlib.crc32(whole[start : start + n]), task, seen[n]))
                        seen[n] += 1
            columns = list(zip(*rows)) or [[]] * 7
            kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 5]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "rank_in_task"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


def pack(docs: DataFrame, path: str = bpe.VOCABULARY, capacity: int = CAPACITY) -> DataFrame:
    """Every document's pieces with their sequence and offset.

    Null texts are empty: such a document is its closing id alone. Repeated rows are packed each. No rows give no rows.
    """
    cut_up = written(pieces(docs, path, capacity), "pieces")
    per_task = cut_up.groupBy("task", "length").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    base = written(per_task.select("task", "length", "n", F.coalesce(before, F.lit(0)).alias("base")), "bases")
    # At most ``capacity`` rows reach the driver.
    counts = {r["length"]: r["n"] for r in base.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    steps = plan(counts, capacity)
    shared = docs.sparkSession.sparkContext.broadcast(steps)

    def place(batches):
        own = shared.value
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            out = np.zeros((len(rank), 2), np.int64)
            for n in np.unique(length):
                rows = np.flatnonzero(length == n)
                mine = own[own[:, 0] == n]
                at = mine[np.searchsorted(mine[:, 1], rank[rows], side="right") - 1]
                k = rank[rows] - at[:, 1]
                out[rows, 0] = at[:, 2] + k // at[:, 3]
                out[rows, 1] = at[:, 4] + (k % at[:, 3]) * n
            kept = [batch.column(i) for i in range(5)]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(out[:, 0]), pa.array(out[:, 1])],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    ranked = cut_up.join(base.drop("n"), ["task", "length"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("rank_in_task")).alias("rank")
    )
    return ranked.mapInArrow(
        place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
