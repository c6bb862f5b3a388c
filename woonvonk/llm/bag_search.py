"""Ranked lexical search with bag deduplication.

All that a score depends on is a document's counts of the query items' terms and its length value ``m``. So documents are
restricted to the items' vocabulary; those with the same counts and the same ``m`` are one class, found by a hash and verified
by comparing the counts themselves; each class is scored once, and what it has won goes to its members by ascending
doc_id. No more than ``k`` members of a class can be among the best ``k``, so map tasks hand on ``k`` members each and a
class that holds a third of all documents costs a few rows per task.

Items are worked on in blocks of at most about ``BLOCK_BYTES`` of distinct text; the vocabulary and the weights of one block are
what is sent to every task, whatever the number of items or documents. A task scores its classes against all items of the
block by adding up columns, and keeps the best ``k`` of each item, ties at the end included until members are laid out. Counts
and statistics cover all rows.

Null texts have no terms; documents without terms and items without terms rank nowhere. Equal scores go by ascending doc_id,
null ids last. Repeated rows of documents are ranked each. Every row of items gets its own ranking, so an item_id given
twice ranks twice. Empty tables give no rows; other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import math
from array import array
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from woonvonk.llm.common import table, written

K = 10
BLOCK_BYTES = 4 << 20
# Scores that a task holds at a time.
CELLS = 4 << 20

# Bytes as terms have them: A-Z in lower case, other ASCII that isn't a letter or digit as a blank.
FOLDED = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))

STATISTICS = "term long, df long"


def terms(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(FOLDED).split()


@dataclass
class Block:
    """Query items with distinct texts: their keys, vocabulary, and per item its terms with how often it has them."""

    keys: list[str]
    vocabulary: dict[bytes, int]
    items: list[list[tuple[int, int]]]

    @classmethod
    def of(cls, rows: list[tuple[str, str]]) -> Block:
        vocabulary: dict[bytes, int] = {}
        items = []
        for _, text in rows:
            counts = Counter(terms(text.encode()))
            items.append([(vocabulary.setdefault(t, len(vocabulary)), n) for t, n in sorted(counts.items())])
        return cls([key for key, _ in rows], vocabulary, items)


def bags(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, bag): how many terms a document has, and (term, count) of those in the vocabulary, in order."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        find = shared.value.get
        for batch in batches:
            sizes, found = [], []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                words = terms(text)
                counts = Counter(map(find, words))
                counts.pop(None, None)
                sizes.append(len(words))
                found.append(array("I", [x for pair in sorted(counts.items()) for x in pair]).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(found, pa.binary())], names=["doc_id", "n", "bag"]
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n long, bag binary")


def _entries(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, term and count of every entry of a column of bags."""
    rows = column.to_pylist()
    flat = np.frombuffer(b"".join(rows), np.uint32).astype(np.int64)
    return np.repeat(np.arange(len(rows)), [len(r) // 8 for r in rows]), flat[0::2], flat[1::2]


def frequencies(bagged: DataFrame, size: int) -> np.ndarray:
    """How many documents hold each term; counted in tasks, at most one row per task and term is shuffled."""

    def run(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(_entries(batch.column(0))[1], minlength=size)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["term", "df"])

    df = np.zeros(size, np.int64)
    for row in bagged.select("bag").mapInArrow(run, STATISTICS).groupBy("term").agg(F.sum("df").alias("df")).collect():
        df[row["term"]] = row["df"]
    return df


def classes(bagged: DataFrame, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(bag, m, members): documents with equal counts and equal ``m``, with the first ``k`` doc_ids of each class.

    The hash deals them, the bags decide.
    """
    m = F.expr(f"25 + (75L * n * {n_docs}L) div {n_terms}L")
    some = bagged.where(F.length("bag") > 0).select("doc_id", "bag", m.alias("m"))
    key = ["h", "bag", "m"]
    hashed = some.withColumn("h", F.xxhash64("bag", "m"))
    order = Window.partitionBy(*key).orderBy(F.col("doc_id").asc_nulls_last())
    first = hashed.withColumn("no", F.row_number().over(order)).where(F.col("no") <= k)
    members = F.sort_array(F.collect_list(F.struct("no", "doc_id")))
    return first.groupBy(*key).agg(members.alias("members")).select("bag", "m", F.col("members.doc_id").alias("members"))


class Best:
    """The best ``k`` (score, doc_id) of every item so far."""

    def __init__(self, n_items: int, k: int):
        self.k = k
        self.least = np.ones(n_items, np.int64)  # scores below this can't be among them
        self.rows = [np.zeros(0, np.int64)] * 4  # item, score, whether doc_id is null, doc_id

    def take(self, item: np.ndarray, score: np.ndarray, null: np.ndarray, doc_id: np.ndarray) -> None:
        rows = [np.concatenate(x) for x in zip(self.rows, (item, score, null, doc_id))]
        order = np.lexsort((rows[3], rows[2], -rows[1], rows[0]))
        rows = [x[order] for x in rows]
        first = np.searchsorted(rows[0], rows[0])
        place = np.arange(len(first)) - first
        kept = place < self.k
        last = place == self.k - 1
        self.least[rows[0][last]] = rows[1][last]
        self.rows = [x[kept] for x in rows]


def _best(classed: DataFrame, block: Block, weights: np.ndarray, k: int) -> DataFrame:
    """(item, doc_id, score): per task the best ``k`` documents of each item of the block, by its number."""
    shared = classed.sparkSession.sparkContext.broadcast((weights, block.items))

    def run(batches):
        value, items = shared.value
        best = Best(len(items), k)
        for batch in batches:
            row, term, count = _entries(batch.column(0))
            m = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            part = (1_000_000_000 * count) // (1000 * count + 8 * m[row])
            order = np.argsort(term, kind="stable")
            row, term, part = row[order], term[order], part[order]
            bounds = np.searchsorted(term, np.arange(len(value) + 1))
            members = batch.column(2)
            m_ends = members.offsets.to_numpy().astype(np.int64)
            ids = members.values
            m_null = ids.is_null().to_numpy(zero_copy_only=False).astype(np.int64)
            m_ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
            step = max(1, CELLS // max(1, len(m)))
            for start in range(0, len(items), step):
                some = items[start : start + step]
                total = np.zeros((len(some), len(m)), np.int64)
                for i, own in enumerate(some):
                    for t, n in own:
                        a, b = bounds[t], bounds[t + 1]
                        if a < b and value[t]:
                            total[i, row[a:b]] += n * value[t] * part[a:b]
                least = best.least[start : start + step]
                if len(m) > k:
                    least = np.maximum(least, np.partition(total, len(m) - k, axis=1)[:, len(m) - k])
                item, of = np.nonzero(total >= least[:, None])
                size = m_ends[of + 1] - m_ends[of]
                at = np.repeat(m_ends[of] - np.cumsum(size) + size, size) + np.arange(size.sum())
                best.take(np.repeat(item + start, size), np.repeat(total[item, of], size), m_null[at], m_ids[at])
        item, score, null, doc_id = best.rows
        yield pa.RecordBatch.from_arrays(
            [pa.array(item), pa.array(doc_id.astype(np.int64), mask=null.astype(bool)), pa.array(score)], names=["item", "doc_id", "score"]
        )

    return classed.mapInArrow(run, "item long, doc_id long, score long")


def _ranked_block(docs: DataFrame, block: Block, k: int) -> DataFrame:
    """(key, rank, doc_id, score) for the items of one block."""
    spark = docs.sparkSession
    bagged = written(bags(docs, block.vocabulary), "bags")
    n_docs, n_terms = bagged.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
    nothing = "key string, rank int, doc_id long, score long"
    if not n_docs:
        return spark.createDataFrame([], nothing)
    df = frequencies(bagged, len(block.vocabulary))
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
    classed = written(classes(bagged, n_docs, n_terms, k), "bag-classes")
    found = written(_best(classed, block, weights, k), "bag-best")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    keys = spark.createDataFrame(list(enumerate(block.keys)), "item long, key string")
    return ranked.join(keys, "item").select("key", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """The ``k`` best rows of ``docs`` (doc_id, text) for every row of ``items`` (item_id, text) with a score above 0."""
    asked = items.where(F.length("text") > 0).select("item_id", "text", F.sha2("text", 256).alias("key"))
    texts = asked.groupBy("key").agg(F.first("text").alias("text"))
    size = texts.agg(F.sum(F.octet_length("text")).alias("s")).first().s or 0
    n_blocks = -(-size // BLOCK_BYTES)
    out = None
    for number in range(n_blocks):
        mine = texts.where(F.pmod(F.xxhash64("key"), F.lit(n_blocks)) == number)
        block = Block.of([(r["key"], r["text"]) for r in mine.orderBy("key").collect()])
        found = _ranked_block(docs, block, k)
        out = found if out is None else out.union(found)
    if out is None:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return asked.select("item_id", "key").join(out, "key").select("item_id", "rank", "doc_id", "score")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP12_SQL = r"""
WITH t AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS w FROM documents),
i AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS w FROM benchmark),
tf AS (SELECT doc_id, w, count(*) AS tf FROM t GROUP BY doc_id, w),
size AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_id),
whole AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM size),
m AS (SELECT doc_id, 100 - 75 + ((75 * n * n_docs) // n_terms) AS m FROM size, whole),
weight AS (
  SELECT w, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::BIGINT AS weight FROM tf, whole GROUP BY w, n_docs),
asked AS (SELECT item_id, w, count(*) AS times FROM i GROUP BY item_id, w),
scored AS (
  SELECT item_id, tf.doc_id, sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM asked JOIN tf USING (w) JOIN weight USING (w) JOIN m ON m.doc_id = tf.doc_id GROUP BY item_id, tf.doc_id)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM scored WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10"""
