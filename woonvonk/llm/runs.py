"""Periodic runs of words: where a text says the same stretch of words over and over.

A run is a stretch of words in which words ``q`` apart are the same, ``q`` the smallest such number, at least ``least`` words
and twice the period long, that no neighbouring word extends. They are found with a dictionary of basic factors: for each
power of two, stretches of that length get the same number when they are the same, made from the two halves' numbers.

At length ``m`` the dictionary proposes the periods from m up to 2m. Of the occurrences of one factor, those at most
m / 2 apart lie in one stretch with that distance as its period, so they form an arithmetic progression; the others start a
new one. The period of a run is the distance between an occurrence and the first one of a later progression, or between
the last ones of two progressions (were both in the same progression, the run would have its smaller period). Less than 2m
apart there are at most five progressions, so each occurrence makes a bounded number of proposals. Proposals of one period
that touch are joined, then extended to both sides by descending through the lengths, and of the periods
proposed for one stretch the smallest stays.

Work per text grows with n log n and is done for many short texts at once; memory is a number per word and length that
still repeats. Rows are independent: no shuffle, hot sources and copies cost what other rows do.

Null and empty texts, and texts of white space, have no words and no runs. Repeated rows give a row each; other columns
of ``docs``, whatever their names, are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from woonvonk.llm.common import table

LEAST = 12
# Words of short texts that are worked on together; a longer text is worked on by itself.
GROUP_WORDS = 200_000

WORD = r"[^\x20\x09-\x0D]+"
SCHEMA = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def _ranks(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Dense numbers of ``keys`` and how often each number occurs."""
    _, number, count = np.unique(keys, return_inverse=True, return_counts=True)
    return number.reshape(-1), count


class Factors:
    """Numbers of all stretches of 1, 2, 4, ... words; a stretch that occurs once has a number of its own below zero."""

    def __init__(self, words: np.ndarray):
        self.n = len(words)
        self.levels: list[np.ndarray] = []
        number, count = _ranks(words)
        alive = np.flatnonzero(count[number] > 1)
        self._add(alive, number[alive])

    def _add(self, alive: np.ndarray, number: np.ndarray) -> None:
        level = -1 - np.arange(self.n, dtype=np.int32 if self.n < 1 << 31 else np.int64)
        level[alive] = number
        self.alive, self.number = alive, number
        self.levels.append(level)

    @property
    def length(self) -> int:
        return 1 << (len(self.levels) - 1)

    def double(self) -> None:
        """Go on to stretches twice as long."""
        m, level = self.length, self.levels[-1]
        first = self.alive[: np.searchsorted(self.alive, self.n - m)]
        first = first[level[first + m] >= 0]
        number, count = _ranks(level[first].astype(np.int64) * (self.n + 1) + level[first + m])
        kept = count[number] > 1
        self._add(first[kept], number[kept])

    def forward(self, at: np.ndarray, apart: np.ndarray) -> np.ndarray:
        """Where ``at`` ends up if it goes right as long as the word there and the one ``apart`` further are the same."""
        at = at.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            level, m = self.levels[k], 1 << k
            left = np.arange(len(at))
            while len(left):
                there = at[left] + apart[left]
                left, there = left[there + m <= self.n], there[there + m <= self.n]
                left = left[level[at[left]] == level[there]]
                at[left] += m
        return at

    def backward(self, at: np.ndarray, apart: np.ndarray) -> np.ndarray:
        """The same to the left: the first word up to which words ``apart`` are the same, all before ``at``."""
        at = at.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            level, m = self.levels[k], 1 << k
            left = np.arange(len(at))
            while len(left):
                left = left[at[left] >= m]
                left = left[level[at[left] - m] == level[at[left] - m + apart[left]]]
                at[left] -= m
        return at


def _proposals(factors: Factors) -> tuple[np.ndarray, np.ndarray]:
    """(place, period) pairs with m <= period < 2m such that m words from the place on come again a period later."""
    m = factors.length
    order = np.argsort(factors.number, kind="stable")
    at, number = factors.alive[order], factors.number[order]
    fresh = np.ones(len(at), bool)
    fresh[1:] = (number[1:] != number[:-1]) | (2 * (at[1:] - at[:-1]) > m)
    head = np.flatnonzero(fresh)
    tail = np.append(head[1:], len(at)) - 1
    mine = np.cumsum(fresh) - 1
    places, periods = [], []

    def propose(left: np.ndarray, chain: np.ndarray, goal: np.ndarray) -> None:
        step = 1
        while len(left):
            inside = chain + step < len(goal)
            left, chain = left[inside], chain[inside]
            to = goal[chain + step]
            apart = at[to] - at[left]
            near = (number[to] == number[left]) & (apart < 2 * m)
            left, chain, apart = left[near], chain[near], apart[near]
            places.append(at[left[apart >= m]])
            periods.append(apart[apart >= m])
            step += 1

    propose(np.arange(len(at)), mine, head)
    propose(tail, np.arange(len(tail)), tail)
    return np.concatenate(places or [np.zeros(0, np.int64)]), np.concatenate(periods or [np.zeros(0, np.int64)])


def runs_of(words: np.ndarray, least: int = LEAST) -> np.ndarray:
    """All runs of a row of word numbers as rows (start, length, period), by start and period."""
    found = []
    factors = Factors(words)
    while len(factors.alive):
        place, period = _proposals(factors)
        if len(place):
            m = factors.length
            order = np.lexsort((place, period))
            place, period = place[order], period[order]
            fresh = np.ones(len(place), bool)
            fresh[1:] = (period[1:] != period[:-1]) | (place[1:] - place[:-1] > m)
            first = np.flatnonzero(fresh)
            last = np.append(first[1:], len(place)) - 1
            apart = period[first]
            start = factors.backward(place[first], apart)
            end = factors.forward(place[last] + m, apart) + apart
            kept = end - start >= np.maximum(least, 2 * apart)
            found.append(np.stack([start, end - start, apart], axis=1)[kept])
        factors.double()
    if not found:
        return np.zeros((0, 3), np.int64)
    rows = np.unique(np.concatenate(found), axis=0)  # by start, length, period
    same = np.zeros(len(rows), bool)
    same[1:] = (rows[1:, :2] == rows[:-1, :2]).all(axis=1)
    rows = rows[~same]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def collapsed(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of ``n`` words stay: those that no run holds after its first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(change[:n]) == 0


def _groups(sizes: list[int]) -> Iterator[tuple[int, int]]:
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > GROUP_WORDS:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def _found(doc_ids: pa.Array, words: list[list[bytes]], least: int) -> pa.RecordBatch:
    sizes = np.array([len(w) for w in words], np.int64)
    ends = np.cumsum(sizes)
    flat = [w for row in words for w in row]
    code = pa.array(flat, pa.binary()).dictionary_encode().indices.to_numpy().astype(np.int64)
    # numbers differ from text to text, so nothing repeats across texts
    code += np.repeat(np.arange(len(words)) * (int(code.max(initial=0)) + 1), sizes)
    rows = runs_of(code, least)
    stay = collapsed(len(flat), rows)
    owner = np.searchsorted(ends, rows[:, 0], side="right")
    texts, at = [], 0
    for row, n in zip(words, sizes.tolist()):
        kept = stay[at : at + n]
        texts.append(b" ".join(row if kept.all() else [w for w, k in zip(row, kept.tolist()) if k]))
        at += n
    runs = pa.StructArray.from_arrays(
        [pa.array(rows[:, 0] - (ends - sizes)[owner]), pa.array(rows[:, 1]), pa.array(rows[:, 2])],
        names=["start", "length", "period"],
    )
    bounds = np.searchsorted(owner, np.arange(len(words) + 1)).astype(np.int32)
    return pa.RecordBatch.from_arrays(
        [doc_ids, pa.array(sizes), pa.ListArray.from_arrays(bounds, runs), pa.array(texts, pa.binary()).cast(pa.string())],
        names=["doc_id", "n_words", "runs", "collapsed"],
    )


def find_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): its runs by start and period, and its text with each run cut to one period."""

    def run(batches):
        for batch in batches:
            words = [(t or b"").split() for t in batch.column(1).cast(pa.binary()).to_pylist()]
            for a, b in _groups([len(w) for w in words]):
                yield _found(batch.column(0).slice(a, b - a), words[a:b], least)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text) of ``docs``; about a tenth of the texts, by the checksum of doc_id, repeat a stretch of words to their end.

    The stretch starts at word a and has p words, as the query's contract fixes them. Texts without words and rows without
    doc_id stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / F.lit(10)).cast("long")
    chosen = F.coalesce(h % 10 == 0, F.lit(False))
    words = F.when(chosen, F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    staged = docs.select("doc_id", "text", g.alias("g"), words.alias("words")).withColumn("n", F.size("words"))
    has = F.col("n") > 0
    staged = staged.withColumn("a", F.when(has, F.col("g") % F.col("n")))
    staged = staged.withColumn("p", F.when(has, F.lit(1) + F.floor((F.col("n") - F.col("a")) / (F.lit(3) + F.col("g") % 8))))
    a, p, n = F.col("a").cast("int"), F.col("p").cast("int"), F.col("n")
    again = F.flatten(F.array_repeat(F.slice("words", a + 1, p), F.ceil((n - a) / p).cast("int")))
    whole = F.slice(F.concat(F.slice("words", F.lit(1), a), again), F.lit(1), n)
    return staged.select("doc_id", F.when(has, F.array_join(whole, " ")).otherwise(F.col("text")).alias("text"))


def digest(found: DataFrame) -> DataFrame:
    """The longest run (ties: smallest start, then period) and digests of all runs and of the collapsed text."""
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    return found.select("doc_id", "runs", "collapsed", longest.alias("best")).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.s").alias("start"),
        (-F.col("best.l")).alias("length"),
        F.col("best.p").alias("period"),
        F.expr("-best.l * 1000 div best.p").alias("exponent_milli"),
        F.sha2(F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise("")), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(find_runs(planted(table(spark, sf_dir, "documents"))))
