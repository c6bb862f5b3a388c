"""Similarity join on word n-gram sets: a blocked sparse product of the document by n-gram matrix with its transpose.

Only the columns that can decide are multiplied. With a threshold t on the Jaccard similarity, two sets in one common
order share an element among their first ``n - ceil(t n) + 1``; the order is by 64-bit digest, with n-grams that many
documents begin with put last. Columns are dealt into blocks by digest; a block streams its columns in order, adds up
overlap counts per pair of documents, and drops pairs whose sizes, or whose counts with all that could still come,
cannot reach t. What is left is checked against the whole sets.

A column that still holds many documents is not multiplied. Its documents are near copies of each other or share most
of their text, so they are put as differences to one of them, the centre: documents that link with the centre are
connected through it, and for any other pair ``|x - y| = |dx| + |dy| - 2 |dx & dy|`` can only be small enough when the
differences share elements, so the same product is made of the differences (whose common parts are gone) and so on. So a
group of thousands of near copies costs about its size, not its square, and no link that decides a component is lost.

Documents with equal sets are one row from the start. Null or empty texts have the empty set and link with nothing.
Rows without doc_id link with nothing and get no component. Rows that repeat a doc_id are one document given again.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from woonvonk.llm.common import components, kept_in_worker, table, written
from woonvonk.session import broadcast_if_small

N = 5
PERCENT = 80
# A prefix element of more documents than this is put last in the order.
OFTEN = 64
# So many such elements are sent to every task (8 bytes each), the most frequent first; which ones changes cost only.
OFTEN_KEYS = 200_000
# Pairs that a column may have, in either order, before its documents are put as differences instead; columns of
# differences may have more, because nearly all of their pairs fall at once.
COLUMN_PAIRS = 16_384
DIFFERENCE_PAIRS = 1 << 23
# Rows of one column that a task holds to find that out, and pairs it looks at in one go.
COLUMN_ROWS = 100_000
BLOCK_PAIRS = 1 << 18
# Columns of so few rows, which most are, have no more than some thousand pairs.
FEW_ROWS = 64
# Columns that are still full after so many differences are multiplied whole, pair by pair, and only what fits goes on.
LEVELS = 6

_BASE = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xD6E8FEB86659FD93)
_PLACE = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


def _mixed(x: np.ndarray) -> np.ndarray:
    for _ in range(2):
        x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(32))


def _byte_values() -> np.ndarray:
    values = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE)) | np.uint64(1)
    values[65:91] = values[97:123]  # A-Z count as a-z
    return values


class Hasher:
    """64-bit digests of all n-grams of a text, by array operations over its bytes."""

    def __init__(self):
        self.values = _byte_values()
        self.blank = np.zeros(256, bool)
        self.blank[[0x20, *range(0x09, 0x0E)]] = True
        self._grow(1 << 14)

    def _grow(self, n: int) -> None:
        def powers(base: int) -> np.ndarray:
            out, k = np.ones(n, np.uint64), 1
            while k < n:
                m = min(k, n - k)
                out[k : k + m] = out[:m] * np.uint64(pow(base, k, 1 << 64))
                k += m
            return out

        self.up, self.down = powers(_BASE), powers(pow(_BASE, -1, 1 << 64))

    def word_hashes(self, text: str) -> np.ndarray:
        data = np.frombuffer(text.encode(), np.uint8)
        if len(data) > len(self.up):
            self._grow(1 << int(len(data)).bit_length())
        edge = np.diff(np.concatenate(([False], ~self.blank[data], [False])).view(np.int8))
        first, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.values[data] * self.up[: len(data)], out=total[1:])
        return _mixed((total[end] - total[first]) * self.down[first] + (end - first).astype(np.uint64))

    def ngrams(self, text: str | None, n: int = N) -> np.ndarray:
        """The distinct n-gram digests, ascending; the whole sequence counts as one n-gram when it is shorter."""
        if not text:
            return np.zeros(0, np.uint64)
        words = self.word_hashes(text)
        if not len(words):
            return words
        size = min(n, len(words))
        out = np.zeros(len(words) - size + 1, np.uint64)
        for k in range(size):
            out += words[k : k + len(out)] * _PLACE[k % len(_PLACE)]
        out = np.sort(_mixed(out + np.uint64(size)))
        return out[np.concatenate(([True], out[1:] != out[:-1]))]


def hasher() -> Hasher:
    return kept_in_worker("hasher", Hasher)


def least_overlap(n: int, percent: int = PERCENT) -> int:
    """The smallest overlap of a set of n elements with any set that it links with."""
    return -(-n * percent // 100)


def links(common: int, a: int, b: int, percent: int = PERCENT) -> bool:
    return 100 * common >= percent * (a + b - common)


def _longs(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _member(sorted_keys: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_keys):
        return np.zeros(len(x), bool)
    at = np.searchsorted(sorted_keys, x)
    at[at == len(sorted_keys)] = 0
    return sorted_keys[at] == x


def _frequent(counts: DataFrame) -> np.ndarray:
    """The keys of (h, n) in more than OFTEN rows, ascending; the most frequent first, a bounded number."""
    total = counts.groupBy("h").agg(F.sum("n").alias("n"))
    top = total.where(F.col("n") > OFTEN).orderBy(F.desc("n"), "h").limit(OFTEN_KEYS).select("h").toArrow()
    return np.sort(top.column("h").combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))


def _counted(parts: list[np.ndarray]) -> pa.RecordBatch:
    keys, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *parts]), return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(_longs(keys)), pa.array(n.astype(np.int32))], names=["h", "n"])


def often(docs: DataFrame, last: np.ndarray) -> np.ndarray:
    """Elements that more than OFTEN documents begin with when ``last`` come last; in ascending order."""
    shared = docs.sparkSession.sparkContext.broadcast(last)

    def run(batches):
        own, late = hasher(), shared.value
        for batch in batches:
            sets = map(own.ngrams, batch.column(0).to_pylist())
            yield _counted([s[~_member(late, s)][: len(s) - least_overlap(len(s)) + 1] for s in sets])

    return _frequent(docs.select("text").mapInArrow(run, "h long, n int"))


def sketched(docs: DataFrame, last: np.ndarray) -> DataFrame:
    """(doc_id, n, f1, f2, cold, hot): set size, digest of the set, and the elements it begins with; ``last`` come last."""
    shared = docs.sparkSession.sparkContext.broadcast(last)

    def run(batches):
        own, late = hasher(), shared.value
        for batch in batches:
            out = {k: [] for k in ("n", "f1", "f2", "cold", "hot")}
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                s = own.ngrams(text)
                out["n"].append(len(s))
                if not len(s) or doc_id is None:
                    for k in ("f1", "f2", "cold", "hot"):
                        out[k].append(None)
                    continue
                digest = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), "<i8")
                out["f1"].append(int(digest[0]))
                out["f2"].append(int(digest[1]))
                p, mark = len(s) - least_overlap(len(s)) + 1, _member(late, s)
                cold = s[~mark][:p]
                out["cold"].append(_longs(cold))
                out["hot"].append(_longs(s[mark][: p - len(cold)]))
            longs = pa.list_(pa.int64())
            kinds = [pa.int64(), pa.int64(), pa.int64(), longs, longs]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(v, k) for v, k in zip(out.values(), kinds)]], names=["doc_id", *out]
            )

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n long, f1 long, f2 long, cold array<long>, hot array<long>"
    )


def product(entries: DataFrame, column_pairs: int | None) -> DataFrame:
    """Multiply columns ``key`` of entries: rows (key null, a, b, na, nb, common) for pairs, (key, a, na) for full columns.

    ``d`` is the document, ``n`` its set's size; for differences ``m`` is their size, ``pos`` the element's place in them,
    ``ask`` whether the entry only looks for smaller differences (at the top m and pos are 0). Documents of one ``g`` are
    known to be connected and make no pairs. Entries of one column come together in one block, in order; a block
    holds one column at a time and at most COLUMN_ROWS of it. A column that would make more than ``column_pairs`` is full;
    with None only one of more than COLUMN_ROWS is.
    """

    def pairs_of(rows: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of the pairs of rows (a, b), with a before b and no mere question, those that can still link."""
        _, d, n, m, pos, _, g = rows
        low, high = np.minimum(n[a], n[b]), np.maximum(n[a], n[b])
        fit = (g[a] != g[b]) & (100 * low >= PERCENT * high) & (d[a] != d[b])
        # |x - y| is at most (100 - t) / (100 + t) of both sizes together, and at least the differences' difference
        most = (100 - PERCENT) * (n[a] + n[b])
        fit &= (100 + PERCENT) * (m[b] - m[a]) <= most
        # if this is their first common element, they have no more in common than what comes from here on
        fit &= (100 + PERCENT) * (m[a] + m[b] - 2 * np.minimum(m[a] - pos[a], m[b] - pos[b])) <= most
        a, b = a[fit], b[fit]
        swap = d[a] > d[b]
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        return np.stack([d[a], d[b], n[a], n[b]])

    def between(rows: np.ndarray, left: np.ndarray, right: np.ndarray):
        """Pairs of places left x right with the left one first, some at a time."""
        step = max(1, BLOCK_PAIRS // max(1, len(right)))
        for k in range(0, len(left), step):
            some = left[k : k + step]
            a, b = np.repeat(some, len(right)), np.tile(right, len(some))
            yield pairs_of(rows, a[b > a], b[b > a])

    triangles: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def triangle(n: int) -> tuple[np.ndarray, np.ndarray]:
        if n not in triangles:
            triangles[n] = np.triu_indices(n, 1)
        return triangles[n]

    def run(batches):
        kept: list[np.ndarray] = []  # rows of the column that has not ended
        full = None  # the key of a column that has turned out to be too full

        def ended(rows: np.ndarray):
            """Pairs of a whole column, or None when there would be too many.

            Rows that only ask meet rows that don't, so a column of nothing but questions has no pairs at all.
            """
            told = rows[5] == 0
            if rows.shape[1] < 2 or not told.any():
                return np.zeros((4, 0), np.int64)
            if rows.shape[1] <= FEW_ROWS and (column_pairs is None or rows.shape[1] ** 2 <= column_pairs):
                rows = rows[:, np.lexsort((rows[1], rows[3]))]
                a, b = triangle(rows.shape[1])
                some = rows[5][a] == 0
                return pairs_of(rows, a, b) if some.all() else pairs_of(rows, a[some], b[some])
            groups, group = np.unique(rows[6], return_inverse=True)
            group = group.reshape(-1)
            sizes, telling = np.bincount(group), np.bincount(group[told], minlength=len(groups))
            many = int(told.sum()) * rows.shape[1] - int((sizes * telling).sum())
            if column_pairs is not None and many > column_pairs and rows.shape[1] > 2:
                return None
            if len(groups) == 1:
                return np.zeros((4, 0), np.int64)
            rows = rows[:, np.lexsort((rows[1], rows[3]))]
            told = rows[5] == 0
            # the largest group makes no pairs within itself
            most = rows[6] == groups[np.argmax(sizes)]
            every, rest = np.arange(rows.shape[1]), np.flatnonzero(~most)
            found = [*between(rows, np.flatnonzero(told & ~most), every), *between(rows, np.flatnonzero(told & most), rest)]
            return np.concatenate([np.zeros((4, 0), np.int64), *found], axis=1)

        def out(pairs: list[np.ndarray], lists: list[np.ndarray]):
            both = np.concatenate([np.zeros((4, 0), np.int64), *pairs], axis=1)
            if both.shape[1]:
                order = np.lexsort((both[1], both[0]))
                both = both[:, order]
                first = np.flatnonzero(np.concatenate(([True], (both[:2, 1:] != both[:2, :-1]).any(axis=0))))
                common = np.diff(np.append(first, both.shape[1]))
                both = np.concatenate([both[:, first], common[None]])
            else:
                both = np.zeros((5, 0), np.int64)
            more = np.concatenate([np.zeros((7, 0), np.int64), *lists], axis=1)
            np_, nl = both.shape[1], more.shape[1]
            column = lambda x, y: pa.array(np.concatenate([x, y]))
            zero = np.zeros(nl, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([np.zeros(np_, np.int64), more[0]]), mask=np.arange(np_ + nl) < np_),
                    column(both[0], more[1]), column(both[1], zero), column(both[2], more[2]), column(both[3], zero), column(both[4], zero),
                ],
                names=["key", "a", "b", "na", "nb", "common"],
            )

        def work(rows: np.ndarray, last: bool):
            nonlocal full, kept
            pairs, lists = [], []
            if full is not None and rows.shape[1]:
                same = rows[0] == full
                stop = rows.shape[1] if same.all() else int(np.argmin(same))
                if stop:
                    lists.append(rows[:, :stop])
                rows = rows[:, stop:]
                full = full if not rows.shape[1] else None
            if kept:
                rows = np.concatenate([*kept, rows], axis=1)
                kept = []
            starts = np.flatnonzero(np.concatenate(([True], rows[0, 1:] != rows[0, :-1]))) if rows.shape[1] else np.zeros(0, int)
            ends = np.append(starts[1:], rows.shape[1])
            if not last and len(starts):
                kept = [rows[:, starts[-1] :]]
                starts, ends = starts[:-1], ends[:-1]
            for s, e in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist()):
                got = ended(rows[:, s:e])
                if got is None:
                    lists.append(rows[:, s:e])
                elif got.shape[1]:
                    pairs.append(got)
            if kept and kept[0].shape[1] > COLUMN_ROWS:
                part, told = kept[0], kept[0][5] == 0
                # those that tell come first; once they are all there, questions can be answered and let go
                got = None if told.all() else ended(part)
                if got is None:
                    full = int(part[0, 0])
                    lists.append(part)
                    kept = []
                else:
                    pairs.append(got)
                    kept = [part[:, told]] if told.any() else []
            yield from out(pairs, lists)

        for batch in batches:
            yield from work(np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(7)]), False)
        yield from work(np.zeros((7, 0), np.int64), True)

    dealt = entries.select("key", "d", "n", "m", "pos", "ask", "g").repartition("key").sortWithinPartitions("key", "ask")
    return dealt.mapInArrow(run, "key long, a long, b long, na long, nb long, common long")


def sets_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, s): the sets of the documents in ``ids``, written to the shared folder."""

    def run(batches):
        own = hasher()
        for batch in batches:
            sets = [own.ngrams(t).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["doc_id", "s"])

    wanted = docs.select("doc_id", "text").join(broadcast_if_small(ids), "doc_id", "left_semi")
    return written(wanted.mapInArrow(run, "doc_id long, s binary"), "ngram-sets")


def _with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, sa, sb) for pairs (a, b)."""
    return (
        pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("s").alias("sa")), "a")
        .join(sets.select(F.col("doc_id").alias("b"), F.col("s").alias("sb")), "b")
        .select("a", "b", "sa", "sb")
    )


def checked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole sets link."""

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                keep.append(links(int(_member(x, y).sum()), len(x), len(y)))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return _with_sets(pairs, sets).mapInArrow(run, "a long, b long")


def differences(members: DataFrame, sets: DataFrame) -> DataFrame:
    """For (a = centre, b = document): (c, d, n, m, near, fresh, gone): whether they link, and what only one of them has."""

    def run(batches):
        for batch in batches:
            out = {k: [] for k in ("n", "m", "near", "fresh", "gone")}
            for c, x in zip(batch.column(2), batch.column(3)):
                c, x = np.frombuffer(c.as_buffer(), np.uint64), np.frombuffer(x.as_buffer(), np.uint64)
                fresh, gone = x[~_member(c, x)], c[~_member(x, c)]
                out["n"].append(len(x))
                out["m"].append(len(fresh) + len(gone))
                out["near"].append(links(len(x) - len(fresh), len(c), len(x)))
                out["fresh"].append(_longs(fresh))
                out["gone"].append(_longs(gone))
            longs = pa.list_(pa.int64())
            kinds = [pa.int64(), pa.int64(), pa.bool_(), longs, longs]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *[pa.array(v, k) for v, k in zip(out.values(), kinds)]], names=["c", "d", *out]
            )

    return _with_sets(members, sets).mapInArrow(
        run, "c long, d long, n long, m long, near boolean, fresh array<long>, gone array<long>"
    )


def entries_of(apart: DataFrame) -> DataFrame:
    """Entries of the elements that differences begin with: rare ones of a centre first, then what documents lack that
    the centre has, then what the centre lacks, which is common.

    Linked sets have together at most ``n + 100 n / t`` elements, so their differences differ by at most ``most``: under
    the first half of that many elements smaller differences are found, under the rest they are looked for.
    """

    def keyed(c: int, cell) -> np.ndarray:
        x = cell.values.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        return _mixed(x ^ _mixed(np.array([c], np.int64).view(np.uint64)))

    def count(batches):
        for batch in batches:
            rows = zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2))
            yield _counted([keyed(c, cell) for c, *cells in rows for cell in cells])

    late = _frequent(apart.select("c", "fresh", "gone").mapInArrow(count, "h long, n int"))
    shared = apart.sparkSession.sparkContext.broadcast(late)

    def begin(batches):
        late_ = shared.value
        for batch in batches:
            first = []
            for c, n, fresh, gone in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(5), batch.column(6)):
                fresh, gone = keyed(c, fresh), keyed(c, gone)
                f, g = _member(late_, fresh), _member(late_, gone)
                most = (100 - PERCENT) * (n + 100 * n // PERCENT + 1) // (100 + PERCENT)
                rare = np.sort(np.concatenate([fresh[~f], gone[~g]]))
                first.append(_longs(np.concatenate([rare, np.sort(gone[g]), np.sort(fresh[f])])[: most + 1]))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in (1, 2, 3, 4)], pa.array(first, pa.list_(pa.int64()))], names=["d", "n", "m", "g", "e"]
            )

    columns = apart.select("c", "d", "n", "m", "g", "fresh", "gone")
    begun = columns.mapInArrow(begin, "d long, n long, m long, g long, e array<long>")
    most = F.expr(f"{100 - PERCENT} * (n + 100 * n div {PERCENT} + 1) div {100 + PERCENT}")
    placed = begun.select("d", "n", "m", "g", most.alias("most"), F.posexplode("e").alias("pos", "key"))
    return placed.select("key", "d", "n", "m", F.col("pos").cast("long").alias("pos"), (F.col("pos") > F.expr("most div 2")).alias("ask"), "g")


def similar(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, component): rows (doc_id, n, rep) of every row of ``docs``, and (id, component) of linked representatives."""
    docs = docs.select("doc_id", "text")
    last = often(docs, np.zeros(0, np.uint64))
    # putting them last lets other frequent elements in; of those left after that, few are not of near copies
    last = np.union1d(last, often(docs, last))
    rows = written(sketched(docs, last), "ngram-rows")
    one = rows.where("f1 IS NOT NULL").groupBy("f1", "f2").agg(F.min(F.struct("doc_id", "n", "cold", "hot")).alias("r"))
    one = one.select("f1", "f2", "r.*")
    entry = [F.col("doc_id").alias("d"), "n", F.lit(0).cast("long").alias("m"), F.lit(0).cast("long").alias("pos"), F.lit(False).alias("ask"), F.col("doc_id").alias("g")]
    found = written(product(one.select(F.explode("cold").alias("key"), *entry), COLUMN_PAIRS), "ngram-pairs")
    lists = written(
        one.select(F.explode("hot").alias("key"), F.col("doc_id").alias("d"))
        .union(found.where("key IS NOT NULL").select("key", F.col("a").alias("d"))),
        "ngram-lists",
    )
    # Overlaps add up over blocks. What could still come lies behind the prefix of the set with the smaller last
    # element; a document in a full column has overlaps that were not counted, so two of those are kept.
    listed = lists.select(F.col("d").alias("l")).distinct()
    n_in = F.ceil(F.col("na") * PERCENT / 100) - 1
    n_in_b = F.ceil(F.col("nb") * PERCENT / 100) - 1
    needed = F.ceil((F.col("na") + F.col("nb")) * PERCENT / (100 + PERCENT))
    pairs = found.where("key IS NULL").groupBy("a", "b", "na", "nb").agg(F.sum("common").alias("common"))
    flagged = pairs.join(listed.withColumn("la", F.lit(True)), F.col("a") == F.col("l"), "left").drop("l")
    flagged = flagged.join(listed.withColumn("lb", F.lit(True)), F.col("b") == F.col("l"), "left").drop("l")
    pairs = written(
        flagged.where((F.col("common") + F.greatest(n_in, n_in_b) >= needed) | (F.col("la") & F.col("lb"))).select("a", "b"),
        "ngram-candidates",
    )
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).union(listed).distinct()
    sets = sets_of(docs, ids)
    edges, done, level = written(checked(pairs, sets), "ngram-links"), pairs, 0
    while lists.limit(1).count():
        level += 1
        # columns whose documents are all connected by now are done
        known = components(edges, "ngram-components")
        lists = lists.join(known, F.col("d") == F.col("id"), "left").select("key", "d", F.coalesce("component", "d").alias("g"))
        lists = written(lists, "ngram-grouped")
        # the centre of a column is its document in most columns: it lacks least of what they share
        often_in = lists.groupBy("d").agg(F.count("*").alias("n_in"))
        centres = lists.join(often_in, "d").groupBy("key").agg(
            F.max_by(F.struct("d", "g"), F.struct("n_in", -F.col("d"))).alias("c"), (F.min("g") < F.max("g")).alias("open")
        )
        members = lists.join(centres.where("open"), "key").where("d <> c.d")
        members = members.select(F.col("c.d").alias("a"), F.col("d").alias("b"), "g", F.col("c.g").alias("cg")).distinct()
        members = written(members, "ngram-members")
        apart = written(differences(members.select("a", "b"), sets), "ngram-differences")
        edges = edges.union(apart.where("near").select(F.col("c").alias("a"), F.col("d").alias("b")))
        groups = members.select(F.col("a").alias("c"), F.col("b").alias("d"), "g", "cg")
        apart = apart.join(groups, ["c", "d"]).withColumn("g", F.when(F.col("near"), F.col("cg")).otherwise(F.col("g"))).drop("cg", "near")
        found = written(product(entries_of(apart), DIFFERENCE_PAIRS if level <= LEVELS else None), "ngram-pairs")
        pairs = written(found.where("key IS NULL").select("a", "b").distinct().join(done, ["a", "b"], "left_anti"), "ngram-candidates")
        done = done.union(pairs)
        edges = edges.union(written(checked(pairs, sets), "ngram-links"))
        lists = written(found.where("key IS NOT NULL").select("key", F.col("a").alias("d")), "ngram-lists")
    rep = one.select("f1", "f2", F.col("doc_id").alias("rep"))
    key = [rows["f1"] == rep["f1"], rows["f2"] == rep["f2"]]
    members = rows.select("doc_id", "n", "f1", "f2").join(rep, key, "left").select("doc_id", "n", "rep")
    return members, components(edges, "ngram-components")


def grouped(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row of ``docs`` (doc_id, text)."""
    members, found = similar(docs)
    out = members.join(found, F.col("rep") == F.col("id"), "left")
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep", "doc_id").alias("component_id")
    )


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped(table(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN []
    WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS x FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id),
link AS (
  SELECT a, b FROM common JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
  WHERE 100 * c >= 80 * (na.n + nb.n - c)),
both_ways AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (
  SELECT a AS id, a AS r FROM both_ways UNION SELECT reach.id, e.b FROM reach JOIN both_ways e ON e.a = reach.r)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.component, d.doc_id) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id
LEFT JOIN (SELECT id, min(r) AS component FROM reach GROUP BY id) c ON c.id = d.doc_id"""
