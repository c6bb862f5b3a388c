"""Near-duplicate vectors by NN-descent on a neighbour graph.

Equal vectors of one label are one node. Lists of the ``k`` nearest neighbours start from a few hashing forests: nodes are
ordered by sign bits of random planes and compared within short runs. Then neighbours of neighbours are joined: every
node sends its list to a local join that compares all members with each other and offers each the better ones, until
offers run dry. Edges under the threshold go. A list that is full of links is saturated; it is enlarged to the whole
component, block against block, which gives every node its exact number of links inside its component without
writing pairs. What may still be missing are links between components: an audit compares samples of nodes with
all others until it has met enough linked ones, and while recall is under the target, lists and forests grow and the
descent goes on. When that does not reach the target either, all nodes of a label are compared, block against block.

Cosines are double-precision products of unit vectors. Null vectors and labels, zero vectors, and vectors with null or
non-finite components link with nothing; so do vectors of different lengths. Rows that repeat a vec_id are vectors of
their own with that id. Rows without vec_id may link; a component of such rows only has no id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from woonvonk.llm.common import components, table, written

THRESHOLD = 0.98
NEIGHBOURS = 6
FORESTS = 4
PLANES = 32
RUN = 512
ROUNDS = 4
# The descent ends when a round improves less than this share of all list places.
LEAST_CHANGE = 0.002
BLOCK = 1024
# The audit draws so many nodes first, twice as many each time up to the most a pass may hold, until it has met so many linked ones.
AUDIT = 512
AUDIT_PASS = 4096
AUDIT_LINKED = 300
RECALL = 0.97
GROWTHS = 3


def unit(vector) -> np.ndarray | None:
    """The unit vector in double precision, or None when it can link with nothing."""
    if vector is None or len(vector) == 0 or any(x is None for x in vector):
        return None
    v = np.asarray(vector, np.float64)
    top = np.abs(v).max()
    if not np.isfinite(v).all() or top == 0:
        return None
    v = v / top
    return v / np.sqrt(v @ v)


def forest_keys(v: np.ndarray, forests: range) -> list[int]:
    """Per forest the sign bits of ``v`` against its planes, first plane in the highest bit."""
    out, powers = [], 1 << np.arange(PLANES - 1, -1, -1, dtype=np.int64)
    for t in forests:
        planes = _planes(t, len(v))
        out.append(int(((planes @ v > 0) * powers).sum()))
    return out


_PLANES: dict[tuple[int, int], np.ndarray] = {}


def _planes(forest: int, size: int) -> np.ndarray:
    key = (forest, size)
    if key not in _PLANES:
        _PLANES[key] = np.random.RandomState(1000 * forest + 7).standard_normal((PLANES, size))
    return _PLANES[key]


def units(rows: DataFrame) -> DataFrame:
    """(vec_id, label, size, u): unit vectors as bytes; ``u`` is null where nothing can link."""

    def run(batches):
        for batch in batches:
            found = [unit(v) for v in batch.column(1).to_pylist()]
            labels = batch.column(2).to_pylist()
            found = [None if label is None else u for u, label in zip(found, labels)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(2), pa.array([0 if u is None else len(u) for u in found], pa.int32()),
                    pa.array([None if u is None else u.tobytes() for u in found], pa.binary()),
                ],
                names=["vec_id", "label", "size", "u"],
            )

    columns = rows.select("vec_id", F.col("embedding").cast("array<double>").alias("e"), F.col("label").cast("string").alias("label"))
    return columns.mapInArrow(run, "vec_id long, label string, size int, u binary")


def _streamed(batches: Iterator[pa.RecordBatch], n_keys: int, limit: int | None) -> Iterator[list[list]]:
    """Rows of sorted batches as groups of equal first ``n_keys`` columns, cut after ``limit`` rows."""
    held: list = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if held and (row[:n_keys] != held[0][:n_keys] or (limit and len(held) >= limit)):
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _matrix(rows: list, at: int) -> np.ndarray:
    return np.stack([np.frombuffer(r[at], np.float64) for r in rows])


def forest_edges(nodes: DataFrame, forests: range, k: int) -> DataFrame:
    """(a, b, sim): for every node its best ``k`` within its run of each forest."""

    @F.pandas_udf("array<long>")
    def keys(vectors):
        return vectors.map(lambda u: forest_keys(np.frombuffer(u, np.float64), forests))

    def run(batches):
        for rows in _streamed(batches, 3, RUN):
            ids, m = np.array([r[4] for r in rows]), _matrix(rows, 5)
            if len(ids) < 2:
                continue
            s = m @ m.T
            np.fill_diagonal(s, -2.0)
            top = min(k, len(ids) - 1)
            best = np.argpartition(-s, top - 1, axis=1)[:, :top]
            a = np.repeat(ids, top)
            yield pa.RecordBatch.from_arrays(
                [pa.array(a), pa.array(ids[best.ravel()]), pa.array(np.take_along_axis(s, best, 1).ravel())], names=["a", "b", "sim"]
            )

    dealt = nodes.select("label", "size", F.posexplode(keys("u")).alias("forest", "bits"), "id", "u")
    dealt = dealt.select("label", "size", "forest", "bits", "id", "u")
    order = ["label", "size", "forest", "bits", "id"]
    parts = max(2, int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return dealt.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(run, "a long, b long, sim double")


def nearest(edges: DataFrame, k: int) -> DataFrame:
    """The best ``k`` edges of every ``a``."""
    once = edges.groupBy("a", "b").agg(F.max("sim").alias("sim"))
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("sim"), "b"))
    return once.withColumn("r", rank).where(F.col("r") <= k).drop("r")


def offers(graph: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """(a, b, sim) that local joins find better than the worst in a's list.

    A node's local join has the best ``k`` of those it lists and the best ``k`` of those that list it.
    """
    worst = graph.groupBy("a").agg(F.when(F.count("*") >= k, F.min("sim")).otherwise(-2.0).alias("worst"))
    back = nearest(graph.select(F.col("b").alias("a"), F.col("a").alias("b"), "sim"), k)
    lists = graph.select("a", "b").union(back.select("a", "b")).distinct()
    member = nodes.select(F.col("id").alias("b"), "u").join(worst.withColumnRenamed("a", "b"), "b", "left")
    member = member.withColumn("worst", F.coalesce("worst", F.lit(-2.0)))
    grouped = lists.join(member, "b").groupBy("a").agg(F.collect_list(F.struct("b", "worst", "u")).alias("l"))  # at most 2 k each

    def run(batches):
        for batch in batches:
            a, b, sims = [], [], []
            for cell in batch.column(0):
                rows = cell.values
                if len(rows) < 2:
                    continue
                ids = rows.field("b").to_numpy()
                worst_ = rows.field("worst").to_numpy()
                m = np.stack([np.frombuffer(u.as_buffer(), np.float64) for u in rows.field("u")])
                s = m @ m.T
                np.fill_diagonal(s, -3.0)
                i, j = np.nonzero(s > worst_[:, None])
                a.append(ids[i])
                b.append(ids[j])
                sims.append(s[i, j])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (a, b, sims)], names=["a", "b", "sim"])

    return grouped.select("l").mapInArrow(run, "a long, b long, sim double")


def descend(graph: DataFrame, nodes: DataFrame, k: int, n: int) -> DataFrame:
    for _ in range(ROUNDS):
        better = nearest(graph.union(offers(graph, nodes, k)), k)
        after = written(better.join(graph.select("a", "b", F.lit(0).alias("new")), ["a", "b"], "left").withColumn("new", F.col("new").isNull()), "neighbours")
        changed = after.where("new").count()
        graph = after.select("a", "b", "sim")
        if changed <= LEAST_CHANGE * n * k:
            break
    return graph


def links_inside(nodes: DataFrame, found: DataFrame, threshold: float) -> DataFrame:
    """(id, n): for every node of a component (id, component) the rows of linked nodes, counted block against block."""
    sizes = found.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    placed = found.join(sizes, "component").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts").cast("long")).cast("int"))
    placed = placed.select("component", "id", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    keyed = placed.select("component", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "id", "part")
    dealt = keyed.join(nodes.select("id", "copies", "u"), "id").select("component", "i", "j", "part", "id", "copies", "u")

    def run(batches):
        for rows in _streamed(batches, 3, None):
            i, j = rows[0][1], rows[0][2]
            parts, ids, copies = (np.array([r[c] for r in rows]) for c in (3, 4, 5))
            m = _matrix(rows, 6)
            if i == j:
                hit = (m @ m.T) >= threshold
                np.fill_diagonal(hit, False)
                n = hit @ copies
            else:
                left, right = parts == i, parts == j
                hit = (m[left] @ m[right].T) >= threshold
                n = np.zeros(len(ids), np.int64)
                n[left], n[right] = hit @ copies[right], hit.T @ copies[left]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n.astype(np.int64))], names=["id", "n"])

    order = ["component", "i", "j"]
    counts = dealt.repartition(*order).sortWithinPartitions(*order).mapInArrow(run, "id long, n long")
    return counts.groupBy("id").agg(F.sum("n").alias("n"))


def exact(nodes: DataFrame, found: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Every node's rows of linked nodes (id, n), and (id, component) over all links: all nodes of a label and size are compared.

    Only links between components of ``found`` are written, a block's as one edge per component that takes another's id.
    """
    groups = nodes.groupBy("label", "size").agg(F.min("id").alias("g"), F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    placed = nodes.select("label", "size", "id", "copies", "u").join(groups, ["label", "size"]).join(found, "id", "left")
    placed = placed.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts").cast("long")).cast("int"))
    placed = placed.withColumn("component", F.coalesce("component", "id")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = placed.select("g", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "id", "copies", "component", "u")

    def run(batches):
        for rows in _streamed(batches, 3, None):
            i, j = rows[0][1], rows[0][2]
            parts, ids, copies, own = (np.array([r[c] for r in rows], np.int64) for c in (3, 4, 5, 6))
            m = _matrix(rows, 7)
            left, right = np.flatnonzero(parts == i), np.flatnonzero(parts == j)
            hit = (m[left] @ m[right].T) >= threshold
            n = np.zeros(len(ids), np.int64)
            if i == j:
                np.fill_diagonal(hit, False)
                n[left] = hit @ copies[right]
            else:
                n[left], n[right] = hit @ copies[right], hit.T @ copies[left]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n), pa.nulls(len(ids), pa.int64())], names=["id", "n", "b"])
            # the smallest component id goes round along links between components until it stands still
            x, y = np.nonzero(hit & (own[left][:, None] != own[right][None]))
            x, y, now = left[x], right[y], own.copy()
            while True:
                before = now.copy()
                np.minimum.at(now, x, before[y])
                np.minimum.at(now, y, before[x])
                if (now == before).all():
                    break
            pairs = np.unique(np.stack([own, now])[:, own != now], axis=1)
            if pairs.size:
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.nulls(pairs.shape[1], pa.int64()), pa.array(pairs[1])], names=["id", "n", "b"])

    order = ["g", "i", "j"]
    done = written(dealt.repartition(*order).sortWithinPartitions(*order).mapInArrow(run, "id long, n long, b long"), "vector-exact")
    edges = found.select(F.col("id").alias("a"), F.col("component").alias("b")).union(done.where("b IS NOT NULL").select("id", "b"))
    counted = written(done.where("b IS NULL").groupBy("id").agg(F.sum("n").alias("n")), "vector-links")
    return counted, written(components(edges, "vector-components"), "vector-components")


def audit(nodes: DataFrame, counted: DataFrame, threshold: float) -> float:
    """Mean share of their links that sampled linked nodes have, against all nodes; 1 when no node has a link.

    Samples are slices by hash, so nothing depends on what the descent found. They go on until AUDIT_LINKED nodes with a
    true link have been measured or every node has.
    """
    n, size, low, shares = nodes.count(), AUDIT, 0, []
    place, whole = F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1 << 40)), 1 << 40
    while low < whole and n:
        high = min(whole, low + -(-whole * size // n))
        shares += _shares(nodes, nodes.where((place >= low) & (place < high)), counted, threshold)
        if len(shares) >= AUDIT_LINKED:
            break
        low, size = high, min(2 * size, AUDIT_PASS)
    return float(np.mean(shares)) if shares else 1.0


def _shares(nodes: DataFrame, sample: DataFrame, counted: DataFrame, threshold: float) -> list[float]:
    """The share of its links that each linked node of a small ``sample`` has in ``counted``."""
    rows = sample.join(counted, "id", "left").select("id", "label", "size", "u", F.coalesce("n", F.lit(0)).alias("n")).collect()
    if not rows:
        return []
    asked = [(r["id"], r["label"], r["size"], bytes(r["u"])) for r in rows]
    shared = nodes.sparkSession.sparkContext.broadcast(asked)

    def run(batches):
        groups: dict = {}
        for q in shared.value:
            groups.setdefault(q[1:3], []).append(q)
        total: dict = {}
        for batch in batches:
            kinds = list(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()))
            ids, copies = batch.column(0).to_numpy(), batch.column(3).to_numpy()
            for kind in set(kinds) & set(groups):
                at = [k for k, x in enumerate(kinds) if x == kind]
                m = np.stack([np.frombuffer(batch.column(4)[k].as_buffer(), np.float64) for k in at])
                own = groups[kind]
                hit = (m @ np.stack([np.frombuffer(q[3], np.float64) for q in own]).T) >= threshold
                hit &= ids[at][:, None] != np.array([q[0] for q in own])[None]
                for q, c in zip(own, copies[at] @ hit):
                    total[q[0]] = total.get(q[0], 0) + int(c)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], names=["id", "t"])

    true = nodes.select("id", "label", "size", "copies", "u").mapInArrow(run, "id long, t long").groupBy("id").agg(F.sum("t").alias("t"))
    true = {r["id"]: r["t"] for r in true.collect()}
    shared.unpersist()
    return [r["n"] / true[r["id"]] for r in rows if true.get(r["id"], 0)]


def near_duplicates(rows: DataFrame, threshold: float = THRESHOLD, note: Callable[[float], None] = lambda recall: None) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row of ``rows`` (vec_id, embedding, label); ``note`` is told audited recalls."""
    every = written(units(rows).withColumn("row", F.monotonically_increasing_id()), "units")
    # unit vectors that are equal in every bit are one node
    nodes = every.where("u IS NOT NULL").groupBy("label", "size", "u").agg(
        F.min("row").alias("id"), F.count("*").alias("copies"), F.min("vec_id").alias("least")
    )
    nodes = written(nodes, "vectors")
    n, k, forests = nodes.count(), NEIGHBOURS, range(FORESTS)
    graph = None
    for growth in range(GROWTHS + 1):
        fresh = forest_edges(nodes, forests, k)
        graph = written(nearest(fresh if graph is None else graph.union(fresh), k), "neighbours")
        graph = descend(graph, nodes, k, n)
        edges = graph.where(F.col("sim") >= threshold).select("a", "b")
        found = written(components(edges, "vector-components"), "vector-components")
        counted = written(links_inside(nodes, found, threshold), "vector-links")
        recall = audit(nodes, counted, threshold)
        note(recall)
        if recall >= RECALL:
            break
        k, forests = 2 * k, range(forests.stop, forests.stop + FORESTS * 2 ** (growth + 1))
    else:
        counted, found = exact(nodes, found, threshold)
        note(1.0)
    named = nodes.select("id", "least", "copies", "label", "size", "u").join(found, "id", "left").join(counted, "id", "left")
    named = named.withColumn("group", F.coalesce("component", "id"))
    smallest = named.groupBy("group").agg(F.min("least").alias("component_id"))
    named = named.join(smallest, "group").select("label", "size", "u", "component_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = every.join(named, ["label", "size", "u"], "left")
    own = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), own.alias("component_id"), F.coalesce(F.col("vec_id") == own, F.lit(False)).alias("kept"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


OP3_SQL = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: cast(x AS double)) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
both_ways AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT a AS id, a AS r FROM both_ways UNION SELECT reach.id, e.b FROM reach JOIN both_ways e ON e.a = reach.r)
SELECT d.vec_id, coalesce(n.n, 0) AS n_links, coalesce(c.component, d.vec_id) AS component_id,
  coalesce(c.component, d.vec_id) = d.vec_id AS kept
FROM embeddings d
LEFT JOIN (SELECT a AS id, count(*) AS n FROM both_ways GROUP BY a) n ON n.id = d.vec_id
LEFT JOIN (SELECT id, min(r) AS component FROM reach GROUP BY id) c ON c.id = d.vec_id"""
