"""Pieces that several operators of this package share."""

from __future__ import annotations

import gc
from collections.abc import Callable, Hashable
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from woonvonk.session import scratch_path, shared_folder, ship_package


BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = str(16 << 20)

T = TypeVar("T")
_KEPT: dict[Hashable, object] = {}


def kept_in_worker(key: Hashable, make: Callable[[], T]) -> T:
    """What a Python worker keeps from task to task: one thing at a time.

    Workers outlive stages; what another operator has kept goes before something new is made, so that an executor needs
    the most that one operator keeps and not the sum over all.
    """
    if key not in _KEPT:
        _KEPT.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        _KEPT[key] = make()
    return _KEPT[key]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once to the shared folder and read again.

    This cuts lineage, survives lost executors, and gives the planner true sizes, so that it broadcasts only what it
    has measured to be small. Batches that go to Python while it is written are bounded by bytes as well as by rows.
    """
    spark = df.sparkSession
    shared_folder(spark)
    path = scratch_path(spark, label)
    before = spark.conf.get(BATCH, None)
    spark.conf.set(BATCH, BATCH_BYTES)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(BATCH, before) if before is not None else spark.conf.unset(BATCH)
    return spark.read.schema(df.schema).parquet(path)


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """Connected components of undirected ``edges`` (a, b): one row (id, component) per node, component = smallest id.

    Alternates large-star and small-star steps, each a map-side minimum per node and an equi-join that adaptive
    execution splits when one node holds most edges. Every step is written to the shared folder; the driver sees only a
    row count and a checksum. Edges with nulls and loops are ignored; no edges give no rows.
    """
    now = (
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    now = written(now, label)
    seen = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen or mark[0] == 0:
            break
        seen = mark
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("c"), F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, F.col("a") == F.col("c")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("c"), "m")
        small = large.join(low, F.col("a") == F.col("c")).select("b", "m").union(
            low.select(F.col("c").alias("b"), "m")
        )
        now = written(small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), label)
    leaf = now.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return leaf.union(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
