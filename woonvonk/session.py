"""Session settings and the shared folder for cut lineage and written tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from io import BytesIO
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A result set at or below this many rows is small enough to send to every executor;
# at 200 bytes a row it stays under 40 MB.
BROADCAST_ROW_LIMIT = 200_000


def build_session(app_name: str = "woonvonk", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every job here relies on (UTC, adaptive execution)."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so that their Python workers can import it."""
    context = spark.sparkContext
    if getattr(context, "_woonvonk_shipped", False):
        return
    root = Path(__file__).resolve().parent
    if root.is_dir():  # from a zip the package was shipped already
        held = BytesIO()
        with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as archive:
            for path in sorted(root.rglob("*.py")):
                archive.write(path, path.relative_to(root.parent))
        made = Path(tempfile.mkdtemp(prefix="woonvonk-")) / "woonvonk.zip"
        made.write_bytes(held.getvalue())
        context.addPyFile(str(made))
        atexit.register(shutil.rmtree, made.parent, ignore_errors=True)
    context._woonvonk_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only a session whose driver and executors are one machine (master ``local``) may go without: it gets a folder of
    its own, removed when Python ends. Elsewhere a missing setting is an error, because executors would write to disks
    that nobody else reads.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="woonvonk-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", named)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder for a written table."""
    return f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and cut its lineage in the shared folder (survives lost executors)."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def broadcast_if_small(df: DataFrame, row_limit: int = BROADCAST_ROW_LIMIT) -> DataFrame:
    """Count a reduced table and hint a broadcast only when it is small.

    Above the limit the table is returned without a hint: the join becomes a shuffled one
    and adaptive execution splits skewed partitions.
    """
    kept = materialise(df)
    if kept.limit(row_limit + 1).count() <= row_limit:
        return F.broadcast(kept)
    return kept


def spread(df: DataFrame, per_core: int = 1) -> DataFrame:
    """Rows over all cores, ``per_core`` tasks each, when the input came as less than half as many tasks.

    For work that costs much more than moving the rows, such as reading pages. Large tables have more tasks
    than cores and are left as they are.
    """
    tasks = df.sparkSession.sparkContext.defaultParallelism * per_core
    return df.repartition(tasks) if df.rdd.getNumPartitions() * 2 <= tasks else df
