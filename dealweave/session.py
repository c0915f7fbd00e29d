"""Session helpers shared by all operators: table access, shared checkpoints, size-checked broadcasts."""

from __future__ import annotations

import os
import re
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ship_package(spark: SparkSession) -> None:
    """Give Python workers this package through the driver's file server, wherever they run; once per context."""
    sc = spark.sparkContext
    if getattr(sc, "_dealweave_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = os.path.join(tempfile.mkdtemp(prefix="dealweave-"), "dealweave.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(archive)
    sc._dealweave_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` under ``sf_dir``."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Point checkpoints at the folder the cluster shares in ``spark.checkpoint.dir``.

    A local folder is made only where none is set and the session runs in one process (tests); a cluster without the
    setting is an error, as executors would not see each other's files. Checkpoints that nothing refers to any more are
    deleted by Spark's cleaner.
    """
    sc = spark.sparkContext
    sc._jsc.sc().conf().set("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    if sc.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        shared = os.path.join(tempfile.gettempdir(), "dealweave-checkpoints")
    sc.setCheckpointDir(shared)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` into replicated files of the shared folder, so a lost executor costs no recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def bounded_broadcast(df: DataFrame, max_rows: int) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``max_rows`` rows; otherwise unchanged, so Spark shuffles it.

    The check reads at most ``max_rows + 1`` rows.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def bounded_collect(df: DataFrame, max_rows: int, what: str) -> list:
    """Rows of a dimension table whose size is bounded by contract; a larger one is an error, never a silent cut."""
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"{what} has more than {max_rows} rows; it is meant to be a small reference table")
    return rows
