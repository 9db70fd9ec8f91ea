"""Session helpers shared by all operators: table access, lineage cuts, skew-safe joins.

Nothing here holds data. The only state is the checkpoint folder, which is read
from ``spark.checkpoint.dir``; a temporary folder is used solely when that setting
is absent and the session runs in one process, as in tests.
"""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` under ``sf_dir`` (a file or a folder of files)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read back.

    Executors can be lost: unlike a local checkpoint the files survive that. Without ``spark.checkpoint.dir`` a session
    of more than one process is refused, since its executors share no temporary folder.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="scriptoria-"))
    return df.checkpoint(eager)


def parallelism(spark: SparkSession) -> int:
    """Number of shuffle partitions the session is configured for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame, *keys: str | Column) -> DataFrame:
    """``df`` hashed over the session's shuffle partitions (round robin without keys).

    The count is explicit so that adaptive execution does not fold the partitions
    of a CPU-bound Python stage into a few because their bytes are small.
    """
    n = parallelism(df.sparkSession)
    return df.repartition(n, *keys)


def hashed_sample(df: DataFrame, rows: int, total: int | None = None) -> list:
    """At most ``rows`` rows of ``df``, picked by a hash of the whole row: the same rows at every run and partitioning.

    A threshold on the hash, set by the number of rows, leaves little more than the sample before anything is ordered or sent,
    so what reaches the driver does not grow with ``df``. ``total``: the number of rows of ``df``, or of a table that it was filtered from,
    where counting ``df`` would cost a pass of its own; the more the filter leaves out, the smaller the sample.
    """
    total = df.count() if total is None else total
    if not total or rows <= 0:
        return []
    steps = 1 << 40
    place = F.pmod(F.xxhash64(*df.columns), F.lit(steps))
    cut = min(steps, round(steps * (1.2 * rows + 200) / total))
    return df.where(place < cut).orderBy(place, *df.columns).limit(rows).collect()


def widen(df: DataFrame) -> DataFrame:
    """``df`` spread over more tasks if its scan has fewer than the session has cores, as a small single file has; else as it is.

    Inputs large enough to have a partition per core are never shuffled by this.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.isStreaming or df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def salted_join(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner", salts: int = 16) -> DataFrame:
    """Equi-join in which one key of ``big`` may hold a large share of all rows.

    ``small`` must be unique in ``on``; it is replicated ``salts`` times and each row of
    ``big`` meets exactly one replica, so the result equals the plain join. Null keys
    never match. ``how``: inner, left, left_semi or left_anti.
    """
    salt = "__salt"
    left = big.withColumn(salt, F.pmod(F.xxhash64(*[F.col(c) for c in big.columns]), F.lit(salts)).cast("int"))
    right = small.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*on, salt], how).drop(salt)


def first_delivery(df: DataFrame, key: str, order: str = "ingested_at") -> DataFrame:
    """One row per ``key``: the row with the smallest ``order`` (ties: any, rows are equal by contract).

    A two-phase aggregate: each map task keeps one row per key, so repeated deliveries
    of a hot key are dropped before the shuffle. Null keys are kept as one row.
    """
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min_by(F.struct(*rest), F.col(order)).alias("__r")).select(key, *[F.col("__r")[c].alias(c) for c in rest]).select(*df.columns)


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of ``spark``, once per application."""
    import shutil
    from pathlib import Path

    sc = spark.sparkContext
    if getattr(sc, "_scriptoria_shipped", False):
        return
    root = Path(__file__).resolve().parent
    staging = Path(tempfile.mkdtemp(prefix="scriptoria-"))
    shutil.copytree(root, staging / "tree" / root.name, ignore=shutil.ignore_patterns("__pycache__", "*.pyc"))
    sc.addPyFile(shutil.make_archive(str(staging / f"{root.name}-{id(sc):x}"), "zip", staging / "tree"))
    sc._scriptoria_shipped = True
