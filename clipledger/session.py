"""Session, table loading and lineage cuts."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HOT_ROWS_CONF = "spark.clipledger.hotGroupRows"
HOT_ROWS_DEFAULT = 1_000_000


def build_session(cpus: str = "*", memory: str = "12g", shuffle_partitions: int = 8) -> SparkSession:
    """Local session for tests and benchmarks; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("clipledger")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


class Tables:
    """Attribute access to the Parquet tables of one directory: ``Tables(spark, dir).orders``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")


def settle(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint, so that the rows (and ids drawn for them) stay fixed
    when executors are lost."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder of this application, below the one the session names in ``spark.checkpoint.dir``. A session
    that names none gets a temporary folder in local mode, where all tasks share one machine, and an error elsewhere."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="clipledger-"))
    return sc.getCheckpointDir()


def hot_limit(spark: SparkSession) -> int:
    """Rows above which a group is no longer handled by one task."""
    return int(spark.conf.get(HOT_ROWS_CONF, str(HOT_ROWS_DEFAULT)))


def join_same(left: DataFrame, right: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on equally named keys where null matches null; right keys are dropped."""
    if not by:
        raise ValueError("a join needs keys")
    renamed = right.select(*[F.col(c).alias(f"_r_{c}") if c in by else F.col(c) for c in right.columns])
    cond = None
    for c in by:
        one = F.col(c).eqNullSafe(F.col(f"_r_{c}"))
        cond = one if cond is None else cond & one
    out = left.join(renamed, cond, how)
    return out.drop(*[f"_r_{c}" for c in by])


def spread_groups(df: DataFrame, by: list[str]) -> DataFrame:
    """Hash-partition by key into the session's shuffle partitions, which adaptive execution then leaves alone: for
    work whose cost is in the rows' content rather than in their bytes."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *[F.col(b) for b in by])
