"""Session set-up, table access and lineage cutting shared by all modules."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes (counted) up to which the small side of a look-up is broadcast, and the parts a hot key is dealt into beyond.
BROADCAST_BYTES, SALTS = 64 << 20, 32


def build_session(app: str = "foliolake", master: str = "local[*]", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings every result here assumes (UTC, ANSI on, AQE on)."""
    return (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, per_core: int = 2) -> DataFrame:
    """``df`` in at least ``per_core`` partitions a core, for work that is heavy for each row.

    A table of few files would keep most cores idle; it is small then, and dealing it out is cheap.
    A table that already has the partitions - any large one - is left alone, without a shuffle.
    Call it on a plain scan, whose partitions are known without running anything.
    """
    want = df.sparkSession.sparkContext.defaultParallelism * per_core
    return df.repartition(want) if df.rdd.getNumPartitions() < want else df


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all executors share. On one machine (local masters) a temporary one serves where it is unset; a cluster without it is an error."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="foliolake-")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` with a reliable checkpoint in the cluster's shared folder."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def lookup(df: DataFrame, small: DataFrame, key: str, by: str) -> DataFrame:
    """``df`` with the columns of ``small``, one row for each ``key``; null where there is none.

    A small side of at most ``BROADCAST_BYTES`` (counted, not guessed) is broadcast and ``df`` stays
    where it is. A larger one is joined by shuffle, each of its rows repeated for ``SALTS`` salts
    and the rows of ``df`` dealt over them by a hash of ``by``, so that a key which holds a third of all
    rows is no one task.
    """
    small = small.dropDuplicates([key])
    size = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) + 8 for c in small.columns), F.lit(0))
    if (small.select(size.alias("n")).agg(F.sum("n")).first()[0] or 0) <= BROADCAST_BYTES:
        return df.join(F.broadcast(small), key, "left")
    salt = F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")
    many = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return df.withColumn("_salt", F.coalesce(salt, F.lit(0))).join(many, [key, "_salt"], "left").drop("_salt")


def worker_env() -> None:
    """One thread per Python worker: parallelism comes from the tasks."""
    os.environ.setdefault("OMP_NUM_THREADS", "1")
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
