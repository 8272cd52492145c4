"""Session plumbing shared by the operators: tables, shared folder, size-checked broadcasts."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows a side may have to be broadcast, and about its bytes.
BROADCAST_ROWS, BROADCAST_BYTES = 300_000, 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir.

    Where the cluster names none (local tests), a folder of this machine is set, which is
    safe there as the only executor is this process.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if named is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = os.path.join(tempfile.gettempdir(), f"strandlake-{sc.applicationId}")
        spark.conf.set("spark.checkpoint.dir", named)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
        own = sc._jvm.org.apache.hadoop.fs.Path(sc.getCheckpointDir())
        # Spark makes a folder of the application's own in the shared one; it goes when the application does.
        atexit.register(_delete, own.getFileSystem(sc._jsc.hadoopConfiguration()), own)
    return named


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the application's own part of the shared folder, for files that go when it does."""
    shared_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}/{name}"


def _delete(fs, path) -> None:
    try:
        fs.delete(path, True)
    except Exception:  # noqa: BLE001  (the JVM may be gone first; nothing else is lost)
        pass


def drop_checkpoints(spark: SparkSession) -> None:
    """Removes what cut_lineage has written so far. Only for when no result that builds on it is still to be computed."""
    at = spark.sparkContext.getCheckpointDir()
    if at is not None:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        fs.delete(path, True)
        fs.mkdirs(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and go on from there: a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small_enough(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether df has at most max_rows rows and, written as text, max_bytes bytes. Stops counting beyond the rows."""
    size = F.octet_length(F.struct(*[F.col(f"`{c}`") for c in df.columns]).cast("string"))
    r = df.limit(max_rows + 1).agg(F.count("*").alias("n"), F.coalesce(F.sum(size.cast("long")), F.lit(0)).alias("b")).first()
    return r["n"] <= max_rows and r["b"] <= max_bytes


def join_bounded(big: DataFrame, small: DataFrame, on: list[str], how: str, max_rows: int = BROADCAST_ROWS, salt_of: str | None = None, salts: int = 32, when: F.Column | None = None) -> DataFrame:
    """Join that broadcasts `small` only when its rows and bytes are within the bounds.

    Beyond them: a shuffle join on (on, salt). Rows of `big` get the salt from the hash of
    `salt_of`, `small` is repeated for each salt, so a key with a third of all rows is spread over
    `salts` tasks. how: left, inner, left_anti or left_semi (those keep their meaning under salting).
    when: a further condition, by the names of both sides' other columns.
    """
    if how not in ("left", "inner", "left_anti", "left_semi"):
        raise ValueError(how)
    if small_enough(small, max_rows):
        small = F.broadcast(small)
    elif salt_of is not None:
        on = [*on, "_salt"]
        big = big.withColumn("_salt", F.pmod(F.xxhash64(salt_of), F.lit(salts)).cast("int"))
        small = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    if when is None:
        return big.join(small, on, how).drop("_salt")
    own = {c: f"_on_{i}" for i, c in enumerate(on)}
    small = small.withColumnsRenamed(own)
    for c, o in own.items():
        when = when & (F.col(c) == F.col(o))
    return big.join(small, when, how).drop("_salt", *own.values())


def key_text(c) -> F.Column:
    """A text key as compared: trimmed of blanks at either end; empty becomes null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.nullif(F.trim(c), F.lit(""))


def micros(c) -> F.Column:
    """A timestamp (with or without zone) as microseconds since the epoch."""
    c = F.col(c) if isinstance(c, str) else c
    return F.unix_micros(c.cast("timestamp"))


def spread(df: DataFrame, per_core: int = 2, at_least: int = 1) -> DataFrame:
    """df over enough partitions for slow work: as it is where it has at_least a core, else dealt out evenly.

    A small file of few splits would otherwise keep most cores idle. At scale the splits suffice and
    nothing is moved.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= at_least * cores else df.repartition(per_core * cores)
