"""Session settings and lineage cuts.

The settings below are the ones the operators are designed around: AQE on
(runtime coalescing, skew-join splitting, broadcast conversion from measured
sizes), a broadcast threshold that keeps the size check with Spark's own
statistics, and UTC so TIMESTAMP_NTZ literals and driver parquet agree.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NullType

# Settings every operator assumes; ``build_session`` applies them.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None, app: str = "rosterlake",
                  extra: dict[str, str] | None = None) -> SparkSession:
    """A session with the operators' settings. Master, shuffle partitions and
    memory are the submitting environment's unless given here."""
    b = (SparkSession.builder.appName(app)
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false"))
    if master is not None:
        b = b.master(master)
    if shuffle_partitions is not None:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if "ROSTERLAKE_DRIVER_MEMORY" in os.environ:
        b = b.config("spark.driver.memory", os.environ["ROSTERLAKE_DRIVER_MEMORY"])
    for k, v in {**SETTINGS, **(extra or {})}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder the cluster names in
    ``spark.checkpoint.dir``. A local session without one gets a private
    scratch folder; anywhere else that is an error, since executors would each
    write to a disk of their own."""
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect: no SparkContext on the client
        sc = None
    current = spark.conf.get("spark.checkpoint.dir", None) or (sc.getCheckpointDir() if sc else None)
    if not current:
        master = sc.master if sc is not None else "unknown"
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise RuntimeError(f"spark.checkpoint.dir is not set for master {master!r}: name a folder that all executors share")
        current = tempfile.mkdtemp(prefix="rosterlake-ckpt-")
        try:
            spark.conf.set("spark.checkpoint.dir", current)
        except Exception:  # core settings may be read-only at runtime
            pass
    if sc is not None and sc.getCheckpointDir() is None:
        sc.setCheckpointDir(current)
    return current


def write_once(df: DataFrame) -> DataFrame:
    """``df`` as a table below the shared checkpoint folder, for frames that
    a later plan names many times: each would compute it anew, while from the
    table each reads the columns it needs."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/rosterlake-kept/{uuid.uuid4().hex}"
    typed = [f.name for f in df.schema.fields if not isinstance(f.dataType, NullType)]  # parquet has no void
    held = df.select(*typed)
    held.write.parquet(path)
    back = spark.read.schema(held.schema).parquet(path)
    return back.select(*[F.col(c) if c in typed else F.lit(None).alias(c) for c in df.columns])


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (written to the shared checkpoint folder), so a
    lost executor re-reads the frame instead of recomputing a long plan and
    every later pass sees the same rows in the same partitions and order.
    The frame is persisted while the checkpoint is written, so the input is
    computed once rather than once for the action and once for the write."""
    ensure_checkpoint_dir(df.sparkSession)
    df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return df.checkpoint(eager=True)
    finally:
        df.unpersist()
