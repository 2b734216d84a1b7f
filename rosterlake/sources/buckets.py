"""S10 for small changes: relations in id buckets, changed bucket by bucket.

A relation is a parquet folder partitioned by ``bucket``, the least id that a
bucket can hold: ids are dense (M1), so ``width`` ids make one bucket of
bounded size, and a batch that touches k ids writes at most k buckets however
large the relation is. (``sinks.publish`` writes a changed relation whole, but
keeps every version as it was.)

Every bucket is a folder with a file, which costs the same however few rows it
holds. So ``width`` is the least: a relation whose ids would fill more than
``BUCKETS`` of that width gets wider ones, up to ``WIDTH`` ids (or to ``width``,
if that is more). The width of each relation is kept in the manifest.

A change is written in three steps. The ids it replaces and the rows that stand
for them go to ``_changes``, so the operator's plan runs once and before
anything is overwritten. The touched buckets are written there too, whole: what
they held less those ids, and the new rows. The manifest of the version, written
last, names them, and from then on they count: readers take the touched buckets
from there and all others from the relation. Then Spark's dynamic partition
overwrite copies them over the relation's, and a mark says so. A job that dies
before the manifest changed nothing; one that dies after it is completed by the
next change, as often as needed, since the copy depends on written files only. So
a change of several relations (M7, M18) shows whole or not at all.

An emptied bucket keeps one row that is not ``live``, so that the overwrite
replaces it. Frames of ``read_buckets`` are to be used before the next change: a
bucket's old files go. One writer at a time; ids are not null; folders below
``_changes`` of earlier versions may be deleted.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.changes import Delta
from .schema import SCHEMAS, Tables, conform
from .sinks import CLUSTER, MANIFEST, Manifest, committed_version, read_manifest

# Ids a bucket: some tens of MB of parquet, and 100,000 buckets at 10^11 rows.
WIDTH = 1 << 20
# Buckets that a relation may have before narrower ones than WIDTH are widened.
BUCKETS = 256


def _stored_schema(name: str) -> T.StructType:
    return T.StructType([*SCHEMAS[name].fields, T.StructField("live", T.BooleanType()), T.StructField("bucket", T.LongType())])


def _bucket(width: int) -> Column:
    return (F.col("id") - F.pmod("id", F.lit(width).cast("long"))).alias("bucket")


def _stored(df: DataFrame, name: str, width: int) -> DataFrame:
    return conform(df, SCHEMAS[name]).select("*", F.lit(True).alias("live"), _bucket(width))


def _write(df: DataFrame, path: str, name: str, replace: str = "static") -> None:
    """Write partitioned by bucket, clustered inside. ``replace``: ``static``
    replaces the folder, ``dynamic`` the buckets that ``df`` holds."""
    (df.sortWithinPartitions("bucket", *CLUSTER.get(name, ["id"])).write.mode("overwrite")
     .option("partitionOverwriteMode", replace).partitionBy("bucket").parquet(path))


def _gathered(df: DataFrame) -> DataFrame:
    """A bucket's rows together, so it is one file. AQE splits a partition that
    got too large (ids that repeat can make one) and joins small ones."""
    return df.hint("rebalance", F.col("bucket"))


def _load(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.schema(_stored_schema(name)).parquet(path)


def _within(buckets: Iterable[int]) -> Column:
    """A filter that prunes partitions."""
    listed = ", ".join(f"{b}L" for b in buckets)
    return F.expr(f"bucket in ({listed})") if listed else F.lit(False)


def _buckets_of(df: DataFrame) -> list[int]:
    """At most as many numbers as the relation has partitions, which the driver
    lists for any read of it."""
    return sorted(r[0] for r in df.select("bucket").distinct().collect())


def _commit(spark: SparkSession, root: str, m: Manifest, widths: Mapping[str, int]) -> None:
    rows = [("relation", n, list(m.folders.get(n, [])), m.high_water.get(n, 0)) for n in SCHEMAS]
    rows += [("writer", w, [], u) for w, u in m.writers.items()] + [("layout", n, [], w) for n, w in widths.items()]
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{root}/_manifest/v={m.version}")


def _widths(spark: SparkSession, root: str, version: int) -> dict[str, int]:
    layout = spark.read.schema(MANIFEST).parquet(f"{root}/_manifest/v={version}").filter("kind = 'layout'").collect()
    found = {r["name"]: r["number"] for r in layout}
    # Roots written before relations had widths of their own have one, named "width".
    return {name: found.get(name) or found["width"] for name in SCHEMAS}


def _fitting(width: int, ends: tuple[int, int] | None) -> int:
    """``width``, or more where ids from the least to the largest would fill
    more than BUCKETS of it."""
    span = ends[1] - ends[0] + 1 if ends else 0
    return max(width, min(WIDTH, -(-span // BUCKETS)))


def _mark(spark: SparkSession, root: str, version: int):
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/_applied/v={version}")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _pending(spark: SparkSession, root: str, m: Manifest) -> dict[str, str]:
    """Relation -> folder of buckets that the version has and the relation may
    not have yet."""
    fs, path = _mark(spark, root, m.version)
    return {} if fs.exists(path) else {n: folders[0] for n, folders in m.folders.items() if folders}


def _complete(spark: SparkSession, root: str, m: Manifest) -> None:
    for name, folder in _pending(spark, root, m).items():
        _write(_load(spark, folder, name), f"{root}/{name}", name, "dynamic")
    fs, path = _mark(spark, root, m.version)
    fs.mkdirs(path)


def _current(spark: SparkSession, root: str) -> Manifest:
    m = read_manifest(spark, root)
    if m is None:
        raise FileNotFoundError(f"no bucketed relations under {root}")
    return m


def _ends(frames: Mapping[str, DataFrame]) -> dict[str, tuple[int, int] | None]:
    """The least and the largest id of every frame, in one job."""
    each = [df.agg(F.min("id").cast("long").alias("low"), F.max("id").cast("long").alias("top")).select(F.lit(name).alias("name"), "low", "top")
            for name, df in frames.items()]
    found = reduce(DataFrame.unionByName, each).collect() if each else []
    return {r["name"]: None if r["top"] is None else (r["low"], r["top"]) for r in found}


def create_buckets(spark: SparkSession, root: str, tables: Tables, width: int = WIDTH) -> None:
    """Write every relation in buckets of ``width`` ids or more: version 0."""
    if width < 1:
        raise ValueError("width is at least 1")
    if committed_version(spark, root) is not None:
        raise FileExistsError(f"bucketed relations exist under {root}")
    ends = _ends(dict(tables.items()))
    widths = {name: _fitting(width, ends[name]) for name in SCHEMAS}
    for name, df in tables.items():
        _write(_gathered(_stored(df, name, widths[name])), f"{root}/{name}", name)
    high = {name: max(tables.floor(name), ends[name][1] if ends[name] else 0) for name in SCHEMAS}
    _commit(spark, root, Manifest(0, {}, high), widths)


def read_buckets(spark: SparkSession, root: str) -> Tables:
    """Every relation as of the last version, with its high-water marks."""
    m = _current(spark, root)
    pending = _pending(spark, root, m)
    out = {}
    for name, schema in SCHEMAS.items():
        df = _load(spark, f"{root}/{name}", name)
        if name in pending:
            fresh = _load(spark, pending[name], name)
            df = df.filter(~_within(_buckets_of(fresh))).unionByName(fresh)
        out[name] = conform(df.filter("live"), schema)
    return Tables(**out, high_water=m.high_water)


def published_unit(spark: SparkSession, root: str, writer: str) -> int:
    """The writer's last unit of work, -1 if it has none."""
    return _current(spark, root).writers.get(writer, -1)


def change_buckets(spark: SparkSession, root: str, deltas: Mapping[str, Delta], writer: str | None = None, unit: int = 0) -> int:
    """Commit the next version: all rows of a delta's ids are replaced by its
    rows. Returns the version's number. A unit of work at or before the
    writer's last is not written again. A batch that changes nothing gives a
    version without buckets."""
    m = _current(spark, root)
    _complete(spark, root, m)
    if writer is not None and unit <= m.writers.get(writer, -1):
        return m.version
    widths, attempt = _widths(spark, root, m.version), f"{root}/_changes/v={m.version + 1}-{uuid.uuid4().hex}"
    folders, written = {}, {}
    for name, delta in deltas.items():
        base, width = f"{attempt}/{name}", widths[name]
        _stored(delta.rows, name, width).write.parquet(f"{base}/rows")
        rows = _load(spark, f"{base}/rows", name)
        delta.ids.select("id").unionByName(rows.select("id")).distinct().select("id", _bucket(width)).write.parquet(f"{base}/ids")
        ids = spark.read.schema("id long, bucket long").parquet(f"{base}/ids")
        touched = _buckets_of(ids)
        if not touched:
            continue
        held = _load(spark, f"{root}/{name}", name).filter(_within(touched)).filter("live")
        marks = ids.select("bucket").distinct().select(
            *[F.lit(None).cast(f.dataType).alias(f.name) for f in SCHEMAS[name].fields], F.lit(False).alias("live"), "bucket")
        fresh = held.join(ids.select("id"), "id", "left_anti").unionByName(rows).unionByName(marks)
        _write(_gathered(fresh), f"{base}/buckets", name)
        folders[name], written[name] = [f"{base}/buckets"], rows
    high = dict(m.high_water) | {name: max(m.high_water.get(name, 0), ends[1]) for name, ends in _ends(written).items() if ends}
    writers = dict(m.writers) | ({writer: unit} if writer is not None else {})
    new = Manifest(m.version + 1, folders, high, writers)
    _commit(spark, root, new, widths)
    _complete(spark, root, new)
    return new.version
