"""Publish relation states as versions.

A version is one manifest, a small parquet table under ``_manifest/v=<n>``:
for every relation the folders that hold its rows, the largest id ever given
(so the id of a deleted row is not given again), and for every writer its last
unit of work. Data goes to folders of its own that no version has named
before; the manifest is written last, in one job, so a multi-relation change
(M7 deletes bookings and a session; M18 cascades over four relations) shows as
a whole or not at all, and a crashed attempt neither blocks nor overwrites
anything. Relations that didn't change keep their folders; inserts add one.

Readers take the highest manifest that was written to its end. Only a folder
that does not exist means "nothing published": any other failure to read is
raised. One writer at a time. The root must be on shared storage (the same
kind of place ``spark.checkpoint.dir`` points to).
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .schema import SCHEMAS, Tables, conform

# Columns each relation is clustered by inside its files: the keys the
# reports filter or join on most.
CLUSTER = {"session": ["start_time"], "booking": ["session_id"], "progress": ["member_id"],
           "reviews": ["session_id"], "users": ["id"], "trainer": ["id"], "admin": ["id"]}
MANIFEST = "kind string, name string, folders array<string>, number long"
# A relation of more folders is written anew when rows are added.
MAX_FOLDERS = 64


def write_snapshot(df: DataFrame, path: str, sort_within: list[str] | None = None) -> str:
    """Write ``df`` as parquet to ``path`` (which must not exist yet).
    ``sort_within`` clusters rows inside each file so parquet min/max
    statistics can skip row groups on later filters."""
    out = df.sortWithinPartitions(*sort_within) if sort_within else df
    out.write.mode("errorifexists").parquet(path)
    return path


def write_tables(tables: Tables, path: str) -> str:
    """Plain snapshots of every relation, ``path/<relation>``."""
    for name, df in tables.items():
        write_snapshot(conform(df, SCHEMAS[name]), f"{path}/{name}", CLUSTER.get(name))
    return path


@dataclass(frozen=True)
class Manifest:
    version: int
    folders: Mapping[str, list[str]]
    high_water: Mapping[str, int]
    writers: Mapping[str, int] = field(default_factory=dict)


def committed_version(spark: SparkSession, root: str) -> int | None:
    """The highest version whose manifest was written to its end; None only
    if the manifest folder does not exist or holds none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/_manifest")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    found = []
    for status in fs.listStatus(path):
        m = re.fullmatch(r"v=(\d+)", status.getPath().getName())
        if m and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
            found.append(int(m[1]))
    return max(found, default=None)


def read_manifest(spark: SparkSession, root: str) -> Manifest | None:
    version = committed_version(spark, root)
    if version is None:
        return None
    rows = spark.read.schema(MANIFEST).parquet(f"{root}/_manifest/v={version}").collect()
    relations = [r for r in rows if r["kind"] == "relation"]
    if {r["name"] for r in relations} != set(SCHEMAS):
        raise ValueError(f"the manifest of version {version} under {root} is incomplete")
    return Manifest(version, {r["name"]: list(r["folders"]) for r in relations},
                    {r["name"]: r["number"] for r in relations}, {r["name"]: r["number"] for r in rows if r["kind"] == "writer"})


def _top(df: DataFrame) -> int:
    return int(df.agg(F.max("id")).first()[0] or 0)


def publish(spark: SparkSession, root: str, base: Tables | None = None, changed: Mapping[str, DataFrame] | None = None,
            added: Mapping[str, DataFrame] | None = None, writer: str | None = None, unit: int = 0) -> int:
    """Commit the next version and return its number.

    ``changed`` relations are replaced and ``added`` rows are appended; the
    first version needs ``base``, every relation. ``(writer, unit)`` names the
    unit of work: one at or before the writer's last is not published again
    (its version is returned).
    """
    now = read_manifest(spark, root)
    if now is not None and writer is not None and unit <= now.writers.get(writer, -1):
        return now.version
    changed = dict(changed or {})
    if now is None:
        if base is None:
            raise FileNotFoundError(f"nothing is published under {root}: the first version needs every relation")
        changed = dict(base.items()) | changed
    folders = dict(now.folders) if now else {}
    high = dict(now.high_water) if now else dict(base.high_water)
    fresh = uuid.uuid4().hex
    for name, df in changed.items():
        path = write_snapshot(conform(df, SCHEMAS[name]), f"{root}/{name}/{fresh}", CLUSTER.get(name))
        folders[name] = [path]
    for name, df in (added or {}).items():
        if len(folders[name]) >= MAX_FOLDERS:
            df = _read(spark, folders[name], name).unionByName(conform(df, SCHEMAS[name]))
            folders[name] = []
        path = write_snapshot(conform(df, SCHEMAS[name]), f"{root}/{name}/{fresh}-added", CLUSTER.get(name))
        folders[name] = [*folders[name], path]
    for name in {*changed, *(added or {})}:
        high[name] = max(high.get(name, 0), _top(_read(spark, folders[name][-1:], name)))
    version = now.version + 1 if now else 0
    writers = dict(now.writers) if now else {}
    if writer is not None:
        writers[writer] = unit
    rows = [("relation", n, folders[n], high.get(n, 0)) for n in SCHEMAS] + [("writer", w, [], u) for w, u in writers.items()]
    # What a crashed attempt left of this version's manifest was never read.
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{root}/_manifest/v={version}")
    return version


def _read(spark: SparkSession, folders: list[str], name: str) -> DataFrame:
    return conform(spark.read.schema(SCHEMAS[name]).parquet(*folders), SCHEMAS[name])


def read_published(spark: SparkSession, root: str) -> Tables:
    """Every relation as of the last version, with its high-water marks."""
    now = read_manifest(spark, root)
    if now is None:
        raise FileNotFoundError(f"no committed version under {root}")
    return Tables(**{n: _read(spark, now.folders[n], n) for n in SCHEMAS}, high_water=now.high_water)


def round_trip(spark: SparkSession, root: str, tables: Tables) -> Tables:
    """Publish the relations and read them back (S1 and S10 in one)."""
    publish(spark, root, tables)
    return read_published(spark, root)
