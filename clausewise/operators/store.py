"""A chunk index on disk in buckets of ids, of which changes rewrite only those that they touch.

``path/data/<change>/bucket=<n>`` are Parquet folders that never change, and
``path/versions/<number>.json`` names the folder of each bucket.  A change writes
new folders for the buckets that it touches, then the next version's file under
another name, and renames it: readers see the version before or after, and a
change that fails midway leaves folders that no version names.  One writer at a
time; where the file system's rename refuses an existing name a second one fails.

An incoming batch without rows makes no version.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from clausewise.operators import index as changes
from clausewise.session import delete as delete_folder


@dataclass
class Version:
    """What a version's file says: folders by bucket (buckets without rows have none), and the next free place."""

    number: int
    buckets: int
    schema: str
    next_pos: int = 0
    folders: dict[str, str] = field(default_factory=dict)


def _path(spark: SparkSession, path: str):
    """The path and its file system, any that Spark knows."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def versions(spark: SparkSession, path: str) -> list[int]:
    folder, files = _path(spark, f"{path}/versions")
    if not files.exists(folder):
        return []
    names = [s.getPath().getName() for s in files.listStatus(folder)]
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def version(spark: SparkSession, path: str, number: int | None = None) -> Version:
    """One version, or the newest."""
    if number is None:
        known = versions(spark, path)
        if not known:
            raise FileNotFoundError(f"no index in {path}")
        number = known[-1]
    return Version(**json.loads(spark.read.text(f"{path}/versions/{number:09d}.json", wholetext=True).first().value))


def _publish(spark: SparkSession, path: str, new: Version) -> Version:
    hidden, files = _path(spark, f"{path}/versions/_{uuid.uuid4().hex}")
    final, _ = _path(spark, f"{path}/versions/{new.number:09d}.json")
    out = files.create(hidden, True)
    out.write(bytearray(json.dumps(new.__dict__).encode()))
    out.close()
    if files.exists(final) or not files.rename(hidden, final):
        files.delete(hidden, False)
        raise RuntimeError(f"version {new.number} of {path} was written by another change")
    return new


def bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int")


def _write(rows: DataFrame, path: str, buckets: int) -> dict[str, str]:
    """Writes rows by bucket, within one by regulation so that row groups can be skipped; returns the new folders by bucket."""
    spark, folder = rows.sparkSession, f"data/{uuid.uuid4().hex}"
    placed = rows.withColumn("bucket", bucket(buckets)).repartition("bucket")
    order = [c for c in ("bucket", "regulation", "pos") if c in placed.columns]
    placed.sortWithinPartitions(*order).write.partitionBy("bucket").parquet(f"{path}/{folder}")
    target, files = _path(spark, f"{path}/{folder}")
    names = [s.getPath().getName() for s in files.listStatus(target)]
    return {n.removeprefix("bucket="): f"{folder}/{n}" for n in names if n.startswith("bucket=")}


def _read(spark: SparkSession, path: str, at: Version, wanted: set[str] | None = None) -> DataFrame:
    schema = StructType.fromJson(json.loads(at.schema))
    folders = [f"{path}/{f}" for b, f in at.folders.items() if wanted is None or b in wanted]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def create(rows: DataFrame, path: str, buckets: int = 64) -> Version:
    """Stores an index (``id``, ``pos`` and any more columns, each id once) as version 0.

    Buckets hold equal shares of the ids; choose their number so that one has some
    hundred megabytes.
    """
    spark = rows.sparkSession
    if versions(spark, path):
        raise FileExistsError(f"an index is in {path}")
    new = Version(0, buckets, rows.schema.json(), 0, _write(rows, path, buckets))
    new.next_pos = _next_pos(_read(spark, path, new), 0)
    return _publish(spark, path, new)


def open_store(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    """The index as of a version, or of the newest one."""
    return _read(spark, path, version(spark, path, number))


def _next_pos(rows: DataFrame, least: int) -> int:
    return max(least, (rows.agg(F.max("pos")).first()[0] or -1) + 1)


def _touched(rows: DataFrame, buckets: int) -> set[str]:
    """Buckets of these rows: at most as many values as there are buckets reach the driver."""
    return {str(r[0]) for r in rows.select(bucket(buckets)).distinct().collect()}


def _replace(spark: SparkSession, path: str, old: Version, touched: set[str], rows: DataFrame) -> Version:
    made = _write(rows, path, old.buckets)
    folders = {b: f for b, f in old.folders.items() if b not in touched} | made
    new = Version(old.number + 1, old.buckets, old.schema, old.next_pos, folders)
    new.next_pos = _next_pos(_read(spark, path, new, set(made)), old.next_pos)
    return _publish(spark, path, new)


def merge(path: str, incoming: DataFrame, seq: str = "pos") -> Version:
    """``index.upsert`` that reads and writes only the buckets that ``incoming`` has ids of."""
    spark = incoming.sparkSession
    old = version(spark, path)
    touched = _touched(incoming, old.buckets)
    if not touched:
        return old
    rows = changes.upsert(_read(spark, path, old, touched), incoming, seq, old.next_pos)
    return _replace(spark, path, old, touched, rows)


def remove(spark: SparkSession, path: str, kept) -> Version:
    """Deletes rows: ``kept`` takes a DataFrame and returns what stays of it, such as ``index.delete_statute``.

    Which buckets lose rows is found by counting, a number for each bucket; the others keep their files.
    """
    old = version(spark, path)
    rows = _read(spark, path, old)
    count = lambda df, name: df.groupBy(bucket(old.buckets).alias("b")).agg(F.count("*").alias(name))
    before = count(rows, "n").join(count(kept(rows), "m"), "b", "left")
    touched = {str(r.b) for r in before.where("n > coalesce(m, 0)").select("b").collect()}
    return _replace(spark, path, old, touched, kept(_read(spark, path, old, touched))) if touched else old


def vacuum(spark: SparkSession, path: str, last: int = 1) -> None:
    """Deletes all versions but the ``last`` ones, and folders that none of these names. Not while a change is running."""
    known = versions(spark, path)
    left = known[-max(last, 1) :]
    named = {f for n in left for f in version(spark, path, n).folders.values()}
    for n in known[: -len(left)]:
        delete_folder(spark, f"{path}/versions/{n:09d}.json")
    folder, files = _path(spark, f"{path}/data")
    for change in [s.getPath().getName() for s in files.listStatus(folder)]:
        inner, _ = _path(spark, f"{path}/data/{change}")
        if not any(f.startswith(f"data/{change}/") for f in named):
            delete_folder(spark, f"{path}/data/{change}")
            continue
        for name in [s.getPath().getName() for s in files.listStatus(inner)]:
            if name.startswith("bucket=") and f"data/{change}/{name}" not in named:
                delete_folder(spark, f"{path}/data/{change}/{name}")
