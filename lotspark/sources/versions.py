"""Tables that change by manifest: new files lie beside the old ones until one renamed file names them.

A table's folder holds data folders and numbered manifests. A writer first writes its
data, then a manifest under a temporary name, then renames it to the next number;
that rename, which fails if the number is taken, is the only step that readers see.
A job that stops anywhere before it leaves the old table as it was. ``sweep``
deletes what no manifest names.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.upkeep import latest, upsert

PREFIX = "manifest-"


class Conflict(RuntimeError):
    """Somebody else has committed meanwhile."""


def _fs(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def _numbers(spark: SparkSession, path: str) -> list[int]:
    place, fs = _fs(spark, path)
    if not fs.exists(place):
        return []
    names = (s.getPath().getName() for s in fs.listStatus(place))
    return sorted(int(n.removeprefix(PREFIX).removesuffix(".json")) for n in names if n.startswith(PREFIX) and n.endswith(".json"))


def _manifest(spark: SparkSession, path: str, number: int) -> dict:
    place, fs = _fs(spark, f"{path}/{PREFIX}{number:09d}.json")
    stream = fs.open(place)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def current(spark: SparkSession, path: str) -> tuple[int, dict]:
    """Number and manifest of the newest version; 0 and nothing before the first."""
    numbers = _numbers(spark, path)
    return (numbers[-1], _manifest(spark, path, numbers[-1])) if numbers else (0, {})


def commit(spark: SparkSession, path: str, manifest: dict, after: int) -> int:
    """Make ``manifest`` the version after number ``after``; ``Conflict`` if that one isn't the newest any more."""
    jvm = spark._jvm
    staged, fs = _fs(spark, f"{path}/.{uuid.uuid4().hex}.tmp")
    stream = fs.create(staged, False)
    stream.write(bytearray(json.dumps(manifest).encode()))
    stream.close()
    target = jvm.org.apache.hadoop.fs.Path(f"{path}/{PREFIX}{after + 1:09d}.json")
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(target).toUri(), spark._jsc.hadoopConfiguration())
    none = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        if after != current(spark, path)[0]:
            raise Conflict(f"{path} has moved on from version {after}")
        context.rename(fs.makeQualified(staged), fs.makeQualified(target), none)  # never overwrites
    except Conflict:
        fs.delete(staged, False)
        raise
    except Exception as error:
        fs.delete(staged, False)
        if "FileAlreadyExists" in str(error):
            raise Conflict(f"{path} has moved on from version {after}") from error
        raise
    return after + 1


def sweep(spark: SparkSession, path: str, keep: int = 1) -> None:
    """Delete older manifests than the newest ``keep``, and data that none of those names: also that of writers that stopped.

    Not while a writer is at work: its data isn't named yet.
    """
    numbers = _numbers(spark, path)
    place, fs = _fs(spark, path)
    named = {folder for n in numbers[-keep:] for folder in _manifest(spark, path, n)["folders"].values()}
    roots = {f.split("/")[0] for f in named}
    for status in fs.listStatus(place) if numbers else []:
        name = status.getPath().getName()
        if name.startswith(PREFIX):
            old = int(name.removeprefix(PREFIX).removesuffix(".json")) not in numbers[-keep:]
        elif name not in roots:
            old = True
        else:  # buckets of a version that later ones have replaced
            old = False
            for inner in fs.listStatus(status.getPath()):
                if inner.isDirectory() and f"{name}/{inner.getPath().getName()}" not in named and name not in named:
                    fs.delete(inner.getPath(), True)
        if old:
            fs.delete(status.getPath(), True)


def replace(df: DataFrame, path: str, kind: str = "parquet") -> int:
    """``df`` becomes the table's only content. It may read the table itself."""
    spark = df.sparkSession
    after, _ = current(spark, path)
    folder = f"v-{uuid.uuid4().hex}"
    df.write.format(kind).save(f"{path}/{folder}")
    return commit(spark, path, {"kind": kind, "folders": {"all": folder}}, after)


def read(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """The newest version of a table that ``replace`` has written."""
    number, manifest = current(spark, path)
    if not number:
        raise FileNotFoundError(path)
    reader = spark.read.format(manifest["kind"])
    return (reader.schema(schema) if schema else reader).load(f"{path}/{manifest['folders']['all']}")


class KeyedTable:
    """A table with one row a key, in buckets of the key's hash; an upsert rewrites the buckets that its keys fall in.

    The number of buckets bounds the manifest and what comes to the driver; choose it
    so that a bucket is a file of some hundred megabytes.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, schema: str, buckets: int):
        self.spark, self.path, self.key, self.schema, self.buckets = spark, path, key, schema, buckets

    def _bucket(self) -> Column:
        return F.pmod(F.hash(F.col(self.key)), F.lit(self.buckets))

    def _folders(self) -> tuple[int, dict[str, str]]:
        number, manifest = current(self.spark, self.path)
        if number and (manifest["key"], manifest["buckets"]) != (self.key, self.buckets):
            raise ValueError(f"{self.path} is keyed by {manifest['key']} in {manifest['buckets']} buckets")
        return number, manifest.get("folders", {})

    def _load(self, folders: list[str]) -> DataFrame:
        reader = self.spark.read.schema(self.schema)
        return reader.parquet(*(f"{self.path}/{f}" for f in folders)) if folders else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        return self._load(sorted(self._folders()[1].values()))

    def upsert(self, changes: DataFrame, order: str | None = None, keep: tuple[str, ...] = ()) -> list[int]:
        """Rows of ``changes`` replace or join those of their keys; buckets rewritten.

        With ``order`` the last version of each key counts and one that isn't newer
        than the table's is dropped, so a batch that runs again changes nothing;
        without it ``changes`` has one row a key. Columns in ``keep`` stay as they are
        where the key existed.
        """
        new = (latest(changes, self.key, order) if order else changes).select(*self._columns())
        number, folders = self._folders()
        touched = sorted(r[0] for r in new.select(self._bucket().alias("b")).distinct().collect())
        if not touched:
            return []
        old = self._load([folders[str(b)] for b in touched if str(b) in folders])
        if order:
            seen = old.select(F.col(self.key).alias("_key"), F.col(order).alias("_seen"))
            new = new.join(seen, F.col(self.key) == F.col("_key"), "left").where(F.col("_seen").isNull() | (F.col(order) > F.col("_seen"))).select(*self._columns())
        merged = upsert(old, new, self.key, keep).select(*self._columns())
        version = f"v-{uuid.uuid4().hex}"
        merged.withColumn("_bucket", self._bucket()).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{version}")
        fresh = {str(b): f"{version}/_bucket={b}" for b in touched}
        commit(self.spark, self.path, {"key": self.key, "buckets": self.buckets, "folders": folders | fresh}, number)
        return touched

    def _columns(self) -> list[str]:
        return self.spark.createDataFrame([], self.schema).columns
