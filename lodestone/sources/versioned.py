"""A keyed table on shared storage that changes as a whole: readers see one version or the next, never a mixture."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKET = "_bucket"


class ConflictError(RuntimeError):
    """Another writer has committed the version that this one was about to make."""


class VersionedTable:
    """Rows in buckets by the hash of ``group``; a version names the folder of each bucket.

    A change rewrites the buckets that it touches, into a new folder, and
    commits by renaming a small file to the next version's name, which fails if
    that exists. So a writer that dies, or loses the race, leaves the table as
    it was, and old versions stay readable until ``vacuum``. The driver holds
    one path a bucket. The rename is atomic on HDFS and nearly so on a local
    disk; an object store would need a conditional put.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType, group: list[str], buckets: int = 64):
        self.spark, self.path, self.schema, self.group, self.buckets = spark, path.rstrip("/"), schema, group, buckets
        jvm = spark.sparkContext._jvm
        self._hadoop = jvm.org.apache.hadoop
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path("").getFileSystem(self._conf)

    def _path(self, name: str):
        return self._hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _names(self, folder: str) -> list[str]:
        at = self._path(folder)
        return [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def version(self) -> int:
        """Number of the last version; 0 if there is none."""
        return max((int(n) for n in self._names("versions") if n.isdigit()), default=0)

    def _folders(self, version: int) -> dict[str, str]:
        if version == 0:
            return {}
        stream = self._fs.open(self._path(f"versions/{version:012d}"))
        try:
            return json.loads(stream.readUTF())
        finally:
            stream.close()

    def _commit(self, folders: dict[str, str], base: int) -> int:
        self._fs.mkdirs(self._path("versions"))
        aside, target = self._path(f"versions/_{uuid.uuid4().hex}"), self._path(f"versions/{base + 1:012d}")
        stream = self._fs.create(aside, False)
        stream.writeUTF(json.dumps(folders))
        stream.close()
        options = self.spark.sparkContext._gateway.new_array(self._hadoop.fs.Options.Rename, 1)
        options[0] = self._hadoop.fs.Options.Rename.NONE
        try:
            self._hadoop.fs.FileContext.getFileContext(aside.toUri(), self._conf).rename(aside, target, options)
        except Exception as error:
            self._fs.delete(aside, False)
            if self._fs.exists(target):
                raise ConflictError(f"version {base + 1} has been committed by another writer") from error
            raise
        return base + 1

    def _read(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/data/{f}" for f in folders))

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the last by default."""
        return self._read(sorted(set(self._folders(self.version() if version is None else version).values())))

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.group), F.lit(self.buckets)).cast("int")

    def replace(self, groups: DataFrame, rows: DataFrame, base: int | None = None) -> int:
        """Put ``rows`` in the place of all rows of ``groups``; other groups stay. Returns the version made.

        base: the version that ``rows`` were derived from; a later one is a conflict.
        """
        base = self.version() if base is None else base
        folders = self._folders(base)
        keys = groups.select(*self.group).distinct()
        touched = [str(r[0]) for r in keys.select(self._bucket()).unionByName(rows.select(self._bucket())).distinct().collect()]  # at most a number a bucket
        old = self._read([folders[b] for b in touched if b in folders])
        kept = old.join(keys, self.group, "left_anti").select(*self.schema.fieldNames())
        load = uuid.uuid4().hex
        fresh = kept.unionByName(rows.select(*self.schema.fieldNames())).withColumn(BUCKET, self._bucket())
        fresh.write.partitionBy(BUCKET).parquet(f"{self.path}/data/{load}")
        made = {n.split("=")[1]: f"{load}/{n}" for n in self._names(f"data/{load}") if "=" in n}
        return self._commit({**{b: f for b, f in folders.items() if b not in touched}, **made}, base)

    def upsert(self, rows: DataFrame) -> int:
        """Replace the groups of ``rows`` by them."""
        return self.replace(rows, rows)

    def delete(self, groups: DataFrame) -> int:
        return self.replace(groups, self.spark.createDataFrame([], self.schema))

    def vacuum(self) -> None:
        """Delete what the last version does not name. Only when no reader or writer is on an older one."""
        last = self.version()
        live = set(self._folders(last).values())
        for load in self._names("data"):
            inner = [f"{load}/{n}" for n in self._names(f"data/{load}") if "=" in n]
            for name in [f for f in inner if f not in live] if any(f in live for f in inner) else [load]:
                self._fs.delete(self._path(f"data/{name}"), True)
        for name in self._names("versions"):
            if name != f"{last:012d}":
                self._fs.delete(self._path(f"versions/{name}"), True)
