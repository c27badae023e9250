"""Size-tiered compaction of immutable shards, in DataFrame functions.

A dataset is a folder of runs, each a folder of Parquet shards that never
change, and of manifests. A manifest is a table of the live shards with run,
tier, shard, bytes, rows, and the number of arrivals merged into the run; it is
made by Spark from the files' own metadata. A version is a small pointer file
that names its manifest. It is written aside and then renamed to its number
without overwriting, which fails if another writer has taken the number, so no
commit is lost and readers never see half of one. The rename is as atomic as
the file system makes it: on HDFS wholly, on a local disk but for an instant.

``append`` writes one run of small shards an arrival. ``compact`` merges, tier
by tier, the runs of similar size once there are ``fanout`` of them, into one
run of files of about ``target_bytes``: the files are read in place and packed
without a shuffle. A run's tier is the whole logarithm, to base ``fanout``, of
its bytes over the smallest arrival's unit. ``read`` reads the listed shards
and nothing else that lies in the folders. The driver holds one path a shard,
as Spark's own file index does.

Nulls and edges: rows are stored as they are, nulls, repeats, long texts, ties
and all; an empty arrival is a run without shards, which no manifest lists;
compacting an empty or compacted dataset changes nothing; one text longer than
the target is a file of its own; only the schema's columns are stored, under
whatever names, and working columns take names that are not among them.
"""

from __future__ import annotations

import math
import uuid

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "run string, tier int, shard string, bytes long, rows long, arrivals int"


class ConflictError(RuntimeError):
    """Another writer has committed the version."""


class Dataset:
    """A compacted dataset below ``path``."""

    def __init__(self, spark: SparkSession, path: str, schema, target_bytes: int = 128 << 20, fanout: int = 4, unit_bytes: int = 1 << 20):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self.target_bytes, self.fanout, self.unit_bytes = target_bytes, fanout, unit_bytes
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self._at("").getFileSystem(self._conf)

    def _at(self, name: str):
        return self._hadoop.fs.Path(f"{self.path}/{name}".rstrip("/"))

    def _names(self, folder: str) -> list[str]:
        at = self._at(folder)
        return [s.getPath().getName() for s in self.fs.listStatus(at)] if self.fs.exists(at) else []

    def version(self) -> int:
        """Number of the last version; 0 if there is none."""
        return max((int(n) for n in self._names("versions") if n.isdigit()), default=0)

    def _pointer(self, version: int) -> str:
        stream = self.fs.open(self._at(f"versions/{version:012d}"))
        try:
            return stream.readUTF()
        finally:
            stream.close()

    def manifest(self, version: int | None = None) -> DataFrame:
        version = self.version() if version is None else version
        if version == 0:
            return self.spark.range(0).select(*(F.lit(None).cast(f.split()[1]).alias(f.split()[0]) for f in MANIFEST.split(", ")))
        return self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifests/{self._pointer(version)}")

    def runs(self, version: int | None = None) -> list:
        """One row a live run: its tier, bytes, rows, shards and arrivals."""
        totals = [F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"), F.count("*").alias("shards"), F.max("arrivals").alias("arrivals")]
        return self.manifest(version).groupBy("run", "tier").agg(*totals).orderBy("run").collect()

    def _listed(self, run: Column, folder: str, arrivals: int, least_tier: int = 0) -> DataFrame:
        """Manifest rows of what has just been written to ``folder``; run: each row's run, from its file's path."""
        facts = ["_metadata.file_path", "_metadata.file_name", "_metadata.file_size"]
        try:
            files = self.spark.read.option("recursiveFileLookup", "true").schema(self.schema).parquet(f"{self.path}/runs/{folder}").select(*facts)
        except PySparkException:
            if self._names(f"runs/{folder}"):
                raise
            return self.manifest(0)
        shards = files.groupBy("file_path", F.col("file_name").alias("shard"), F.col("file_size").alias("bytes")).agg(F.count("*").alias("rows")).withColumn("run", run)
        sizes = shards.groupBy("run").agg(F.sum("bytes").alias("total"))
        tier = F.greatest(F.floor(F.log(float(self.fanout), F.greatest(F.col("total") / self.unit_bytes, F.lit(1.0)))), F.lit(least_tier)).cast("int")
        return shards.join(sizes, "run").select("run", tier.alias("tier"), "shard", "bytes", "rows", F.lit(arrivals).alias("arrivals"))

    def _commit(self, rows: DataFrame, base: int) -> int:
        """Make ``rows`` version base + 1, or raise ``ConflictError`` if that number is taken."""
        name = uuid.uuid4().hex
        rows.write.parquet(f"{self.path}/manifests/{name}")
        self.fs.mkdirs(self._at("versions"))
        aside, target = self._at(f"versions/_{name}"), self._at(f"versions/{base + 1:012d}")
        stream = self.fs.create(aside, False)
        stream.writeUTF(name)
        stream.close()
        options = self.spark.sparkContext._gateway.new_array(self._hadoop.fs.Options.Rename, 1)
        options[0] = self._hadoop.fs.Options.Rename.NONE
        try:
            self._hadoop.fs.FileContext.getFileContext(aside.toUri(), self._conf).rename(aside, target, options)
        except Exception as error:
            self.fs.delete(aside, False)
            self.fs.delete(self._at(f"manifests/{name}"), True)
            if self.fs.exists(target):
                raise ConflictError(f"version {base + 1} has been committed by another writer") from error
            raise
        return base + 1

    def append(self, arrivals: list[DataFrame]) -> int:
        """Write each arrival as a run of its own, then commit them together."""
        base = self.version()
        rows = self.manifest(base)
        for arrival in arrivals:
            run = uuid.uuid4().hex
            arrival.select(*self.schema.fieldNames()).write.parquet(f"{self.path}/runs/{run}")
            rows = rows.unionByName(self._listed(F.lit(run), run, 1))
        return self._commit(rows, base)

    def append_batches(self, df: DataFrame, batch: Column) -> int:
        """Write the rows of each value of ``batch`` (a whole number) as an arrival, in one pass without a shuffle."""
        base, load, name = self.version(), uuid.uuid4().hex, "batch"
        while name in {n.lower() for n in self.schema.fieldNames()}:
            name += "_"
        fields = [F.col(f"`{n}`") for n in self.schema.fieldNames()]
        df.select(*fields, batch.alias(name)).write.partitionBy(name).parquet(f"{self.path}/runs/{load}")
        run = F.concat(F.lit(f"{load}/"), F.regexp_extract("file_path", f"({name}=[^/]*)/[^/]*$", 1))
        return self._commit(self.manifest(base).unionByName(self._listed(run, load, 1)), base)

    def _shards(self, rows: DataFrame) -> list[str]:
        return [f"{self.path}/runs/{r['run']}/{r['shard']}" for r in rows.select("run", "shard").collect()]

    def compact(self) -> int:
        """Merge tiers until none has ``fanout`` runs; returns the last version."""
        while True:
            base, tiers = self.version(), {}
            for row in self.runs(base):
                tiers.setdefault(row["tier"], []).append(row)
            full = [t for t, runs in sorted(tiers.items()) if len(runs) >= self.fanout]
            if not full:
                return base
            merged = tiers[full[0]]
            names, total = [r["run"] for r in merged], sum(r["bytes"] for r in merged)
            run, live = uuid.uuid4().hex, self.manifest(base)
            source = self.spark.read.schema(self.schema).parquet(*self._shards(live.where(F.col("run").isin(names))))
            source.coalesce(max(1, math.ceil(total / self.target_bytes))).write.parquet(f"{self.path}/runs/{run}")
            fresh = self._listed(F.lit(run), run, sum(r["arrivals"] for r in merged), full[0] + 1)
            self._commit(live.where(~F.col("run").isin(names)).unionByName(fresh), base)

    def vacuum(self) -> None:
        """Delete what the last manifest does not list. Only when no reader or writer is on an older version."""
        last = self.version()
        live = {r["run"] for r in self.runs(last)}
        for load in self._names("runs"):
            inner = [n for n in self._names(f"runs/{load}") if "=" in n]
            if load in live or any(f"{load}/{n}" in live for n in inner):
                gone = [f"{load}/{n}" for n in inner if f"{load}/{n}" not in live]
            else:
                gone = [load]
            for name in gone:
                self.fs.delete(self._at(f"runs/{name}"), True)
        pointer = self._pointer(last) if last else None
        for folder, keep in (("versions", f"{last:012d}"), ("manifests", pointer)):
            for name in self._names(folder):
                if name != keep:
                    self.fs.delete(self._at(f"{folder}/{name}"), True)

    def read(self, version: int | None = None) -> DataFrame:
        """Rows of a version, as they were stored."""
        shards = self._shards(self.manifest(version))
        if not shards:
            return self.spark.range(0).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema.fields))
        return self.spark.read.schema(self.schema).parquet(*shards)
