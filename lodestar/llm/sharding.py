"""Shards by size-tiered compaction under a versioned manifest.

Arrivals are appended as runs: folders of small immutable Parquet files. Runs
whose files are of a like size on average are one tier; when a tier has FANOUT
runs, they are merged into one run with files that come near the target size.
A version of the store is a manifest that lists its runs; there are few of them
however many files they have, so neither manifest nor reader holds a list of
files. A manifest is written under another name and renamed to the next
version's, which fails if that version exists: readers see the old runs or the
new one, and of two writers that start from one version, one has to start
again. Old runs stay until vacuum().

Spark's own committer writes a run, so files of failed attempts don't come into
it, and its packing of small files into read partitions of bounded size decides
which files a merge puts together: one file a task, without a shuffle.
"""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from lodestar.llm.common import remove, scratch
from lodestar.llm.warc import qualified

#: Bytes of a full file, runs of a tier that are merged, and mean bytes of the files of the lowest tier.
TARGET_BYTES, FANOUT, BASE_BYTES = 128 << 20, 4, 1 << 20
#: Arrivals that `shard` splits its documents into.
ARRIVALS = 4
#: Bytes of a row group while writing, which bounds a task's memory.
GROUP_BYTES = 32 << 20


class Conflict(RuntimeError):
    """Another writer has committed the version that this one was to be."""


@dataclass(frozen=True)
class Run:
    """A folder of immutable files."""

    name: str
    files: int
    rows: int
    bytes: int


class ShardStore:
    """A folder of runs and their manifests."""

    def __init__(self, spark: SparkSession, root: str, target: int = TARGET_BYTES, fanout: int = FANOUT, base: int = BASE_BYTES) -> None:
        self.spark, self.root = spark, qualified(spark, root)
        self.target, self.fanout, self.base = target, fanout, base

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _system(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _folders(self, name: str) -> list[str]:
        path = self._path(name)
        found = self._system().listStatus(path) if self._system().exists(path) else []
        return sorted(s.getPath().getName() for s in found if s.isDirectory())

    def version(self) -> int:
        """The newest version; 0 before the first commit."""
        folder = self._path("_manifests")
        if not self._system().exists(folder):
            return 0
        names = [s.getPath().getName() for s in self._system().listStatus(folder)]
        return max((int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json")), default=0)

    def manifest(self, version: int | None = None) -> tuple[str | None, list[Run]]:
        """Schema (JSON) and runs of a version, the newest by default."""
        version = self.version() if version is None else version
        if not version:
            return None, []
        stream = self._system().open(self._path(f"_manifests/v{version:08d}.json"))
        data = bytes(stream.readAllBytes())
        stream.close()
        found = json.loads(data)
        return found["schema"], [Run(**r) for r in found["runs"]]

    def commit(self, parent: int, schema: str, runs: list[Run]) -> int:
        """Make the runs the version after parent; Conflict if there is one."""
        jvm, target = self.spark._jvm, self._path(f"_manifests/v{parent + 1:08d}.json")
        draft = self._path(f"_manifests/draft-{uuid.uuid4().hex}")
        out = self._system().create(draft, False)
        out.write(bytearray(json.dumps({"version": parent + 1, "schema": schema, "runs": [asdict(r) for r in runs]}).encode()))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(draft, target, self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception as problem:
            self._system().delete(draft, False)
            if self._system().exists(target):
                raise Conflict(f"version {parent + 1} exists") from problem
            raise
        return parent + 1

    def append(self, arrivals: DataFrame, parts: int = 1) -> int:
        """Add the rows as a run of small shards, or as so many arrivals of a run and a version each; the new version.

        The rows are read and written once; several arrivals take them in turn.
        The first append sets the columns; others must have the same.
        """
        parent = self.version()
        schema, runs = self.manifest(parent)
        mine = T.StructType([T.StructField(f.name, f.dataType) for f in arrivals.schema]).json()
        if schema is not None and schema != mine:
            raise ValueError("the arrivals have other columns than the store")
        folder, turn = f"a-{uuid.uuid4().hex}", f"arrival_{uuid.uuid4().hex}"
        writer = self._written(arrivals if parts == 1 else arrivals.withColumn(turn, F.pmod(F.monotonically_increasing_id(), F.lit(parts))))
        (writer if parts == 1 else writer.partitionBy(turn)).parquet(f"{self.root}/data/{folder}")
        for name in [folder] if parts == 1 else [f"{folder}/{p}" for p in self._folders(f"data/{folder}")]:
            runs = [*runs, self._run(name, arrivals.schema)]
            parent = self.commit(parent, mine, runs)
        return parent if parts == 1 or parent else self.commit(parent, mine, runs)

    def _written(self, rows: DataFrame):
        return rows.write.option("compression", "zstd").option("parquet.block.size", GROUP_BYTES)

    def _run(self, name: str, schema: T.StructType) -> Run:
        """What the files of a folder hold."""
        files = self.spark.read.schema(schema).parquet(f"{self.root}/data/{name}")
        per_file = files.groupBy(F.col("_metadata.file_path")).agg(F.count("*").alias("n"), F.first("_metadata.file_size").alias("size"))
        found = per_file.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("size"), F.lit(0))).first()
        return Run(name, *found)

    def tier(self, run: Run) -> int:
        """The tier of a run by the mean size of its files; with half the target or more it is full and belongs to none (-1)."""
        mean = run.bytes / max(1, run.files)
        return -1 if 2 * mean >= self.target else int(math.log(max(mean, self.base) / self.base, self.fanout) + 1e-9)

    def due(self, runs: list[Run]) -> list[Run]:
        """The runs to merge now: those of the lowest tier that has FANOUT of them and two files or more."""
        by_tier: dict[int, list[Run]] = {}
        for run in runs:
            by_tier.setdefault(self.tier(run), []).append(run)
        for level in sorted(by_tier):
            if level >= 0 and len(by_tier[level]) >= self.fanout:
                return by_tier[level]
        return []

    def compact(self) -> int:
        """Merge until no tier is due; the new version."""
        version = self.version()
        schema, runs = self.manifest(version)
        while due := self.due(runs):
            runs = [r for r in runs if r not in due] + [self._merge(due, T.StructType.fromJson(json.loads(schema)))]
            version = self.commit(version, schema, runs)
        return version

    def _merge(self, due: list[Run], schema: T.StructType) -> Run:
        """The rows of some runs as one run with files near the target size."""
        # A session of its own has the settings by which Spark packs files into partitions, a file each.
        session = self.spark.newSession()
        for name, value in {"maxPartitionBytes": self.target, "openCostInBytes": 0, "minPartitionNum": 1}.items():
            session.conf.set(f"spark.sql.files.{name}", str(value))
        name = f"m-{uuid.uuid4().hex}"
        self._written(session.read.schema(schema).parquet(*[f"{self.root}/data/{r.name}" for r in due])).parquet(f"{self.root}/data/{name}")
        merged = self._run(name, schema)
        if merged.rows != sum(r.rows for r in due):
            raise RuntimeError(f"{name} has {merged.rows} rows of {sum(r.rows for r in due)}")
        return merged

    def vacuum(self) -> int:
        """Delete folders and manifests that the newest version does not need; how many."""
        version = self.version()
        listed, gone = {r.name for r in self.manifest(version)[1]}, 0
        for folder in self._folders("data"):
            inside = self._folders(f"data/{folder}")
            stale = [n for n in ([f"{folder}/{p}" for p in inside] or [folder]) if n not in listed]
            if len(stale) == max(1, len(inside)):
                stale = [folder]
            for name in stale:
                gone += bool(self._system().delete(self._path(f"data/{name}"), True))
        for old in range(1, version):
            gone += bool(self._system().delete(self._path(f"_manifests/v{old:08d}.json"), False))
        return gone

    def read(self, version: int | None = None) -> DataFrame:
        """Rows of a version with its columns, shard (file name), shard_bytes and version.

        Columns of the store with those three names are left out.
        """
        version = self.version() if version is None else version
        schema, runs = self.manifest(version)
        columns = T.StructType.fromJson(json.loads(schema)) if schema else T.StructType()
        if any(r.files for r in runs):
            rows = self.spark.read.schema(columns).parquet(*[f"{self.root}/data/{r.name}" for r in runs])
            own = [F.element_at(F.split("_metadata.file_path", "/"), -1).alias("shard"), F.col("_metadata.file_size").alias("shard_bytes")]
        else:
            rows, own = self.spark.createDataFrame([], columns), [F.lit("").alias("shard"), F.lit(0).cast("long").alias("shard_bytes")]
        kept = [F.col(f"`{c}`") for c in columns.names if c not in ("shard", "shard_bytes", "version")]
        return rows.select(*kept, *own, F.lit(version).alias("version"))


def shard(docs: DataFrame, arrivals: int = ARRIVALS, target: int = TARGET_BYTES, fanout: int = FANOUT) -> DataFrame:
    """The documents after appending them in arrivals, compaction and vacuum, with their shard.

    Columns are those of the documents with shard, shard_bytes and version,
    which replace columns of those names. Every row comes back, repeated rows
    and nulls included; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    store = ShardStore(spark, scratch(spark, "shards"), target, fanout)
    store.append(docs, arrivals)
    store.compact()
    store.vacuum()
    return store.read()


def drop_store(spark: SparkSession, root: str) -> None:
    """Delete a store with all its versions."""
    remove(spark, root)
