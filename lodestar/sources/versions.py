"""A table with versions: upserts, replaced children and appends as new files, made visible in one step.

Rows are dealt to buckets by a hash of some columns, and each change writes the
buckets that it touches anew, or adds a file to them; the files of others stay
where they are. A version is a manifest that lists every bucket's folders. It
is written under another name and renamed to the version's number, which fails
if the number is taken: of two writers that start from one version the second
gets a `Conflict`, and until the rename readers see the old version, whatever
has been written. A file system must refuse such a rename, as distributed ones
and local disks do; stores without one need a committer of their own.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from lodestar.operators.gold import insert_new, replace_children, upsert
from lodestar.session import cut_lineage, delete

#: Buckets of a table, and versions that stay readable after `vacuum`.
BUCKETS, KEPT = 16, 2


class Conflict(RuntimeError):
    """Another writer has made the version after the one that a change started from."""


class VersionedTable:
    """Rows of a folder, dealt by the columns by; keys tell rows apart and must contain by."""

    def __init__(self, spark: SparkSession, root: str, keys: list[str], by: list[str] | None = None, buckets: int = BUCKETS) -> None:
        self.spark, self.root, self.keys, self.by, self.buckets = spark, root.rstrip("/"), list(keys), list(by or keys), buckets
        if not set(self.by) <= set(self.keys):
            raise ValueError("rows are dealt by columns that belong to their key")

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _system(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        path = self._path(folder)
        return [s.getPath().getName() for s in self._system().listStatus(path)] if self._system().exists(path) else []

    def version(self) -> int:
        """The newest version; 0 before the first."""
        return max((int(n[1:-5]) for n in self._names("versions") if n.startswith("v") and n.endswith(".json")), default=0)

    def manifest(self, version: int | None = None) -> dict:
        """What a version lists: schema, folders of each bucket, and notes of its writer."""
        version = self.version() if version is None else version
        if not version:
            return {"schema": None, "buckets": {}, "notes": {}}
        stream = self._system().open(self._path(f"versions/v{version:012d}.json"))
        data = bytes(stream.readAllBytes())
        stream.close()
        return json.loads(data)

    def _rows(self, manifest: dict, buckets: list[int] | None = None) -> DataFrame:
        schema = T.StructType.fromJson(manifest["schema"])
        folders = [f"{self.root}/{f}" for b, listed in manifest["buckets"].items() for f in listed if buckets is None or int(b) in buckets]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the newest by default; later changes don't alter what was read."""
        manifest = self.manifest(version)
        if manifest["schema"] is None:
            raise ValueError("the table has no version yet")
        return self._rows(manifest)

    def _bucket(self):
        return F.pmod(F.xxhash64(*self.by), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame) -> dict[str, list[str]]:
        """Write rows by bucket to a new folder; the folders of the buckets that have some."""
        folder = f"data/{uuid.uuid4().hex}"
        # A bucket that has most rows, as of one parent, is written by several tasks.
        rows.withColumn("_bucket", self._bucket()).hint("rebalance", "_bucket").write.partitionBy("_bucket").parquet(f"{self.root}/{folder}")
        return {n.removeprefix("_bucket="): [f"{folder}/{n}"] for n in self._names(folder) if n.startswith("_bucket=")}

    def _commit(self, parent: int, schema: T.StructType, buckets: dict[str, list[str]], notes: dict) -> int:
        """Make a manifest the version after parent."""
        jvm, target = self.spark._jvm, self._path(f"versions/v{parent + 1:012d}.json")
        draft = self._path(f"drafts/{uuid.uuid4().hex}")
        self._system().mkdirs(target.getParent())
        out = self._system().create(draft, False)
        out.write(bytearray(json.dumps({"version": parent + 1, "schema": schema.jsonValue(), "buckets": buckets, "notes": notes}).encode()))
        out.close()
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            files.rename(draft, target, self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception as problem:
            self._system().delete(draft, False)
            if self._system().exists(target):
                raise Conflict(f"version {parent + 1} exists") from problem
            raise
        return parent + 1

    def _once(self, rows: DataFrame) -> DataFrame:
        """The rows, written, so that what is checked is what is stored; an error if a key is there twice."""
        kept = cut_lineage(rows)
        if kept.groupBy(*self.keys).count().where("count > 1").limit(1).count():
            raise ValueError("a key has more than one row")
        return kept

    def overwrite(self, rows: DataFrame, **notes: str) -> int:
        """All rows anew, in any schema; the new version."""
        parent, rows = self.version(), self._once(rows)
        return self._commit(parent, rows.schema, self._write(rows), notes)

    def _change(self, rows: DataFrame, change: Callable[[DataFrame, DataFrame], DataFrame], adds: bool, notes: dict) -> int:
        """A version in which the buckets of some rows are changed(stored, rows), or have it added; others stay as they are."""
        parent = self.version()
        manifest = self.manifest(parent)
        if manifest["schema"] is None:
            return self._commit(parent, rows.schema, self._write(rows), notes)
        schema = T.StructType.fromJson(manifest["schema"])
        # At most as many as the table has buckets.
        touched = [r[0] for r in rows.select(self._bucket().alias("b")).distinct().collect()]
        made = self._write(change(self._rows(manifest, touched), rows.select(*schema.names)).select(*schema.names))
        buckets = dict(manifest["buckets"])
        for b in map(str, touched):
            stored = buckets.pop(b, [])
            kept = stored if adds else []
            if kept + made.get(b, []):
                buckets[b] = kept + made.get(b, [])
        return self._commit(parent, schema, buckets, notes)

    def upsert(self, rows: DataFrame, keep_if_empty: list[str] = (), **notes: str) -> int:
        """Rows in the place of those with their keys; columns of keep_if_empty keep what is stored where the new value is null or {}."""
        return self._change(self._once(rows), lambda stored, new: upsert(stored, new, self.keys, list(keep_if_empty)), False, notes)

    def append(self, rows: DataFrame, *order: str, **notes: str) -> int:
        """Rows whose key isn't stored, each key once (the first by an order); stored rows stay, so coming again is no error."""
        return self._change(cut_lineage(rows), lambda stored, new: insert_new(stored, new, self.keys, *order), True, notes)

    def replace_children(self, rows: DataFrame, **notes: str) -> int:
        """Rows in the place of all that share their parent, the column that rows are dealt by."""
        if len(self.by) != 1:
            raise ValueError("children are dealt by their parent")
        return self._change(self._once(rows), lambda stored, new: replace_children(stored, new.select(*stored.columns), self.by[0]), False, notes)

    def update(self, change: Callable[[DataFrame], DataFrame], **notes: str) -> int:
        """All rows through a function, as a new version; a conflict if another writer was faster."""
        parent = self.version()
        rows = self._once(change(self._rows(self.manifest(parent))))
        return self._commit(parent, rows.schema, self._write(rows), notes)

    def vacuum(self, keep: int = KEPT) -> int:
        """Delete manifests but the newest, and folders of data that none of those lists; how many folders. No writer may be at work."""
        newest = self.version()
        old = [v for v in (int(n[1:-5]) for n in self._names("versions")) if v <= newest - keep]
        listed = {f for v in range(max(1, newest - keep + 1), newest + 1) for folders in self.manifest(v)["buckets"].values() for f in folders}
        for v in old:
            self._system().delete(self._path(f"versions/v{v:012d}.json"), False)
        gone = 0
        for n in self._names("data"):
            held = [f"data/{n}/{m}" for m in self._names(f"data/{n}")]
            kept = [f for f in held if f in listed]
            for f in [f for f in held if f not in listed] if kept else [f"data/{n}"]:
                delete(self.spark, f"{self.root}/{f}")
                gone += 1
        return gone
