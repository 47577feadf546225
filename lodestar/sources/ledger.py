"""A ledger of addresses in buckets: what is known is looked up where it lies, only candidates move.

The ledger's rows are dealt by a hash of their address and sorted by it when
they are written, so a join by address needs neither an exchange of the ledger
nor, where every bucket has one file, a sort. Nothing of it comes to the
driver, and a lookup reads the column of addresses alone.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lodestar.session import BROADCAST_ROWS, exists, small

#: Buckets of a ledger; fixed when it is made.
BUCKETS = 64


class BucketedLedger:
    """Addresses (norm string) in a folder, with a catalog entry for this session; null addresses are never known."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS) -> None:
        self.spark, self.root, self.buckets, self.table = spark, root.rstrip("/"), buckets, f"ledger_{uuid.uuid4().hex}"
        layout = f"{self.root}/buckets-"
        if not exists(spark, self.root):
            spark._jvm.org.apache.hadoop.fs.Path(self.root).getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(spark._jvm.org.apache.hadoop.fs.Path(f"{layout}{buckets}"))
        elif not exists(spark, f"{layout}{buckets}"):
            raise ValueError(f"the ledger of {self.root} has another number of buckets")
        spark.sql(f"CREATE TABLE {self.table} (norm STRING) USING parquet CLUSTERED BY (norm) SORTED BY (norm) INTO {buckets} BUCKETS LOCATION '{layout}{buckets}'")

    def read(self) -> DataFrame:
        """All addresses, each once."""
        return self.spark.table(self.table)

    def append(self, rows: DataFrame) -> None:
        """Add the addresses of rows (norm) that aren't there yet.

        A run that failed leaves nothing, or can be run again: known ones are
        left out. Two writers at once may add an address twice, which no
        lookup tells from once.
        """
        found = self.fresh(rows.select("norm").where("norm is not null").distinct())
        # One task a bucket, so that a bucket gets one file a run.
        found.repartition(self.buckets, "norm").write.insertInto(self.table)
        self.spark.catalog.refreshTable(self.table)

    def known(self, candidates: DataFrame) -> DataFrame:
        """Addresses (norm), each once, of candidates that the ledger has; up to a bound candidates are broadcast, beyond it they are dealt to its buckets."""
        wanted = candidates.select("norm").where("norm is not null").distinct()
        return self.read().join(small(wanted, BROADCAST_ROWS), "norm", "left_semi").distinct()

    def fresh(self, candidates: DataFrame) -> DataFrame:
        """Candidates (norm, ...) whose address the ledger hasn't; only they are shuffled."""
        return candidates.join(self.read().hint("merge"), "norm", "left_anti").select(*candidates.columns)

    def compact(self, into: str) -> BucketedLedger:
        """The ledger written anew to a folder, one file a bucket and each address once; without moving rows between buckets."""
        made = BucketedLedger(self.spark, into, self.buckets)
        self.read().dropDuplicates(["norm"]).write.insertInto(made.table)
        self.spark.catalog.refreshTable(made.table)
        return made

    def close(self) -> None:
        """Forget the catalog entry; the files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
