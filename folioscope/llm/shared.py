"""Tables that one step writes and a later one reads, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of compressed files up to which a table is broadcast.
SMALL = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Only a local session without one gets a temporary folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="folioscope-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


class Scratch:
    """Intermediate tables of one run of an operator.

    ``keep(df)`` writes df as Parquet and returns it read back, so its lineage ends at files that survive a lost executor.
    ``drop(df)`` deletes the files of a table that nothing reads any more.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.paths = spark, f"{shared_dir(spark)}/folioscope-{name}-{uuid.uuid4().hex}", {}

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{len(self.paths)}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[len(self.paths)] = (out, path)
        return out

    def _files(self, path: str):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target, target.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def drop(self, *tables: DataFrame | None) -> None:
        for out, path in self.paths.values():
            if any(out is t for t in tables):
                target, files = self._files(path)
                files.delete(target, True)

    def drop_all_but(self, *tables: DataFrame | None) -> None:
        """Delete every table that the result does not read."""
        self.drop(*[out for out, _ in self.paths.values() if not any(out is t for t in tables)])

    def size(self, table: DataFrame) -> int:
        """The bytes of a kept table's files."""
        target, files = self._files(next(path for out, path in self.paths.values() if out is table))
        return files.getContentSummary(target).getLength()

    def hinted(self, table: DataFrame) -> DataFrame:
        """A kept table for the small side of a join: broadcast while its files are below SMALL, else joined by a shuffle."""
        if not any(out is table for out, _ in self.paths.values()):
            raise ValueError("only a kept table has a size")
        return F.broadcast(table) if self.size(table) < SMALL else table.hint("merge")


def fresh(columns: list[str], *names: str) -> list[str]:
    """Names that no column has, whatever the case: the given ones, with underscores behind them where they are taken."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def bound_batches(spark: SparkSession) -> None:
    """Limit the bytes of an Arrow batch where the session leaves it open, as a batch of long texts could fill an executor."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) in (None, str(2**63 - 1), str(2**31 - 1)):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
