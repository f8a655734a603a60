"""Tables that change in place: rows are dealt to folders by the hash of their key, and a load rewrites the folders of its keys alone."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.sources.store import upsert

#: The column that a table's folders are named by.
BUCKET = "bucket__"


class BucketedTable:
    """A Parquet table below ``path`` in ``buckets`` folders by the hash of ``keys``.

    A load finds the folders of its keys (at most ``buckets`` numbers, on the driver), reads these, and replaces them; files of all others keep
    their names. Keys may be null. One writer at a time: new files are staged, and moved when all tasks are done; a load that failed halfway is
    run again, as upserts and replacements give the same when repeated.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: Sequence[str], buckets: int = 64):
        if buckets < 1 or not keys:
            raise ValueError("a table needs keys and a bucket")
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), list(keys), buckets
        self.schema = spark.createDataFrame([], schema).schema
        if missing := set(self.keys) - set(self.schema.names):
            raise ValueError(f"the table has no {sorted(missing)}")

    def _file(self, name: str = ""):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(self.path + name)
        return target, target.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _dealt(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn(BUCKET, F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))

    def _stored(self) -> DataFrame:
        target, files = self._file()
        if not files.exists(target):
            return self._dealt(self.spark.createDataFrame([], self.schema))
        full = self.spark.createDataFrame([], self.schema).withColumn(BUCKET, F.lit(0)).schema
        return self.spark.read.schema(full).parquet(self.path)

    def read(self) -> DataFrame:
        """The table; a condition that fixes all keys reads one folder (see ``lookup``)."""
        return self._stored().drop(BUCKET)

    def lookup(self, *values) -> DataFrame:
        """The rows of one key, from its folder alone."""
        wanted = self._dealt(self.spark.createDataFrame([tuple(values)], ", ".join(f"{k} {self.schema[k].dataType.simpleString()}" for k in self.keys))).first()
        rows = self._stored().where(F.col(BUCKET) == wanted[BUCKET])
        for k in self.keys:
            rows = rows.where(F.col(k).eqNullSafe(F.lit(wanted[k])))
        return rows.drop(BUCKET)

    def _touched(self, rows: DataFrame) -> list[int]:
        return sorted(r[0] for r in self._dealt(rows.select(*self.keys)).select(BUCKET).distinct().collect())

    def _rewrite(self, rows: DataFrame, touched: list[int]) -> list[int]:
        """Puts ``rows``, which are all that the touched folders hold from now on, in the place of what is there."""
        rows = self._dealt(rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema.fields]))
        # A folder is written by one task unless it is large, so its files stay few.
        rows = rows.repartition(F.col(BUCKET)).write.partitionBy(BUCKET).option("partitionOverwriteMode", "dynamic")
        before = self._folders()
        rows.mode("overwrite").parquet(self.path)
        # A folder that no row is left for is not overwritten: its old files go by their names.
        kept = self._folders()
        for bucket in touched:
            if kept.get(bucket) and kept[bucket] == before.get(bucket):
                target, files = self._file(f"/{BUCKET}={bucket}")
                files.delete(target, True)
        return touched

    def _folders(self) -> dict[int, list[str]]:
        """The names of the files in each folder; at most ``buckets`` folders."""
        target, files = self._file()
        if not files.exists(target):
            return {}
        out = {}
        for folder in files.listStatus(target):
            name = folder.getPath().getName()
            if name.startswith(f"{BUCKET}="):
                out[int(name.rpartition("=")[2])] = sorted(f.getPath().getName() for f in files.listStatus(folder.getPath()))
        return out

    def merge(self, new: DataFrame, keep: Sequence[str] = ()) -> list[int]:
        """Upserts new, which has one row for each key (see ``store.upsert``); returns the buckets that were rewritten."""
        if not (touched := self._touched(new)):
            return []
        old = self._stored().where(F.col(BUCKET).isin(touched)).drop(BUCKET)
        return self._rewrite(upsert(old, new, self.keys, keep), touched)

    def replace(self, new: DataFrame, parents: DataFrame | None = None) -> list[int]:
        """Rows of the keys in new (or in ``parents``, where some have no rows now) go, and new's come; returns the buckets that were rewritten.

        The keys are the parent's, so all children of a parent lie in one folder.
        """
        loaded = (new if parents is None else parents).select(*self.keys).distinct()
        if parents is not None:
            condition = F.lit(True)
            for k in self.keys:
                condition = condition & F.col(f"n.{k}").eqNullSafe(F.col(f"p.{k}"))
            if new.alias("n").join(loaded.alias("p"), condition, "left_anti").limit(1).count():
                raise ValueError("new rows have parents that are not replaced")
        if not (touched := self._touched(loaded)):
            return []
        condition = F.lit(True)
        for k in self.keys:
            condition = condition & F.col(f"o.{k}").eqNullSafe(F.col(f"l.{k}"))
        old = self._stored().where(F.col(BUCKET).isin(touched)).drop(BUCKET)
        rest = old.alias("o").join(loaded.alias("l"), condition, "left_anti")
        return self._rewrite(rest.unionByName(new, allowMissingColumns=True), touched)

    def delete(self, keys: DataFrame) -> list[int]:
        """Rows of the given keys go; returns the buckets that were rewritten."""
        return self.replace(self.spark.createDataFrame([], self.schema), parents=keys)
