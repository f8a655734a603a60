"""Tables as Parquet in versioned folders: upserts, replaced children, append-only logs, copies with checks and exports."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """old with new's rows: a key of both takes new's values, but old's in the columns ``keep`` (ids, times of creation).

    new has one row for each key; columns that new lacks stay.
    """
    o, n = old.alias("o"), new.alias("n").withColumn("__new", F.lit(True))
    on = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]
    condition = on[0]
    for more in on[1:]:
        condition = condition & more
    both = o.withColumn("__old", F.lit(True)).alias("o").join(n.alias("n"), condition, "full_outer")

    def value(c: str) -> Column:
        if c not in new.columns:
            return F.col(f"o.{c}")
        if c in keep:
            return F.when(F.col("o.__old"), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}"))
        return F.when(F.col("n.__new"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))

    return both.select(*[value(c).alias(c) for c in old.columns])


def stable_id(*keys: str) -> Column:
    """An id that follows from the key, so that a repeated load gives the same."""
    return F.xxhash64(*keys)


def replace_children(old: DataFrame, new: DataFrame, key: str, parents: DataFrame | None = None) -> DataFrame:
    """old without the rows of the parents that are loaded anew (those of new, or ``parents`` where some have no rows now), and new's rows."""
    loaded = (new if parents is None else parents).select(key).distinct()
    return old.join(loaded, key, "left_anti").unionByName(new, allowMissingColumns=True)


def vector_rows(old: DataFrame, new: DataFrame) -> DataFrame:
    """A document's chunks are deleted and added anew; without new rows nothing changes."""
    return replace_children(old, new, "doc_id")


class AppendOnlyLog:
    """A folder of rows that are only added: there is no way to change or delete one."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path, schema

    def append(self, rows: DataFrame) -> None:
        """Adds rows with an id and a time of their own."""
        own = rows.withColumn("id", F.expr("uuid()")).withColumn("ts", F.current_timestamp())
        names = self.spark.createDataFrame([], self.schema).columns
        own.select(*[F.col(c) if c in own.columns else F.lit(None).alias(c) for c in names]).to(self.spark.createDataFrame([], self.schema).schema).write.mode("append").parquet(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)


AUDIT = "id string, ts timestamp, user string, query string, retrieved_doc_ids array<string>, mode string, prompt_version string, unsupported_ranks array<string>, answer_text string, refusal_reason string, person_id string, period string, other_period string"
AUTH_LOG = "id string, ts timestamp, event string, username string, actor_user_id long, target_user_id long, detail string"


def auth_events(events: DataFrame) -> DataFrame:
    """Events as they are logged: a user name is cut at 64 characters."""
    return events.withColumn("username", F.substring("username", 1, 64))


def orphans(children: DataFrame, parents: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose parent is missing; a null key has none to miss."""
    filled = children.where(" and ".join(f"{k} is not null" for k in keys))
    return filled.join(parents.select(*keys).distinct(), list(keys), "left_anti")


def copy_tables(tables: Mapping[str, DataFrame], required: Mapping[str, Sequence[str]], references: Sequence[tuple[str, str, str]], target: str, empty: Mapping[str, str] | None = None) -> dict[str, int]:
    """Writes tables to a new folder and checks columns, references (child, parent, key) and row counts; returns the counts.

    ``empty`` names tables, by their schemas, that the copy has without any row, whatever the source holds. The target must not exist. Everything is
    written to a folder beside it and checked there as it was written; a rename then publishes the whole, with a marker row in ``_copied``. After an error, of
    whatever kind, neither the target nor the staging folder is left.
    """
    empty = dict(empty or {})
    if twice := set(tables) & set(empty):
        raise ValueError(f"{sorted(twice)} are to be copied and to be empty")
    for name, columns in required.items():
        if missing := set(columns) - set(tables[name].columns):
            raise ValueError(f"{name} lacks {sorted(missing)}")
    spark = next(iter(tables.values())).sparkSession
    staging = f"{target.rstrip('/')}.staging-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path
    final, staged = path(target), path(staging)
    files = final.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(final):
        raise FileExistsError(f"{target} exists")
    try:
        counts, copies = {}, {}
        for name, table in [*tables.items(), *((n, spark.createDataFrame([], schema)) for n, schema in empty.items())]:
            table.write.mode("errorifexists").parquet(f"{staging}/{name}")
            copies[name] = spark.read.schema(table.schema).parquet(f"{staging}/{name}")
            counts[name] = copies[name].count()
        for name, table in tables.items():
            if counts[name] != table.count():
                raise ValueError(f"{name} was copied in part")
        for name in empty:
            if counts[name]:
                raise ValueError(f"{name} is not empty")
        for child, parent, key in references:
            if orphans(copies[child], copies[parent], [key]).limit(1).count():
                raise ValueError(f"{child}.{key} refers to rows that {parent} lacks")
        spark.createDataFrame([(k, v) for k, v in counts.items()], "name string, rows long").coalesce(1).write.mode("errorifexists").parquet(f"{staging}/_copied")
        # A rename into a folder that somebody made meanwhile would put the copy inside it.
        if files.exists(final) or not files.rename(staged, final):
            raise FileExistsError(f"{target} exists")
    except BaseException:
        files.delete(staged, True)
        raise
    return counts


def migrated(table: DataFrame, schema_of: DataFrame) -> DataFrame:
    """The table with the columns of a newer schema: new ones are null, and ids stay."""
    return schema_of.limit(0).unionByName(table, allowMissingColumns=True)


def csv_lines(rows: DataFrame, separator: str = ";") -> DataFrame:
    """(line) of each row as text: quoted only where needed, null as nothing."""
    quoted = lambda c: F.when(c.rlike(f'[{separator}"\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
    cells = [F.coalesce(quoted(F.col(c).cast("string")), F.lit("")) for c in rows.columns]
    return rows.select(F.array_join(F.array(*cells), separator).alias("line"))


def publish(tables: Mapping[str, DataFrame], root: str) -> str:
    """Writes related tables below one new version and then names it as the current one, so readers see all of it or none."""
    version = uuid.uuid4().hex
    for name, table in tables.items():
        table.write.parquet(f"{root}/{version}/{name}")
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(version,)], "version string").withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{root}/versions")
    return version


def current(spark: SparkSession, root: str, name: str) -> DataFrame:
    version = spark.read.schema("version string, at timestamp").parquet(f"{root}/versions").orderBy(F.desc("at"), "version").first()[0]
    return spark.read.parquet(f"{root}/{version}/{name}")
