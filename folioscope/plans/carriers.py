"""The driver's tables in the shapes of the engine: orders as evaluations, line items as field scores, and so on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.functions.periods import period


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, *keys: str, each: int | None = None) -> DataFrame:
    """rows dealt over all cores by their keys, before work that costs far more than their bytes tell: a small file is read by one task or two.

    With ``each``, a task gets about as many rows at most, so that its memory does not grow with the table; this counts the rows.
    """
    parts = 4 * rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(max(parts, -(-rows.count() // each)) if each else parts, *keys)


def evaluations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order is an evaluation of its customer over half a year; pending ones have no score."""
    start = F.to_date("o_orderdate")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").cast("string").alias("person_id"), start.alias("period_start"), F.date_add(start, 180).alias("period_end"), F.when(F.col("o_orderstatus") != "P", (F.col("o_orderkey") % 101).cast("int")).alias("score"), F.col("o_orderpriority").alias("kind"))
    return rows.withColumn("period", period(F.col("period_start"), F.col("period_end")))


def dealt_evaluations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``evaluations`` dealt by person and period, 100,000 a task at most, so that what groups and joins by both takes as much memory at any size."""
    return spread(evaluations(spark, sf_dir), "person_id", "period", each=100_000)


EVALUATIONS = """ev AS (
    SELECT o_orderkey AS id, o_custkey::VARCHAR AS person_id, o_orderdate::DATE AS period_start, o_orderdate::DATE + 180 AS period_end,
           CASE WHEN o_orderstatus <> 'P' THEN (o_orderkey % 101)::INT END AS score, o_orderpriority AS kind,
           strftime(o_orderdate::DATE, '%Y-%m-%d') || '..' || strftime(o_orderdate::DATE + 180, '%Y-%m-%d') AS period
    FROM orders)"""


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document for each of a customer's periods; the name carries the first order's priority."""
    return dealt_evaluations(spark, sf_dir).groupBy("person_id", "period").agg(F.concat(F.lit("d"), F.min("id").cast("string")).alias("doc_id"))


DOCUMENTS = "docs AS (SELECT person_id, period, 'd' || min(id)::VARCHAR AS doc_id FROM ev GROUP BY ALL)"


def field_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line item is a field score; returned ones have a word for a value, and line 7 is the overall field."""
    code = F.when(F.col("l_linenumber") == 7, "141").otherwise(F.col("l_linenumber").cast("string"))
    return table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("eval_id"), code.alias("field_code"), F.when(F.col("l_returnflag") == "R", "yes").otherwise(F.col("l_quantity").cast("int").cast("string")).alias("value"))


FIELD_SCORES = """fs AS (
    SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS eval_id, CASE WHEN l_linenumber = 7 THEN '141' ELSE l_linenumber::VARCHAR END AS field_code,
           CASE WHEN l_returnflag = 'R' THEN 'yes' ELSE l_quantity::INT::VARCHAR END AS value
    FROM lineitem)"""


def promotions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders as promotions with every other index left out for some."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").cast("string").alias("person_id"), (F.col("o_orderkey") % 12).cast("int").alias("row_index"), F.col("o_orderpriority").alias("rank"))


PROMOTIONS = "pr AS (SELECT o_orderkey AS id, o_custkey::VARCHAR AS person_id, (o_orderkey % 12)::INT AS row_index, o_orderpriority AS rank FROM orders)"


def duty_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order is a page, and each of its line numbers a block of words with positions: an anchor, two dates, two or three labels and days.

    Line 5 has one date alone; labels of even lines go on below; every third block has no end of its own, so that it takes in the label below.
    Line items are dealt by page before they become a dozen words each, so that what goes by page later moves nothing.
    """
    one = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_shipdate")
    used = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_linestatus", "l_returnflag", "l_quantity")
    t = spread(used, "l_orderkey", each=100_000).withColumn("r", F.row_number().over(one)).where("r = 1").withColumn("n", F.col("l_linenumber").cast("int")).withColumn("y", F.col("n") * 100.0)
    start = F.to_date("l_shipdate")

    def word(x: float, down: float, text, when=None, width: float = 8.0):
        made = F.struct(F.lit(x).alias("x0"), (F.col("y") + down).alias("y0"), F.lit(x + width).alias("x1"), (F.col("y") + down + 8.0).alias("y1"), text.alias("text"))
        return made if when is None else F.when(when, made)

    n, date = F.col("n"), lambda d: F.date_format(d, "dd/MM/yyyy")
    words = F.array(
        word(50.0, 0.0, F.lit("E.A.")), word(100.0, -2.39, date(start)), word(160.0, -2.39, date(F.date_add(start, n)), n != 5),
        word(418.56, 20.0, F.col("l_linestatus")), word(450.0, 21.0, F.col("l_returnflag")), word(418.0, 29.5, F.lit("on"), n % 2 == 0), word(440.0, 30.0, F.lit("board"), n % 2 == 0),
        word(526.8, 17.61, F.col("l_quantity").cast("int").cast("string"), F.col("l_returnflag") != "R"),
        word(418.56, 50.0, F.lit("second")), word(527.0, 48.11, n.cast("string")), word(527.0, 48.5, F.lit("99")), word(300.0, 50.0, F.lit("elsewhere")),
        word(50.0, 60.0, F.lit("Evaluator:"), n % 3 != 0), word(418.56, 70.0, F.lit("after")),
    )
    return t.select(F.lit("d").alias("doc_id"), F.col("l_orderkey").alias("page"), F.explode(F.array_compact(words)).alias("w")).select("doc_id", "page", "w.*")
