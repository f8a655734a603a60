import os
import random

import pytest
from pyspark.sql import functions as F

from folioscope.sources import csv_file, store
from folioscope.sources.bucketed import BUCKET, BucketedTable

SCHEMA = "id long, name string, made int"


def files(path):
    return {(d, f) for d in os.listdir(path) if d.startswith(BUCKET) for f in os.listdir(path / d) if f.startswith("part")}


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_a_merge_rewrites_only_the_folders_of_its_keys(spark, tmp_path):
    table = BucketedTable(spark, str(tmp_path / "t"), SCHEMA, ["id"], buckets=16)
    assert table.read().collect() == [] and table.merge(spark.createDataFrame([], SCHEMA)) == []
    first = [(i, f"n{i}", i) for i in range(400)] + [(None, "nobody", 0)]
    assert len(table.merge(spark.createDataFrame(first, SCHEMA).repartition(5))) == 16
    before, want = files(tmp_path / "t"), {r[0]: r for r in first}
    touched = table.merge(spark.createDataFrame([(7, "seven", 99), (1007, "new", 99)], SCHEMA), keep=["made"])
    want |= {7: (7, "seven", 7), 1007: (1007, "new", 99)}
    assert rows(table.read()) == sorted(want.values(), key=str)
    after = files(tmp_path / "t")
    folder = lambda b: f"{BUCKET}={b}"
    assert {f for f in before if f[0] not in map(folder, touched)} == {f for f in after if f[0] not in map(folder, touched)}
    assert 1 <= len(touched) <= 2 and not {f for f in before & after if f[0] in map(folder, touched)}
    # The same load again changes nothing, and a column that it lacks stays.
    table.merge(spark.createDataFrame([(7, "seven", 99), (1007, "new", 99)], SCHEMA), keep=["made"])
    table.merge(spark.createDataFrame([(None, "somebody")], "id long, name string"))
    want[None] = (None, "somebody", 0)
    assert rows(table.read()) == sorted(want.values(), key=str)
    assert rows(table.lookup(7)) == [(7, "seven", 7)] and rows(table.lookup(None)) == [want[None]] and table.lookup(-1).collect() == []


def test_a_lookup_reads_one_folder(spark, tmp_path):
    table = BucketedTable(spark, str(tmp_path / "t"), SCHEMA, ["id"], buckets=8)
    table.merge(spark.createDataFrame([(i, "x", i) for i in range(200)], SCHEMA))
    read = table.lookup(5)
    assert len({os.path.dirname(r[0]) for r in read.select(F.input_file_name()).collect()}) == 1
    scan = read._jdf.queryExecution().executedPlan().toString()
    assert f"PartitionFilters: [isnotnull({BUCKET}" in scan


def test_children_are_replaced_and_empty_folders_go(spark, tmp_path):
    schema = "eval_id long, code string"
    table = BucketedTable(spark, str(tmp_path / "t"), schema, ["eval_id"], buckets=64)
    table.replace(spark.createDataFrame([(i, c) for i in range(40) for c in "abc"], schema))
    new = spark.createDataFrame([(3, "z")], schema)
    loaded = spark.createDataFrame([(3,), (4,), (99,)], "eval_id long")
    table.replace(new, parents=loaded)
    assert rows(table.read()) == sorted([(i, c) for i in range(40) for c in "abc" if i not in (3, 4)] + [(3, "z")], key=str)
    with pytest.raises(ValueError, match="not replaced"):
        table.replace(new, parents=loaded.where("eval_id = 4"))
    table.delete(spark.createDataFrame([(i,) for i in range(40)], "eval_id long"))
    assert table.read().collect() == [] and not files(tmp_path / "t")
    table.merge(new)
    assert rows(table.read()) == [(3, "z")]


def test_a_load_that_fails_changes_nothing(spark, tmp_path):
    table = BucketedTable(spark, str(tmp_path / "t"), SCHEMA, ["id"], buckets=4)
    table.merge(spark.createDataFrame([(i, "x", i) for i in range(20)], SCHEMA))
    before, want = files(tmp_path / "t"), rows(table.read())
    bad = spark.range(50).select("id", F.when(F.col("id") == 49, F.raise_error(F.lit("broken row"))).otherwise("y").alias("name"), F.lit(1).alias("made"))
    with pytest.raises(Exception, match="broken row"):
        table.merge(bad)
    assert files(tmp_path / "t") == before and rows(table.read()) == want


def test_random_loads_equal_a_dictionary(spark, tmp_path):
    rng, want = random.Random(6), {}
    table = BucketedTable(spark, str(tmp_path / "t"), "a string, b int, v int", ["a", "b"], buckets=8)
    for step in range(4):
        new = {(rng.choice(["x", "y", None]), rng.choice([None, *range(6)])): rng.randint(0, 999) for _ in range(9)}
        if step % 2:
            gone = spark.createDataFrame(list(new), "a string, b int")
            table.delete(gone)
            want = {k: v for k, v in want.items() if k not in new}
        else:
            table.merge(spark.createDataFrame([(*k, v) for k, v in new.items()], "a string, b int, v int"))
            want |= new
    assert rows(table.read()) == sorted([(*k, v) for k, v in want.items()], key=str)


def test_csv_is_byte_equal_over_several_partitions(spark, tmp_path):
    rng = random.Random(3)
    cells = [None, "", "plain", "a;b", 'say "no"', "two\nlines", "cr\rhere", "Ελλάς", " blanks "]
    data = [(i, rng.choice(cells), None if i % 5 == 0 else i / 4) for i in range(1000)]
    shuffled = rng.sample(data, len(data))
    df = spark.createDataFrame(shuffled, "id int, note string, score double").repartition(7)
    path = str(tmp_path / "out" / "file.csv")
    os.makedirs(tmp_path / "out")
    csv_file.write_csv(df, path, ["id"])
    quoted = lambda v: "" if v is None else f'"{v.replace(chr(34), chr(34) * 2)}"' if set(v) & set(';"\r\n') else v
    lines = ["id;note;score", *(f"{i};{quoted(n)};{'' if s is None else s}" for i, n, s in data)]
    assert open(path, "rb").read() == b"\xef\xbb\xbf" + "".join(x + "\r\n" for x in lines).encode()
    assert os.listdir(tmp_path / "out") == ["file.csv"]
    # As spreadsheet programs do, Spark reads the rows back.
    back = spark.read.option("sep", ";").option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)
    assert back.count() == 1000


def test_csv_keeps_what_is_there_and_leaves_nothing_after_an_error(spark, tmp_path):
    one = spark.createDataFrame([("a",)], "v string")
    path = str(tmp_path / "file.csv")
    csv_file.write_csv(one, path, ["v"], separator=",", header=False)
    assert open(path, "rb").read() == b"\xef\xbb\xbfa\r\n"
    with pytest.raises(Exception, match="file.csv"):
        csv_file.write_csv(one, path, ["v"])
    broken = spark.range(100).select(F.when(F.col("id") == 99, F.raise_error(F.lit("broken row"))).otherwise(F.col("id").cast("string")).alias("v"))
    with pytest.raises(Exception, match="broken row"):
        csv_file.write_csv(broken, path, [F.lit(1)], overwrite=True)
    assert os.listdir(tmp_path) == ["file.csv"] and open(path, "rb").read() == b"\xef\xbb\xbfa\r\n"
    csv_file.write_csv(one.where("false"), path, ["v"], overwrite=True)
    assert open(path, "rb").read() == b"\xef\xbb\xbfv\r\n" and os.listdir(tmp_path) == ["file.csv"]


def test_a_copy_that_fails_leaves_nothing(spark, tmp_path):
    persons = spark.createDataFrame([("p",)], "person_id string")
    ev = spark.createDataFrame([("p", 1), ("q", 2)], "person_id string, id int")
    target = str(tmp_path / "copy")
    with pytest.raises(ValueError, match="refers"):
        store.copy_tables({"persons": persons, "ev": ev}, {}, [("ev", "persons", "person_id")], target)
    broken = ev.withColumn("id", F.when(F.col("id") == 2, F.raise_error(F.lit("broken row"))).otherwise(F.col("id")).cast("int"))
    with pytest.raises(Exception, match="broken row"):
        store.copy_tables({"persons": persons, "ev": broken}, {}, [], target)
    with pytest.raises(ValueError, match="to be empty"):
        store.copy_tables({"persons": persons}, {}, [], target, empty={"persons": "person_id string"})
    assert os.listdir(tmp_path) == []
    counts = store.copy_tables({"persons": persons, "ev": ev}, {"ev": ["id"]}, [], target, empty={"users": "id long, name string"})
    assert counts == {"persons": 1, "ev": 2, "users": 0} and spark.read.parquet(f"{target}/users").schema.names == ["id", "name"]
    assert os.listdir(tmp_path) == ["copy"] and sorted(d for d in os.listdir(target)) == ["_copied", "ev", "persons", "users"]
    with pytest.raises(FileExistsError):
        store.copy_tables({"persons": persons}, {}, [], target)
    assert sorted(os.listdir(target)) == ["_copied", "ev", "persons", "users"]
