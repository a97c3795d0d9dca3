"""Tables as files."""

import os
import shutil

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from quillspark.sources import tables, vector_index
from quillspark.streaming import batches


def test_csv_and_json_lines(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "q", b\nc', ["x", "y"]), (2, "  ", [])], "i int, t string, xs array<string>")
    tables.write_csv(df, str(tmp_path / "c"))
    got = tables.read_csv(spark, str(tmp_path / "c"), "i int, t string, xs string").orderBy("i").collect()
    assert [tuple(r) for r in got] == [(1, 'a "q", b\nc', "x|y"), (2, None, None)]
    assert tables.read_csv(spark, str(tmp_path / "c"), "i int, t string, xs string", line_breaks=False).where("i = 2").count() == 1
    tables.write_json_lines(df, str(tmp_path / "j"))
    good, bad = tables.read_json_lines(spark, str(tmp_path / "j"), df.schema)
    assert sorted(map(tuple, good.collect())) == [(1, 'a "q", b\nc', ["x", "y"]), (2, "  ", [])] and bad.count() == 0


def test_bad_lines_are_rescued(spark, tmp_path):
    lines = ['{"i": 1, "t": "a"}', "", '{"i": 2', "not json", '{"i": "x", "t": "b"}', "  ", '[{"i": 3}]', "null", '{"t": "c"}', '{"i": 4, "other": 5}', "7"]
    (tmp_path / "a.json").write_text("\n".join(lines[:6]) + "\n")
    (tmp_path / "b.json").write_text("\n".join(lines[6:]))
    good, bad = tables.read_json_lines(spark, str(tmp_path), "i int, t string")
    assert sorted(map(tuple, good.collect()), key=str) == sorted([(1, "a"), (None, "c"), (4, None)], key=str)
    assert sorted(r["line"] for r in bad.collect()) == sorted(['{"i": 2', "not json", '{"i": "x", "t": "b"}', '[{"i": 3}]', "null", "7"])
    assert good.count() + bad.count() == sum(1 for x in lines if x.strip()) and {r["file"][-6:] for r in bad.collect()} == {"a.json", "b.json"}


def test_vector_index(spark, tmp_path):
    rows = [(i * 7 % 250, [1.0 if j == i % 4 else 0.0 for j in range(4)], f"m{i}") for i in range(250)]
    df = spark.createDataFrame(rows, "id long, v array<double>, meta string").repartition(5)
    path = str(tmp_path / "ix")
    manifest = vector_index.write_index(df, path, part=60)
    assert sorted((r["part"], r["n_rows"], r["first"], r["last"]) for r in manifest.collect()) == [(0, 60, 0, 59), (1, 60, 60, 119), (2, 60, 120, 179), (3, 60, 180, 239), (4, 10, 240, 249)]
    got = vector_index.read_index(spark, path).orderBy("place").collect()
    assert [r["id"] for r in got] == list(range(250)) and {(r["id"], tuple(r["v"]), r["meta"]) for r in got} == {(i, tuple(v), m) for i, v, m in rows}
    assert vector_index.check_index(spark, path).count() == 0
    shutil.rmtree(f"{path}/rows/part=3")
    assert [tuple(r) for r in vector_index.check_index(spark, path).collect()] == [(3, "missing part")]
    longer = df.withColumn("v", F.when(F.col("id") == 5, F.transform("v", lambda x: x * 2)).otherwise(F.col("v")))
    other = str(tmp_path / "iy")
    vector_index.write_index(longer, other, part=60)
    assert [tuple(r) for r in vector_index.check_index(spark, other).collect()] == [(0, "norm is not 1")]
    shutil.rmtree(f"{path}/rows/part=0")
    shutil.copytree(f"{other}/rows/part=0", f"{path}/rows/part=0")
    assert {tuple(r) for r in vector_index.check_index(spark, path).collect()} == {(3, "missing part"), (0, "rows changed"), (0, "norm is not 1")}
    shutil.rmtree(f"{path}/manifest")
    with pytest.raises(AnalysisException):
        vector_index.read_index(spark, path)


def test_batches_capture_errors_and_survive_a_kill(spark, tmp_path):
    source, target, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    spark.range(40).repartition(8).write.parquet(source)

    def work(row):
        if row["id"] % 10 == 3:
            raise ValueError(f"no {row['id']}")
        return {"double": row["id"] * 2}

    batches.run_batches(spark, source, target, mark, work, "double long", files=3).awaitTermination(120)
    got = batches.results(spark, target, "id")
    assert sorted((r["id"], r["double"], r["error"]) for r in got.where("error is null").collect()) == [(i, 2 * i, None) for i in range(40) if i % 10 != 3]
    assert sorted(r["error"] for r in got.where("error is not null").collect()) == [f"ValueError: no {i}" for i in (13, 23, 3, 33)]
    # a batch that was written but not committed is written again, not doubled; new files are taken up
    for name in os.listdir(f"{mark}/commits"):
        if name.strip(".").split(".")[0] == "2":
            os.remove(f"{mark}/commits/{name}")
    shutil.rmtree(f"{target}/batch=2")
    spark.range(40, 45).coalesce(1).write.mode("append").parquet(source)
    batches.run_batches(spark, source, target, mark, work, "double long", files=3).awaitTermination(120)
    assert sorted(r["id"] for r in batches.results(spark, target, "id").collect()) == list(range(45))
    batches.retry_failures(spark, target, "id", lambda row: {"double": -1}, "double long")
    d = batches.results(spark, target, "id")
    assert d.count() == 45 and d.where("error is not null").count() == 0 and sorted(r["id"] for r in d.where("double = -1").collect()) == [3, 13, 23, 33, 43]


def test_columns(spark):
    df = spark.range(1).withColumnRenamed("id", "a")
    assert tables.missing_columns(df, ["a", "b"], [("a", "c"), ("d", "e")]) == ["b", "d|e"]


def test_resume(spark, tmp_path):
    path = str(tmp_path / "out")
    assert tables.append_remaining(spark.range(3), path, "id", lambda d: d) == 3
    assert tables.append_remaining(spark.range(5), path, "id", lambda d: d) == 2
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == [0, 1, 2, 3, 4]
