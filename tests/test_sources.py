"""Sources, sinks and streams on small files."""

import hashlib

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from threadloom.sources import files
from threadloom.streaming import events as streams

RECORD = StructType([StructField("id", StringType()), StructField("n", LongType())])


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_json_lines_number_every_split_line(spark, tmp_path):
    own = [f'{{"id": "a{i}", "n": {i}}}' if i % 3 else "" for i in range(1, 400)]
    (tmp_path / "x.jsonl").write_text("\n".join(own) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")
    try:
        read = files.json_lines(spark, str(tmp_path / "x.jsonl"), RECORD)
        got = rows(read.select("n", "source_line"))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == [(i, i) for i in range(1, 400) if i % 3]


def test_bad_json_fails_with_its_line(spark, tmp_path):
    (tmp_path / "y.jsonl").write_text('{"id": "a", "n": 1}\n\n{"id": "b", \n')
    with pytest.raises(Exception, match=r"not JSON at .*y\.jsonl:3"):
        files.json_lines(spark, str(tmp_path / "y.jsonl"), RECORD).collect()


def test_label_and_code_sheets(spark, tmp_path):
    (tmp_path / "l.csv").write_text("id,relevant\n1,yes\n2,\n")
    assert rows(files.label_sheet(spark, str(tmp_path / "l.csv"), ["id", "relevant"], {"relevant": ["yes", "no", ""]})) == [("1", "yes"), ("2", "")]
    with pytest.raises(Exception, match="relevant holds yes"):
        files.label_sheet(spark, str(tmp_path / "l.csv"), ["id", "relevant"], {"relevant": ["no", ""]}).collect()
    (tmp_path / "c.txt").write_text("# head\n\n7: ba  # note\n8:\n")
    assert rows(files.code_sheet(spark, str(tmp_path / "c.txt"))) == [("7", ["A", "B"]), ("8", [])]


def test_trees_flatten(spark):
    text = '{"kind": "Listing", "data": {"children": [{"kind": "t1", "data": {"id": "a", "replies": {"kind": "Listing", "data": {"children": [{"kind": "more", "data": {"id": "m", "count": 4}}]}}}}, {"kind": "t9", "data": {"id": "z"}}]}}'
    got = files.tree_rows(spark.createDataFrame([(1, text), (2, None)], "post long, nested string"), "post", "nested")
    assert set(map(tuple, got.collect())) == {(1, "a", None, 0, "t1", 0), (1, "m", "a", 1, "more", 4), (1, "z", None, 0, "unknown", 0)}


def test_sinks_and_checksums(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), (None, 2)], "s string, n int")
    assert files.write_both(df, str(tmp_path / "t")) == {"columns": {"s": "string", "n": "int"}, "rows": 2}
    (tmp_path / "f").mkdir()
    (tmp_path / "f/a.txt").write_text("x")
    sums = files.checksums(spark, str(tmp_path / "f"))
    own = hashlib.sha256(b"x").hexdigest()
    assert rows(sums) == [("a.txt", 1, own)]
    assert files.roll_up(sums).first().sha256 == hashlib.sha256(f"a.txt:{own}".encode()).hexdigest()


def test_a_restarted_stream_emits_a_key_once(spark, tmp_path):
    src, out, state = (str(tmp_path / x) for x in ("src", "out", "state"))
    one = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "id long, v string")

    def run():
        stream = spark.readStream.schema(one.schema).parquet(src)
        return rows(streams.drain(streams.first_seen(stream.select("id"), ["id"]), out, state))

    one.write.parquet(src)
    assert run() == [(1,), (2,)]
    spark.createDataFrame([(2, "d"), (3, "e")], "id long, v string").write.mode("append").parquet(src)
    assert run() == [(1,), (2,), (3,)]


def test_late_rows_are_flagged_and_kept(spark):
    df = spark.createDataFrame([("2024-05-01", "2024-01-01"), ("2023-12-31", "2024-01-01"), (None, "2024-01-01")], "d string, a string").select(F.to_date("d").alias("d"), F.to_date("a").alias("a"))
    assert [(r.is_late, r.is_early) for r in streams.flag_late(df, F.col("d"), F.col("a")).collect()] == [(True, False), (False, True), (False, False)]
