"""The data source of uploaded files: batch, partitions by size, stream, damaged files."""

import os

import pytest
from pyspark.sql import functions as F

from tallymill.sources import files, tables, uploads


@pytest.fixture
def source(spark):
    uploads.register(spark)
    return spark


def put(folder, name, data):
    path = f"{folder}/{name}"
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data)


def test_batch_of_all_kinds(source, tmp_path):
    put(tmp_path, "a.md", " # Ä\n".encode())
    put(tmp_path, "sub/B.TXT", b"plain \xff")
    put(tmp_path, "c.docx", files.docx_bytes(["one <&>", " ", "two"]))
    put(tmp_path, "d.xlsx", files.xlsx_bytes({"S & T": [["k", "v"], ["1", "x|y"]], "U": [["only"]]}))
    put(tmp_path, "e.docx", b"damaged")
    put(tmp_path, "f.exe", b"x")
    put(tmp_path, "_temporary/g.md", b"hidden")
    put(tmp_path, ".h.md", b"hidden")
    put(tmp_path, "empty.md", b"")
    df = source.read.format("uploads").load(str(tmp_path))
    got = {os.path.basename(r["path"]): r for r in df.collect()}
    assert sorted(got) == ["B.TXT", "a.md", "c.docx", "d.xlsx", "e.docx", "empty.md", "f.exe"]
    assert got["a.md"]["text"] == "# Ä" and got["a.md"]["length"] == 6 and got["a.md"]["modified"].year > 2000 and got["empty.md"]["text"] == ""
    assert got["B.TXT"]["kind"] == ".txt" and got["c.docx"]["text"] == "one <&>\n\ntwo"
    assert got["e.docx"]["error"].startswith("BadZipFile") and got["f.exe"]["error"] == "ValueError: no reader for .exe"
    text = files.workbook_text(uploads.workbook_rows(df.where("error IS NULL"))).first()["text"]
    assert text == "## Sheet: S & T\n\n| k | v |\n| --- | --- |\n| 1 | x\\|y |\n\n---\n\n## Sheet: U\n\n| only |\n| --- |"
    some = source.read.format("uploads").option("kinds", ".md, .TXT").load(f"file:{tmp_path}")
    assert sorted(os.path.basename(r["path"]) for r in some.collect()) == ["B.TXT", "a.md", "empty.md"]


def test_partitions_by_size(source, tmp_path):
    for k, n in enumerate([10, 10, 10, 500, 10, 95, 10]):
        put(tmp_path, f"{k}.txt", b"x" * n)
    df = source.read.format("uploads").option("partition_bytes", 100).load(str(tmp_path))
    parts = df.groupBy(F.spark_partition_id().alias("p")).agg(F.sum("length").alias("n"), F.count("*").alias("k")).orderBy("p").collect()
    assert [(r["n"], r["k"]) for r in parts] == [(30, 3), (500, 1), (10, 1), (95, 1), (10, 1)]
    assert [len(p.value) for p in uploads.dealt([("a", 101, 0)], 100)] == [1] and uploads.dealt([], 100) == []


def test_stream_takes_each_file_once(source, tmp_path):
    folder = tmp_path / "in"

    def run():
        rows = source.readStream.format("uploads").option("settle_ms", 0).load(str(folder))
        rows.select("path", "text").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
        return sorted(r["text"] for r in source.read.schema("path string, text string").parquet(f"{tmp_path}/out").collect()) if os.path.exists(f"{tmp_path}/out") else []

    put(folder, "a.md", b"one")
    put(folder, "b.md", b"two")
    assert run() == ["one", "two"]
    put(folder, "0.md", b"three")
    assert run() == ["one", "three", "two"]
    assert run() == ["one", "three", "two"]


def test_objects_put_and_deleted(source, tmp_path):
    paths = [f"{tmp_path}/x/{k}.bin" for k in range(3)]
    rows = source.createDataFrame([(paths[0], bytearray(b"one")), (paths[1], bytearray(b"two")), (paths[1], bytearray(b"two")), (f"file:{paths[2]}", None), ("nowhere://x/y", bytearray(b"z")), (None, None)], "path string, content binary")
    put = {r["path"]: r for r in tables.put_objects(rows).collect()}
    assert put[paths[0]]["done"] and not put["nowhere://x/y"]["done"] and put["nowhere://x/y"]["error"] and len(put) == 4
    assert [open(p, "rb").read() for p in paths] == [b"one", b"two", b""]
    gone = [tables.delete_objects(rows.where("path LIKE '%0.bin'")).first() for _ in range(2)]
    assert [r["done"] for r in gone] == [True, False] and sorted(os.listdir(f"{tmp_path}/x")) == ["1.bin", "2.bin"]


def test_missing_folder(source, tmp_path):
    assert source.read.format("uploads").load(f"{tmp_path}/nowhere").count() == 0
