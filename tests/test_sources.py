"""Files, tables and streams."""

import json
import struct
import zipfile
import zlib

from pyspark.sql import functions as F

from quillstone.operators import index
from quillstone.sources import files, tables
from quillstone.streaming import ingest


def record(tag, body):
    return struct.pack("<I", tag | len(body) << 20) + body


def test_records():
    data = record(66, b"skip") + record(67, "안녕".encode("utf-16")) + record(67, b"\x00\xd8") + record(67, "a\n".encode("utf-16"))
    packer = zlib.compressobj(wbits=-15)
    for raw, packed in ((data, False), (packer.compress(data) + packer.flush(), True)):
        assert list(files.record_texts(raw, packed)) == ["안녕", "a\n"]
    assert list(files.record_texts(data + b"\x43", False))[:1] == ["안녕"]
    assert list(files.record_texts(record(67, b"abcd")[:-2], False)) == []


def test_directory(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.pdf").write_bytes(b"one|two")
    (tmp_path / "sub" / "b.HWP").write_bytes(b"bad")
    (tmp_path / "c.txt").write_bytes(b"no parser")

    def parse(data):
        if data == b"bad":
            raise ValueError("broken")
        return data.decode().split("|")

    rows = files.load(spark, str(tmp_path), {".pdf": parse, ".hwp": parse}).orderBy("file_name", "page").collect()
    assert [(r["file_name"], r["file_type"], r["page"], r["text"], r["error"]) for r in rows] == [("a.pdf", "pdf", 0, "one", None), ("a.pdf", "pdf", 1, "two", None), ("b.HWP", "hwp", 0, None, "ValueError: broken")]


def test_default_parsers_fail_softly(spark, tmp_path):
    (tmp_path / "x.hwp").write_bytes(b"not a container")
    assert files.load(spark, str(tmp_path)).first()["error"]


def test_metadata_in_both_encodings(spark, tmp_path):
    text = "파일명,공고 번호,사업명,발주 기관,사업 금액,공개 일자\na (1).pdf,N1,\"제목, 하나\",기관,\"1,000원\",2024-01-02\n,N2,,,,\nb.hwp,,,,nan,\n"
    for name, encoding in (("u.csv", "utf-8-sig"), ("e.csv", "euc-kr")):
        (tmp_path / name).write_bytes(text.encode(encoding))
        rows = tables.read_metadata(spark, str(tmp_path / name)).orderBy("ordinal").collect()
        assert [(r["file_name"], r["doc_id"], r["title"], r["budget"], r["file_key"], r["bid_start"]) for r in rows] == [("a (1).pdf", "N1", "제목, 하나", 1000.0, "a1", None), ("b.hwp", None, None, None, "b", None)]


def test_hwpx_is_a_zip_of_xml(spark, tmp_path):
    part = lambda *ps: '<s:sec xmlns:s="urn:s" xmlns:p="urn:p">' + "".join(f"<p:p><p:run>{t}</p:run></p:p>" for t in ps) + "</s:sec>"
    with zipfile.ZipFile(tmp_path / "a.hwpx", "w") as z:
        z.writestr("Contents/section10.xml", part("<p:t>last</p:t>"))
        z.writestr("Contents/section2.xml", part("<p:t>one<p:tab/> two</p:t><p:t>three</p:t>", "<p:t/>", "<p:tbl><p:p><p:t>cell</p:t></p:p></p:tbl>"))
        z.writestr("Contents/section3.xml", "<broken")
    (tmp_path / "b.hwpx").write_bytes(b"not a zip")
    assert files.parse_hwpx((tmp_path / "a.hwpx").read_bytes()) == ["one twothree\ncell\nlast"]
    rows = {r["file_name"]: r for r in files.load(spark, str(tmp_path)).collect()}
    assert rows["a.hwpx"]["error"] is None and rows["a.hwpx"]["file_type"] == "hwpx" and rows["b.hwpx"]["error"].startswith("BadZipFile")


def test_evaluation_set_and_chunks(spark, tmp_path):
    (tmp_path / "e.json").write_text(json.dumps([{"file_name": "A.pdf", "user_input": " q ", "reference": "r"}, {"user_input": "lost"}, {"file_name": " "}]))
    rows = tables.read_eval_set(spark, str(tmp_path / "e.json")).collect()
    assert [(r["user_input"], r["reference"], r["comment"], r["relevant_id"]) for r in rows] == [("q", "r", "", "a")]
    chunks = spark.createDataFrame([("d_0001", "d", "text", 1.5)], "chunk_id string, doc_id string, content string, budget double")
    tables.write_chunks(chunks, str(tmp_path / "chunks"))
    back = index.flattened(spark.read.json(str(tmp_path / "chunks"), schema=tables.CHUNK_SCHEMA)).first()
    assert (back["id"], back["chunk_id"], back["content"], back["doc_id"]) == ("d_0001", "d_0001", "text", "d")


def test_index_files(spark, tmp_path):
    rows = index.points(spark.createDataFrame([(f"d_{i:04d}", f"text {i}", "pdf") for i in range(5)], "chunk_id string, content string, file_type string"))
    index.write(rows, str(tmp_path / "points"), "file_type")
    index.write(rows, str(tmp_path / "points"), "file_type")
    got = index.scan(spark, str(tmp_path / "points"), 3)
    assert got.count() == 3 and "dense" not in got.columns


def test_stream_follows_a_folder(spark, tmp_path):
    schema = "chunk_id string, content string"
    put = lambda name, rows: spark.createDataFrame(rows, schema).write.mode("append").parquet(str(tmp_path / "in"))
    run = lambda: ingest.ingest(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    put("a", [("d_0001", "first"), ("d_0002", "second")])
    run()
    put("b", [("d_0001", "newer")])
    run()
    assert {r["chunk_id"]: r["content"] for r in ingest.latest(spark, str(tmp_path / "out")).collect()} == {"d_0001": "newer", "d_0002": "second"}


def test_rates_as_a_stream(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    stream = spark.readStream.schema(events.schema).parquet("/root/testdata/sf0.001/events.parquet*")
    query = ingest.rates(stream).writeStream.format("memory").queryName("rates").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(map(str, spark.table("rates").collect())) == sorted(map(str, ingest.rates(events).collect()))
    assert spark.table("rates").agg(F.sum("n")).first()[0] == events.count()
