import json
import struct
import zlib

import numpy as np
import pytest

from shoebox.sources import files, images, media_source, sinks
from shoebox.streaming import ingest


def png(pixels):
    h, w = pixels.shape
    raw = b"".join(b"\x00" + bytes(r) for r in pixels.astype(np.uint8))
    part = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


@pytest.fixture
def folder(tmp_path):
    rnd = np.random.default_rng(1)
    base = rnd.integers(0, 255, (8, 8)).repeat(8, 0).repeat(8, 1)
    dot = base.copy()
    dot[0, 0] ^= 1
    for name, p in (("a.png", base), ("b.png", dot), ("c.png", 255 - base), ("sub/d.png", np.zeros((64, 64)))):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(png(p))
    (tmp_path / "sub/e f.MP4").write_bytes(b"video")
    (tmp_path / "notes.txt").write_text("x")
    return tmp_path


def test_local_media(spark, folder):
    got = [(r["path"], r["mime"], r["size"] > 0) for r in files.local_media(spark, str(folder)).collect()]
    assert got == [("a.png", "image/png", True), ("b.png", "image/png", True), ("c.png", "image/png", True), ("sub/d.png", "image/png", True), ("sub/e f.MP4", "video/mp4", True)]


def test_data_source_and_pushed_filter(spark, folder):
    form = media_source.register(spark)
    df = spark.read.format(form).load(str(folder))
    assert df.count() == 5 and [r["path"] for r in df.where("kind = 'video'").collect()] == ["sub/e f.MP4"]
    with pytest.raises(ValueError):
        media_source.register(spark, "cloud")


def test_image_features(spark, folder):
    pics = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.png").load(str(folder)).select("path", "content")
    bad = spark.createDataFrame([("x", bytearray(b"no picture"))], "path string, content binary")
    got = {r["path"].rsplit("/", 1)[-1]: r for r in images.image_features(pics.unionByName(bad)).collect()}
    bits = lambda a, b: (int(got[a]["phash"], 16) ^ int(got[b]["phash"], 16)).bit_count()
    assert bits("a.png", "b.png") <= 2 and bits("a.png", "c.png") >= 48
    assert got["d.png"]["sharpness"] == 0.0 and got["x"]["phash"] is None and got["x"]["quality"] is None
    assert 0 <= got["a.png"]["quality"] <= 1


def test_drive_listing(spark, rows):
    page = {"files": [
        {"id": "1", "name": "a", "mimeType": "image/jpeg", "size": "12", "imageMediaMetadata": {"cameraMake": "X", "cameraModel": "Y", "width": 3, "location": {"latitude": 1.5, "longitude": 2.5}}},
        {"id": "2", "name": "b", "mimeType": "video/mp4", "videoMediaMetadata": {"durationMillis": "1500", "width": 7}},
        {"id": "3", "name": "c", "mimeType": "text/plain"}, {"id": "4", "name": "d", "mimeType": "image/png", "trashed": True},
    ]}
    got = files.drive_listing(spark.createDataFrame([(json.dumps(page),), ("broken",)], "value string"))
    assert rows(got.select("source_id", "size", "camera", "width", "duration", "gps_lat")) == [("1", 12, "X Y", 3, None, 1.5), ("2", 0, None, 7, 1.5, None)]


def test_ledgers_and_manifest(spark, rows, tmp_path):
    p = str(tmp_path / "ledger.jsonl")
    (tmp_path / "ledger.jsonl").write_text('{"md5":"a","path":"p1","size":1}\nbroken\n{"path":"p2"}\n{"md5":"a","path":"p3","size":3}\n{"md5":"b","path":"p4","size":4}\n')
    assert rows(files.ledger(spark, p)) == [("a", "p3", 3), ("b", "p4", 4)]
    (tmp_path / "skip.jsonl").write_text('{"drive_path":"x","md5":"a"}\nbroken\n')
    assert rows(files.skipped_report(spark, str(tmp_path / "skip.jsonl"))) == [("x", "a", None, None)]
    moves = spark.createDataFrame([(1, "a", "b"), (2, "c", "d")], "seq long, `from` string, `to` string")
    sinks.append_lines(moves, str(tmp_path / "manifest"))
    assert [tuple(r) for r in sinks.undo_plan(spark, str(tmp_path / "manifest")).collect()] == [(2, "d", "c"), (1, "b", "a")]
    sinks.write_csv(moves, str(tmp_path / "csv"), one_file=True)
    assert spark.read.option("header", "true").csv(str(tmp_path / "csv")).count() == 2
    sinks.write_tables({"moves": moves}, str(tmp_path / "tables"))
    assert spark.read.parquet(str(tmp_path / "tables/moves")).count() == 2
    assert sinks.folder_bytes(spark, str(tmp_path / "tables")).first()["files"] > 0


def test_sidecars(spark, rows):
    media = spark.createDataFrame([("d/IMG_1.jpg",), ("d/IMG_2.jpg",), ("e/IMG_1.jpg",)], "path string")
    side = spark.createDataFrame([
        ("d/IMG_1.jpg.json", '{"photoTakenTime":{"timestamp":"1577836800"}}'), ("d/IMG_1.jpg.extra.json", '{"photoTakenTime":{"timestamp":"1"}}'),
        ("d/IMG_2.jpg.supplemental-metadata.json", '{"creationTime":{"timestamp":"1609459200"}}'), ("e/IMG_1.jpg.json", "broken"),
    ], "path string, value string")
    assert rows(files.sidecar_years(media, side)) == [("d/IMG_1.jpg", 2020), ("d/IMG_2.jpg", 2021)]


def test_streams(spark, rows, tmp_path):
    schema = "source string, path string, size long, md5 string, status string"
    spark.createDataFrame([("s", "a", 1, "m", "analyzed")], schema).write.parquet(str(tmp_path / "index/v0"))
    spark.createDataFrame([("s", "a", 5, None), ("s", "b", 2, "n")], "source string, path string, size long, md5 string").write.parquet(str(tmp_path / "in/1"))
    stream = ingest.listing_stream(spark, str(tmp_path / "in/*"), "source string, path string, size long, md5 string")
    ingest.index_stream(stream, str(tmp_path / "index"), ["source", "path"], ["size"], ["md5"], str(tmp_path / "cp")).awaitTermination(60)
    assert rows(spark.read.parquet(str(tmp_path / "index/v1"))) == [("s", "a", 5, "m", "analyzed"), ("s", "b", 2, "n", None)]


def test_stream_deduplication_and_windows(spark, data, tmp_path):
    events = spark.read.parquet(f"{data}/events.parquet")
    listing = spark.read.parquet(f"{data}/listing.parquet")
    listing.write.parquet(str(tmp_path / "l"))
    once = ingest.first_copies(spark.readStream.schema(listing.schema).parquet(str(tmp_path / "l")).selectExpr("md5", "cast(listed_at as timestamp) listed_at"))
    once.writeStream.format("memory").queryName("once").trigger(availableNow=True).start().awaitTermination(60)
    assert spark.table("once").count() == listing.where("md5 is not null").select("md5").distinct().count()
    events.write.parquet(str(tmp_path / "e"))
    live = spark.readStream.schema(events.schema).parquet(str(tmp_path / "e"))
    ingest.windowed_counts(live).writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start().awaitTermination(60)
    assert spark.table("windows").count() == ingest.windowed_counts(events).count()
