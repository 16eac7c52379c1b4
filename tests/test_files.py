import struct
import zlib

from pyspark.sql import functions as F

from shutterlake.config import Params
from shutterlake.plans.reports import write_reports
from shutterlake.plans.transfer import execute, transfer_plan
from shutterlake.sources import files as fs
from shutterlake.sources.cache import ParquetCache, config_struct
from shutterlake.sources.images import image_frames
from shutterlake.sources.metadata import parse_header, read_metadata


def png(size, value):
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    rows = b"".join(b"\0" + bytes((value * (x + y)) % 256 for x in range(size)) for y in range(size))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", size, size, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def tree(tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "a.PNG").write_bytes(png(16, 3))
    (tmp_path / "in" / "sub" / "b.png").write_bytes(png(16, 3))
    (tmp_path / "in" / "bad.jpg").write_bytes(b"\xff\xd8\xff\xe1\x00")
    (tmp_path / "in" / "note.txt").write_text("no")
    (tmp_path / "in" / "big.mp4").write_bytes(b"x" * 100 + b"y" * 100)
    return tmp_path / "in"


def test_scan_stats_and_frames(spark, tmp_path):
    root = tree(tmp_path)
    found = fs.scan(spark, [str(root)])
    assert sorted(r.ext for r in found.collect()) == ["jpg", "mp4", "png", "png"]
    stats = {r.path.rsplit("/", 1)[1]: r for r in fs.file_stats(found, 50).collect()}
    whole = spark.read.format("binaryFile").load([str(root), str(root / "sub")]).select("path", fs.content_hash("content", 50).alias("h"))
    seen = {r.path.rsplit("/", 1)[1]: r.h for r in whole.collect()}
    assert {k: v.content_hash for k, v in stats.items()} == {k: v for k, v in seen.items() if k in stats}
    assert stats["a.PNG"].content_hash == stats["b.png"].content_hash
    good, bad = fs.split_valid(fs.file_stats(spark.createDataFrame([("/none",)], "path string"), 50))
    assert (good.count(), bad.count()) == (0, 1)
    frames = {r.path.rsplit("/", 1)[1]: r for r in image_frames(spark, str(root), 16).collect()}
    assert frames["a.PNG"].hash == frames["b.png"].hash is not None
    assert frames["bad.jpg"].error


def test_metadata(spark):
    exif_make = struct.pack("<2sHI", b"II", 42, 8) + struct.pack("<H", 2) + struct.pack("<HHII", 0x0110, 2, 4, int.from_bytes(b"Cam\0", "little")) + struct.pack("<HHII", 0x8769, 4, 1, 38) + struct.pack("<I", 0)
    exif = exif_make + struct.pack("<H", 1) + struct.pack("<HHII", 0x9003, 2, 20, 56) + struct.pack("<I", 0) + b"2020:02:03 04:05:06\0"
    app1 = b"Exif\0\0" + exif
    jpg = b"\xff\xd8\xff\xe1" + struct.pack(">H", len(app1) + 2) + app1 + b"\xff\xc0" + struct.pack(">HBHH", 11, 8, 30, 40) + b"\0" * 8
    assert parse_header(jpg) == {"camera": "Cam", "date_original": "2020:02:03 04:05:06", "height": 30, "width": 40}
    mvhd = struct.pack(">IIIII", 0, 2082844800 + 86400, 0, 1000, 2500) + b"\0" * 80
    box = struct.pack(">I4s", len(mvhd) + 8, b"mvhd") + mvhd
    mp4 = struct.pack(">I4s", 8, b"ftyp") + struct.pack(">I4s", len(box) + 8, b"moov") + box
    rows = read_metadata(spark.createDataFrame([("j", jpg), ("m", mp4), ("p", png(16, 1)), ("x", b""), ("n", None), ("bad", b"\x89PNG\r\n\x1a\n")], "path string, content binary"))
    got = {r.path: r for r in rows.collect()}
    assert (got["j"].width, str(got["j"].image_date)) == (40, "2020-02-03 04:05:06")
    assert (got["m"].duration, str(got["m"].image_date)) == (2.5, "1970-01-02 00:00:00")
    assert (got["p"].width, got["x"].width, got["n"].width) == (16, 0, 0)
    assert got["bad"].error


def assigned(spark, root):
    rows = [(f"{root}/a.PNG", "unique", None, 1), (f"{root}/sub/b.png", "duplicate", f"{root}/a.PNG", 2), (f"{root}/big.mp4", "representative", f"{root}/big.mp4", 2)]
    df = spark.createDataFrame(rows, "path string, role string, best_path string, cluster_size int")
    return df.select("*", F.lit("c").alias("cluster_id"), F.lit(1).alias("rank"), F.lit(1.0).alias("score"), F.lit(9).cast("long").alias("size"), F.lit(0).alias("width"), F.lit(0).alias("height"), F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lon"), F.lit(None).cast("string").alias("camera"), F.lit(0.0).alias("duration"), F.lit(None).cast("timestamp").alias("image_date"), F.lit("2020-01-02").cast("timestamp").alias("created_at"))


def test_transfer(spark, tmp_path):
    root = tree(tmp_path)
    plan = transfer_plan(assigned(spark, root), str(tmp_path / "out"), Params(), str(tmp_path / "dup"))
    assert execute(plan).where("error is not null").count() == 0
    assert not (tmp_path / "out").exists()
    for _ in range(2):  # the second finds its work done
        assert execute(plan, dry_run=False).where("error is not null").count() == 0
    assert (tmp_path / "out/2020/01/02/a.png").exists() and (tmp_path / "out/2020/01/02/big.mp4").exists()
    assert (tmp_path / "dup/a/b.png").exists()
    quiet = transfer_plan(assigned(spark, root), "/t", Params(skip_representatives=True), "/d")
    assert {r.kind for r in quiet.collect()} == {"unique", "duplicate"}


def test_files_of_one_name_are_all_kept(spark, tmp_path):
    texts = {"a": "AAAA", "b": "BBBB", "c": "CC"}
    for d, t in texts.items():
        (tmp_path / d).mkdir()
        (tmp_path / d / "IMG.jpg").write_text(t)
    (tmp_path / "dup" / "best").mkdir(parents=True)
    (tmp_path / "dup" / "best" / "IMG.jpg").write_text("OLD!")
    base = assigned(spark, str(tmp_path)).limit(1).drop("path", "role", "best_path")
    rows = spark.createDataFrame([(f"{tmp_path}/{d}/IMG.jpg", "duplicate", "/x/best.jpg") for d in texts], "path string, role string, best_path string").crossJoin(base)
    failed = spark.createDataFrame([(f"{tmp_path}/{d}/IMG.jpg",) for d in texts], "path string")
    existing = spark.createDataFrame([(f"{tmp_path}/dup/best/IMG.jpg",)], "dst string")
    blind = transfer_plan(rows, "/t", Params(), str(tmp_path / "dup"), move=True)
    assert blind.select("dst").distinct().count() == 3
    done = {r.src: r.error for r in execute(blind, dry_run=False).collect()}
    assert "another file" in done[f"{tmp_path}/a/IMG.jpg"] and (tmp_path / "a" / "IMG.jpg").read_text() == "AAAA"
    plan = transfer_plan(rows, "/t", Params(), str(tmp_path / "dup"), move=True, existing=existing)
    assert plan.select("dst").distinct().count() == 3
    for _ in range(2):  # a repeated task finds its work done
        assert execute(plan, dry_run=False).where("error is not null").count() == 0
    kept = sorted(f.read_text() for f in (tmp_path / "dup" / "best").iterdir())
    assert kept == ["AAAA", "BBBB", "CC", "OLD!"] and not any((tmp_path / d / "IMG.jpg").exists() for d in texts)
    assert transfer_plan(rows.limit(0), "/t", Params(), "/d", "/e", failed).select("dst").distinct().count() == 3


def test_relative_path(spark):
    from shutterlake.functions.paths import relative_path

    df = spark.createDataFrame([("/a/b/c.jpg",), ("/a/x/c.jpg",), ("/q.jpg",), ("/a/b/d/e\\f.jpg",)], "p string")
    assert [r[0] for r in df.select(relative_path(F.col("p"), "/a/b/")).collect()] == ["c.jpg", "../x/c.jpg", "../../q.jpg", "d/e/f.jpg"]


def test_reports(spark, tmp_path):
    names = write_reports(assigned(spark, "/r"), str(tmp_path / "rep"), batch=1)
    assert names == ["report_1.html"]
    assert "big.mp4" in (tmp_path / "rep" / "report_1.html").read_text()


def test_cache(spark, tmp_path):
    calls = []

    def compute(keys):
        calls.append(sorted(r[0] for r in keys.collect()))
        return keys.withColumn("value", F.length("content_hash"))

    cache, config = ParquetCache(spark, str(tmp_path / "cache")), config_struct(64, 0.05, 5, 100, 2.0)
    keys = lambda *x: spark.createDataFrame([(k,) for k in x], "content_hash string")
    assert cache.through(keys("a", "bb", "a"), compute, config).count() == 2
    assert cache.through(keys("a", "ccc"), compute, config).count() == 2
    assert cache.through(keys("a"), compute, config_struct(32, 0.05, 5, 100, 2.0)).count() == 1
    assert calls == [["a", "bb"], ["ccc"], ["a"]]


def test_stream(spark, tmp_path):
    from shutterlake.streaming.ingest import ingest, watch

    root = tree(tmp_path)
    for _ in range(2):
        ingest(watch(spark, str(root), 50), str(tmp_path / "t"), str(tmp_path / "cp")).awaitTermination()
        assert spark.read.parquet(str(tmp_path / "t")).count() == 4
