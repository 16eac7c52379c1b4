"""From a made tree through to an executed plan."""

import struct

import numpy as np
from pyspark.sql import functions as F
from test_files import png, tree

from shutterlake.__main__ import main, parser
from shutterlake.config import Params
from shutterlake.functions.frames import cap, reduce_list
from shutterlake.plans.organize import organize
from shutterlake.sources.cache import ParquetCache, config_struct
from shutterlake.sources.files import walk
from shutterlake.sources.images import video_frames
from shutterlake.sources.metadata import parse_header


def mp4(seconds, extra=b""):
    mvhd = struct.pack(">IIIII", 0, 2082844800 + 86400 * 400, 0, 1000, seconds * 1000) + b"\0" * 80
    box = struct.pack(">I4s", len(mvhd) + 8, b"mvhd") + mvhd
    free = struct.pack(">I4s", 8 + len(extra), b"mdat") + extra
    return struct.pack(">I4s", 8, b"ftyp") + free + struct.pack(">I4s", len(box) + 8, b"moov") + box


def test_a_run_from_a_folder(spark, tmp_path):
    root = tree(tmp_path)  # a.PNG, sub/b.png of the same bytes, bad.jpg, note.txt, big.mp4 (no header)
    (root / "other.png").write_bytes(png(16, 7))
    for name, extra in (("v1.mp4", b"x" * 50), ("v2.mp4", b"x" * 50), ("v3.mp4", b"y" * 50)):
        (root / "sub" / name).write_bytes(mp4(9, extra))
    args = (spark, [str(root)], str(tmp_path / "out"), str(tmp_path / "dup"), str(tmp_path / "err"), str(tmp_path / "rep"))
    dry = organize(*args)
    assert not (tmp_path / "out").exists() and (tmp_path / "rep" / "index.html").exists()
    roles = {r.path.rsplit("/", 1)[1]: r.role for r in dry.assigned.collect()}
    assert roles == {"a.PNG": "representative", "b.png": "duplicate", "other.png": "unique", "v1.mp4": "representative", "v2.mp4": "duplicate", "v3.mp4": "unique", "big.mp4": "unique"}
    assert [r.path.rsplit("/", 1)[1] for r in dry.failed.collect()] == ["bad.jpg"]
    stats = {r.ext: tuple(r)[1:] for r in dry.formats.collect()}
    assert stats == {"png": (3, 0, 0, 0, 0), "jpg": (1, 0, 0, 0, 1), "mp4": (4, 0, 3, 0, 0)}
    assert tuple(dry.summary.first()) == (7, 3, 2, 2, 2, 1)
    done = organize(*args, move=True, p=Params(path_format="{TYPE}/{NAME}.{EXT}"), dry_run=False).done
    assert done.where("error is not null").count() == 0
    left = sorted(f.name for f in root.rglob("*") if f.is_file())
    assert left == ["note.txt"]
    names = sorted(str(f.relative_to(tmp_path)) for d in ("out", "dup", "err") for f in (tmp_path / d).rglob("*") if f.is_file())
    assert names == ["dup/a/b.png", "dup/v1/v2.mp4", "err/bad.jpg", "out/Image/a.png", "out/Image/big.mp4", "out/Image/other.png", "out/Video/v1.mp4", "out/Video/v3.mp4"]
    (root / "a.PNG").write_bytes(png(16, 9))  # another file of a name that is there already
    again = organize(*args, p=Params(path_format="{TYPE}/{NAME}.{EXT}"), dry_run=False)
    assert again.done.where("error is not null").count() == 0
    assert len(list((tmp_path / "out" / "Image").glob("a*.png"))) == 2


def test_nothing_to_do(spark, tmp_path):
    (tmp_path / "in").mkdir()
    out = organize(spark, [str(tmp_path / "in"), str(tmp_path / "none")], str(tmp_path / "out"))
    assert out.done.count() == 0 and tuple(out.summary.first())[0] == 0
    assert [r.path for r in out.unread.collect()] == [str(tmp_path / "none")]
    files, bad = walk(spark, [])
    assert files.count() == bad.count() == 0


def test_command_line(spark, tmp_path, capsys):
    o = parser().parse_args(["a", "b", "c", "-m", "--target-fps", "3", "-r", "32"])
    assert (o.sources, o.destination, o.move, o.target_fps, o.resolution) == (["a", "b"], "c", True, 3.0, 32)
    root = tree(tmp_path)
    main([str(root), str(tmp_path / "out"), "-e", str(tmp_path / "err"), "--dry-run"])
    assert "unique" in capsys.readouterr().out and not (tmp_path / "out").exists()


def test_video_frames_are_selected_and_capped(spark):
    p, rng = Params(resolution=8, target_fps=1.0, min_frames=2, max_scene_frames=6, scene_threshold=0.5), np.random.default_rng(1)
    scenes, rows, pixels = {}, [], []
    for path, n in (("v", 40), ("w", 3)):
        scenes[path] = [(i / 2, float(x)) for i, x in enumerate(rng.random(n))]
        rows += [(path, i, t, x) for i, (t, x) in enumerate(scenes[path])]
        pixels += [(path, i, rng.integers(0, 256, 64, dtype=np.uint8).tobytes()) for i in range(n)]
    times, buffers = spark.createDataFrame(rows, "path string, pos int, ts double, scene double"), spark.createDataFrame(pixels, "path string, pos int, pixels binary")
    durations = spark.createDataFrame([("v", 19.5), ("w", 1.0)], "path string, duration double")
    got = {}
    for r in video_frames(times, buffers, durations, p).collect():
        got.setdefault(r.path, []).append(r.ts)
    for path, duration in (("v", 19.5), ("w", 1.0)):
        target = int(np.ceil(duration))
        interval, kept, last = duration / min(target, 2), [], None
        for t, x in scenes[path]:
            if last is None or (x > 0.5 and t - last >= 1) or t - last >= interval:
                kept.append(t)
                last = t
        if len(kept) > target and len(kept) > 6:
            kept = [kept[i] for i in reduce_list(len(kept), max(target, 6))]
        assert sorted(got[path]) == kept
    many = spark.createDataFrame([([float(i) for i in range(20)],)], "f array<double>")
    assert len(many.select(cap("f", F.lit(5), 8)).first()[0]) in (8, 9)


def test_headers_of_more_formats():
    tiff = struct.pack("<2sHI", b"II", 42, 8) + struct.pack("<H", 3) + struct.pack("<HHIHH", 0x0100, 3, 1, 640, 0) + struct.pack("<HHII", 0x0101, 4, 1, 480) + struct.pack("<HHII", 0x0110, 2, 4, int.from_bytes(b"Raw\0", "little")) + struct.pack("<I", 0)
    assert parse_header(tiff) == {"width": 640, "height": 480, "camera": "Raw"}
    webp = b"RIFF" + struct.pack("<I", 30) + b"WEBPVP8X" + struct.pack("<I", 10) + b"\0\0\0\0" + (99).to_bytes(3, "little") + (49).to_bytes(3, "little")
    assert parse_header(webp) == {"width": 100, "height": 50}
    bmp = b"BM" + b"\0" * 16 + struct.pack("<ii", 7, -9) + b"\0" * 8
    assert parse_header(bmp) == {"width": 7, "height": 9}
    box = lambda k, d: struct.pack(">I4s", 8 + len(d), k) + d
    heic = box(b"ftyp", b"heic") + box(b"meta", b"\0" * 4 + box(b"iprp", box(b"ipco", box(b"ispe", struct.pack(">III", 0, 160, 120)) + box(b"ispe", struct.pack(">III", 0, 4000, 3000)))))
    assert parse_header(heic) == {"width": 4000, "height": 3000}


def test_cache_of_images_and_its_export(spark, tmp_path):
    calls = []

    def compute(keys):
        calls.append(sorted(r[0] for r in keys.collect()))
        return keys.withColumn("value", F.length("content_hash"))

    cache = ParquetCache(spark, str(tmp_path / "cache"))
    keys = spark.createDataFrame([("a", True), ("bb", False)], "content_hash string, is_image boolean")
    cache.through(keys, compute, config_struct(64, 0.05, 5, 100, 2.0), "is_image")
    got = cache.through(keys, compute, config_struct(64, 0.5, 5, 100, 2.0), "is_image")  # a setting of videos changed
    assert calls == [["a", "bb"], ["bb"]] and got.count() == 2
    cache.export(str(tmp_path / "copy"))
    other = ParquetCache(spark, str(tmp_path / "other"))
    for _ in range(2):
        other.load(str(tmp_path / "copy"))
    assert other.read().count() == 3
