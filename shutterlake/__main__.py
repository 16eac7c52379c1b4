"""python -m shutterlake SOURCE... DESTINATION: sorts media files into folders and sets duplicates apart."""

from __future__ import annotations

import argparse

from shutterlake.config import Params

#: Option, field of Params, and what it means.
NUMBERS = [
    ("--resolution", "resolution", int, "side of the grey square that is hashed"),
    ("--min-frames", "min_frames", int, "frames of a video at least"),
    ("--max-scene-frames", "max_scene_frames", int, "frames of a video that are kept without reduction"),
    ("--target-fps", "target_fps", float, "frames a second that are aimed at"),
    ("--step-size", "step_size", float, "seconds between windows of a longer video"),
    ("--scene-change-threshold", "scene_threshold", float, "scene score that makes a frame a candidate"),
    ("--image-similarity-threshold", "image_similarity", float, "likeness of duplicate images"),
    ("--image-video-similarity-threshold", "image_video_similarity", float, "likeness of an image and a video"),
    ("--video-similarity-threshold", "video_similarity", float, "likeness of duplicate videos"),
    ("--max-chunk-size", "max_chunk", int, "bytes above which only both ends of a file are hashed"),
]
SHORT = {"--resolution": "-r", "--step-size": "-p"}


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="shutterlake", description=__doc__, formatter_class=argparse.ArgumentDefaultsHelpFormatter)
    out.add_argument("sources", nargs="+", metavar="source", help="folders to read")
    out.add_argument("destination", help="folder for the sorted files")
    out.add_argument("-e", "--error", help="folder for files that cannot be read")
    out.add_argument("-d", "--duplicate", help="folder for duplicates")
    out.add_argument("--debug", help="folder for reports of duplicate sets; its files are removed first")
    out.add_argument("-c", "--concurrency", type=int, help="tasks at a time on one machine (all cores but one)")
    out.add_argument("-m", "--move", action="store_true", help="move files instead of copying them")
    out.add_argument("-n", "--dry-run", action="store_true", help="show the plan, transfer nothing")
    out.add_argument("-w", "--window-size", type=int, default=5, help="accepted and not used: windows are as long as the shorter video")
    out.add_argument("-F", "--format", default=Params.path_format, help="template of paths below the destination")
    for name, field, kind, text in NUMBERS:
        out.add_argument(*filter(None, [SHORT.get(name), name]), dest=field, type=kind, default=getattr(Params, field), help=text)
    return out


def main(argv: list[str] | None = None) -> None:
    import os

    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from shutterlake.plans.organize import organize
    from shutterlake.session import local_session

    o = parser().parse_args(argv)
    p = Params(path_format=o.format, **{field: getattr(o, field) for _, field, _, _ in NUMBERS})
    spark = SparkSession.getActiveSession() or local_session(str(o.concurrency or max(1, (os.cpu_count() or 2) - 1)))
    full = lambda x: os.path.abspath(x) if x else None
    out = organize(spark, [full(s) for s in o.sources], full(o.destination), full(o.duplicate), full(o.error), full(o.debug), o.move, p, dry_run=o.dry_run)
    for name, table in (("Formats", out.formats.orderBy("ext")), ("Folders that could not be read", out.unread), ("Summary", out.summary), ("Transfers", out.done.groupBy("kind", "action").agg(F.count("*").alias("files"), F.count("error").alias("errors")).orderBy("kind"))):
        print(name)
        table.show(1000, truncate=False)


if __name__ == "__main__":
    main()
