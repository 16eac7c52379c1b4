"""File formats: which extensions are images and videos, and functions of paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The extensions that count as images and as videos.
IMAGE_EXTENSIONS = ["jpg", "jpeg", "jpe", "jif", "jfif", "jfi", "jp2", "j2c", "jpf", "jpx", "jpm", "mj2", "png", "webp", "tif", "tiff", "bmp", "dib", "heic", "heif", "avif", "cr2", "cr3", "nef", "nrw", "arw", "srf", "sr2", "dng", "orf", "ptx", "pef", "rw2", "raf", "raw", "x3f", "srw"]
VIDEO_EXTENSIONS = ["mp4", "m4v", "mov", "3gp", "3g2", "avi", "mpg", "mpeg", "mpe", "mpv", "m2v", "m2p", "m2ts", "mts", "ts", "qt", "wmv", "asf", "flv", "f4v", "webm", "divx", "gif"]
#: Fixed value: what a report plays as video.
REPORT_VIDEO = r"(?i)\.(mp4|mov|avi|wmv|flv|mkv)$"


def basename(path: str | Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: str | Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def raw_extension(path: str | Column) -> Column:
    """The extension as written, without its dot; a name that starts with its only dot has none."""
    return F.regexp_extract(basename(path), r"^.+\.([^.]*)$", 1)


def extension(path: str | Column) -> Column:
    return F.lower(raw_extension(path))


def stem(path: str | Column) -> Column:
    b = basename(path)
    return F.when(b.rlike(r"^.+\.[^.]*$"), F.regexp_extract(b, r"^(.+)\.[^.]*$", 1)).otherwise(b)


def is_supported(ext: Column) -> Column:
    return ext.isin(*IMAGE_EXTENSIONS, *VIDEO_EXTENSIONS)


def file_type(ext: Column, strict: bool = False) -> Column:
    """'image' or 'video'; of others null, or an error if strict."""
    other = F.raise_error(F.concat(F.lit("neither an image nor a video: "), ext)).cast("string") if strict else F.lit(None).cast("string")
    return F.when(ext.isin(*IMAGE_EXTENSIONS), "image").when(ext.isin(*VIDEO_EXTENSIONS), "video").otherwise(other)


def type_order(kind: Column) -> Column:
    """Videos come before images."""
    return F.when(kind == "video", 0).otherwise(1)


def plays_as_video(path: str | Column) -> Column:
    return (F.col(path) if isinstance(path, str) else path).rlike(REPORT_VIDEO)
