"""Metadata from file headers, without native tools: JPEG, TIFF and the raw formats built on it (EXIF), PNG, GIF, BMP, WebP, HEIF (size), MP4/MOV."""

from __future__ import annotations

import datetime as dt
import os
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shutterlake.functions.text import coerce_date
from shutterlake.sources.files import local_path

FIELDS = "width int, height int, lat double, lon double, camera string, date_original string, date_created string, duration double, error string"
#: Seconds between the epoch of MP4 times, 1904, and that of Unix.
MP4_EPOCH = 2082844800


def _exif(data: bytes, sized: bool = False) -> dict:
    order = {b"II": "<", b"MM": ">"}[data[:2]]
    out: dict = {}

    def entries(at: int) -> dict:
        n = struct.unpack_from(order + "H", data, at)[0]
        return {struct.unpack_from(order + "H", data, at + 2 + 12 * i)[0]: at + 2 + 12 * i for i in range(n)}

    def value(at: int):
        kind, n = struct.unpack_from(order + "HI", data, at + 2)
        size = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}.get(kind, 1) * n
        pos = at + 8 if size <= 4 else struct.unpack_from(order + "I", data, at + 8)[0]
        if kind == 2:
            return data[pos : pos + n].split(b"\0")[0].decode("latin-1").strip()
        if kind in (3, 4):
            return struct.unpack_from(order + ("H" if kind == 3 else "I"), data, pos)[0]
        if kind == 5:
            return [a / b if b else 0.0 for a, b in struct.iter_unpack(order + "II", data[pos : pos + 8 * n])]
        return None

    first = entries(struct.unpack_from(order + "I", data, 4)[0])
    if sized and 0x0100 in first and 0x0101 in first:
        out["width"], out["height"] = value(first[0x0100]), value(first[0x0101])
    if 0x0110 in first:
        out["camera"] = value(first[0x0110]) or None
    if 0x8769 in first:
        sub = entries(value(first[0x8769]))
        if 0x9003 in sub:
            out["date_original"] = value(sub[0x9003])
    if 0x8825 in first:
        gps = entries(value(first[0x8825]))
        for name, ref, tag in (("lat", 1, 2), ("lon", 3, 4)):
            if tag in gps:
                d, m, s = (value(gps[tag]) + [0.0, 0.0])[:3]
                out[name] = (d + m / 60 + s / 3600) * (-1 if ref in gps and value(gps[ref]) in ("S", "W") else 1)
    return out


def _jpeg(b: bytes) -> dict:
    out: dict = {}
    at = 2
    while at + 4 <= len(b) and b[at] == 0xFF:
        kind, size = b[at + 1], struct.unpack_from(">H", b, at + 2)[0]
        if kind == 0xE1 and b[at + 4 : at + 10] == b"Exif\0\0":
            out |= _exif(b[at + 10 : at + 2 + size])
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            out["height"], out["width"] = struct.unpack_from(">HH", b, at + 5)
            return out
        at += 2 + size
    return out


def _webp(b: bytes) -> dict:
    kind, p = b[12:16], 20
    if kind == b"VP8X":
        out = {"width": 1 + int.from_bytes(b[p + 4 : p + 7], "little"), "height": 1 + int.from_bytes(b[p + 7 : p + 10], "little")}
        at = 12
        while at + 8 <= len(b):
            name, size = b[at : at + 4], struct.unpack_from("<I", b, at + 4)[0]
            if name == b"EXIF":
                body = b[at + 8 : at + 8 + size]
                out = _exif(body.removeprefix(b"Exif\0\0")) | out
            at += 8 + size + size % 2
        return out
    if kind == b"VP8L":
        bits = struct.unpack_from("<I", b, p + 1)[0]
        return {"width": 1 + (bits & 0x3FFF), "height": 1 + (bits >> 14 & 0x3FFF)}
    w, h = struct.unpack_from("<HH", b, p + 6)
    return {"width": w & 0x3FFF, "height": h & 0x3FFF}


def _mp4(b: bytes) -> dict:
    out: dict = {}

    def boxes(lo: int, hi: int) -> None:
        while lo + 8 <= hi:
            size, kind = struct.unpack_from(">I", b, lo)[0], b[lo + 4 : lo + 8]
            head = 8
            if size == 1 and lo + 16 <= hi:
                size, head = struct.unpack_from(">Q", b, lo + 8)[0], 16
            size = size or hi - lo
            end = min(hi, lo + size)
            if size < head:
                return
            if kind in (b"moov", b"trak", b"iprp", b"ipco"):
                boxes(lo + head, end)
            elif kind == b"meta":  # a box with a version
                boxes(lo + head + 4, end)
            elif kind == b"ispe" and end <= len(b):  # the largest picture is the main one
                w, h = struct.unpack_from(">II", b, lo + head + 4)
                if w * h > out.get("width", 0) * out.get("height", 0):
                    out["width"], out["height"] = w, h
            elif kind == b"mvhd" and lo + head + 32 <= len(b):
                p = lo + head
                made, scale, length = struct.unpack_from(">IxxxxII", b, p + 4) if b[p] == 0 else struct.unpack_from(">QxxxxxxxxIQ", b, p + 4)
                out["duration"] = length / scale if scale else 0.0
                if made > MP4_EPOCH:
                    out["date_created"] = dt.datetime.fromtimestamp(made - MP4_EPOCH, dt.timezone.utc).strftime("%Y-%m-%d %H:%M:%S")
            elif kind == b"tkhd" and end <= len(b):
                w, h = struct.unpack_from(">II", b, end - 8)
                if w >> 16:
                    out["width"], out["height"] = w >> 16, h >> 16
            lo = end

    boxes(0, len(b))
    return out


def parse_header(b: bytes) -> dict:
    """What a file's header says; raises ValueError for a damaged one of a known kind."""
    try:
        if b[:3] == b"\xff\xd8\xff":
            return _jpeg(b)
        if b[:8] == b"\x89PNG\r\n\x1a\n":
            return dict(zip(("width", "height"), struct.unpack_from(">II", b, 16), strict=True))
        if b[:4] == b"GIF8":
            return dict(zip(("width", "height"), struct.unpack_from("<HH", b, 6), strict=True))
        if b[4:8] == b"ftyp":
            return _mp4(b)
        if b[:4] in (b"II*\0", b"MM\0*"):
            return _exif(b, sized=True)
        if b[:4] == b"RIFF" and b[8:12] == b"WEBP":
            return _webp(b)
        if b[:2] == b"BM" and len(b) >= 26:
            w, h = struct.unpack_from("<ii", b, 18)
            return {"width": abs(w), "height": abs(h)}
    except (struct.error, KeyError, IndexError, TypeError) as e:
        raise ValueError(f"damaged header: {e}") from e
    return {}


#: Bytes read of a file's start; boxes of MP4 files are looked for by seeking.
HEAD = 1 << 20


def read_head(path: str) -> bytes:
    """What parse_header needs of a file: its first bytes, or the boxes of an MP4 file without its media."""
    with open(local_path(path), "rb") as f:
        b = f.read(HEAD)
        if b[4:8] != b"ftyp":
            return b
        out, at, end = b"", 0, f.seek(0, os.SEEK_END)
        while at + 8 <= end:
            f.seek(at)
            head = f.read(16)
            size, kind = struct.unpack_from(">I", head)[0], head[4:8]
            if size == 1 and len(head) == 16:
                size = struct.unpack_from(">Q", head, 8)[0]
            size = size or end - at
            if size < 8:
                break
            if kind in (b"ftyp", b"moov", b"meta"):
                f.seek(at)
                out += f.read(size)
            at += size
        return out


def read_metadata(contents: DataFrame) -> DataFrame:
    """Of (path, content), or of (path) whose files every executor mounts: width and height (0 if unknown), lat, lon, camera, image_date, duration, error."""
    given = "content" in contents.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["width", "height", "lat", "lon", "camera", "date_original", "date_created", "duration", "error"]
        for pdf in batches:
            rows = []
            for x in pdf["content" if given else "path"]:
                try:
                    d = parse_header((bytes(x) if x is not None else b"") if given else read_head(x))
                except (ValueError, OSError) as e:
                    d = {"error": str(e)}
                rows.append([d.get("width", 0), d.get("height", 0), *(d.get(n) for n in names[2:7]), float(d.get("duration", 0.0)), d.get("error")])
            out = pd.DataFrame(rows, columns=names)
            out.insert(0, "path", pdf["path"].to_numpy())
            yield out

    raw = contents.select("path", *["content"] * given).mapInPandas(run, "path string, " + FIELDS)
    date = coerce_date(F.col("date_original"), F.col("date_created"))
    return raw.select("path", "width", "height", "lat", "lon", "camera", date.alias("image_date"), "duration", "error")
