"""Scanning file trees: listing, classification, statistics, content hashes."""

from __future__ import annotations

import datetime as dt
import hashlib
import os
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shutterlake.functions import formats
from shutterlake.session import spool


def scan(spark: SparkSession, folders: list[str], supported_only: bool = True) -> DataFrame:
    """path, size, modified_at, ext, file_type of the files below the folders, of any store; contents are not read. A folder that cannot be read fails the scan: see `walk`."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreMissingFiles", True).load(folders)
    return typed(found.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified_at")), supported_only)


def walk(spark: SparkSession, folders: list[str]) -> tuple[DataFrame, DataFrame]:
    """Files (path, size, modified_at) below folders that every executor mounts, and the folders that could not be read (path, error), which are passed over. Links to folders are not followed."""

    def one(folder: str) -> Iterator[tuple]:
        try:
            with os.scandir(local_path(folder)) as entries:
                for e in entries:
                    if e.is_dir(follow_symlinks=False):
                        yield "folder", e.path, None, None, None
                    elif e.is_file():
                        st = e.stat()
                        yield "file", e.path, st.st_size, dt.datetime.fromtimestamp(st.st_mtime, dt.timezone.utc).replace(tzinfo=None), None
        except OSError as x:
            yield "error", folder, None, None, str(x)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [r for f in pdf["path"] for r in one(f)]
            yield pd.DataFrame(rows, columns=["kind", "path", "size", "modified_at", "error"]).astype({"size": "Int64", "modified_at": "datetime64[us]"})

    level = spark.createDataFrame([(f,) for f in folders], "path string").distinct()
    found = None
    while not level.isEmpty():
        here = spool(level.repartition(spark.sparkContext.defaultParallelism, "path").mapInPandas(run, "kind string, path string, size long, modified_at timestamp, error string"))
        found = here if found is None else found.union(here)
        level = here.where("kind = 'folder'").select("path")
    if found is None:
        found = spark.createDataFrame([], "kind string, path string, size long, modified_at timestamp, error string")
    found = found.dropDuplicates(["path"])
    return found.where("kind = 'file'").select("path", "size", "modified_at"), found.where("kind = 'error'").select("path", "error")


def typed(files: DataFrame, supported_only: bool = True) -> DataFrame:
    """Adds ext and file_type; by default other files go."""
    out = files.withColumn("ext", formats.extension("path")).withColumn("file_type", formats.file_type(F.col("ext")))
    return out.where(formats.is_supported(F.col("ext"))) if supported_only else out


def content_hash(content: str | Column, max_chunk: int) -> Column:
    """MD5 of the content; of more than max_chunk bytes, of its first and last half chunk."""
    half = max_chunk // 2
    c = F.col(content) if isinstance(content, str) else content
    return F.when(F.octet_length(c) <= max_chunk, F.md5(c)).otherwise(F.md5(F.concat(F.substring(c, 1, half), F.substring(c, -half, half))))


def local_path(path: str) -> str:
    """A file: address as a path; a plain path is left alone, even with a percent sign in it."""
    parsed = urlparse(path)
    return unquote(parsed.path) if parsed.scheme == "file" else path


def file_stats(files: DataFrame, max_chunk: int) -> DataFrame:
    """path, content_hash, size, created_at, modified_at, error. Reads at most max_chunk bytes of a file, by seeking.

    For trees that every executor mounts. A birth time is used where the file
    system has one, else the time of modification. A file that cannot be read
    gives its error instead.
    """

    def one(path: str) -> tuple:
        try:
            p = local_path(path)
            st = os.stat(p)
            h = hashlib.md5()
            with open(p, "rb") as f:
                if st.st_size > max_chunk:
                    h.update(f.read(max_chunk // 2))
                    f.seek(-(max_chunk // 2), os.SEEK_END)
                h.update(f.read())
            utc = lambda t: dt.datetime.fromtimestamp(t, dt.timezone.utc).replace(tzinfo=None)
            return path, h.hexdigest(), st.st_size, utc(getattr(st, "st_birthtime", st.st_mtime)), utc(st.st_mtime), None
        except OSError as e:
            return path, None, None, None, None, str(e)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([one(p) for p in pdf["path"]], columns=["path", "content_hash", "size", "created_at", "modified_at", "error"])

    return files.select("path").mapInPandas(run, "path string, content_hash string, size long, created_at timestamp, modified_at timestamp, error string")


def split_valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows without and with an error."""
    return df.where("error is null").drop("error"), df.where("error is not null")
