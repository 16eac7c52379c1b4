"""A whole run: from folders of media files to a transfer plan, its execution, a summary and reports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shutterlake.config import Params
from shutterlake.plans.dedupe import deduplicate
from shutterlake.plans.reports import gather_stats, run_summary, write_reports
from shutterlake.plans.transfer import clear_folder, execute, transfer_plan
from shutterlake.session import ship, spool
from shutterlake.sources.files import file_stats, split_valid, typed, walk
from shutterlake.sources.images import file_info, image_frames, media_table, video_frames
from shutterlake.sources.metadata import read_metadata


@dataclass
class Outcome:
    """Tables of a run: per format statistics, files with roles, failed files, unread folders, the plan with errors, and one row of totals."""

    formats: DataFrame
    assigned: DataFrame
    failed: DataFrame
    unread: DataFrame
    done: DataFrame
    summary: DataFrame


def _plain(path: str) -> F.Column:
    """A file: address as the plain path that walk gives."""
    return F.regexp_replace(path, "^file:/+", "/")


def gather(spark: SparkSession, files: DataFrame, folders: list[str], p: Params = Params(), decoded: tuple[DataFrame, DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """Files with all that deduplication needs, and files that lack a part (with error).

    Headers and pictures are read once for each content. decoded: tables of
    video frames (path, pos, ts, scene) and (path, pos, pixels) of a decoder; a
    video without any is compared by its content alone.
    """
    stats, unread = split_valid(spool(file_stats(files, p.max_chunk)))
    stats = spool(stats.join(files.select("path", "ext", "file_type"), "path"))
    first = spool(stats.groupBy("content_hash").agg(F.min("path").alias("path"), F.min("file_type").alias("file_type")))
    by_content = first.select("content_hash", "path")
    headers, bad = split_valid(spool(read_metadata(first.select("path"))))
    pictures = image_frames(spark, folders, p.resolution) if folders else spark.createDataFrame([], "path string, hash long, error string")
    pictures = pictures.withColumn("path", _plain("path")).join(first.where("file_type = 'image'").select("path"), "path", "left_semi")
    pictures, blind = split_valid(spool(pictures))
    durations = headers.select("path", "duration").join(first.where("file_type = 'video'").select("path"), "path", "left_semi")
    rows = pictures.select("path", F.lit(0.0).alias("ts"), "hash")
    seen = None
    if decoded is not None:
        seen = spool(video_frames(*decoded, durations, p))
        rows = rows.unionByName(seen.select("path", F.col("ts").cast("double").alias("ts"), "hash"))
    alone = durations.join(by_content, "path")
    alone = alone if seen is None else alone.join(seen.select("path").distinct(), "path", "left_anti")
    rows = rows.unionByName(alone.select("path", F.lit(0.0).alias("ts"), F.xxhash64("content_hash").alias("hash")))
    media = media_table(rows, durations)
    of = lambda df: df.join(by_content, "path").drop("path").join(stats.select("path", "content_hash"), "content_hash").drop("content_hash")
    info = spool(file_info(stats, of(headers.drop("duration")), of(media)))
    causes = of(bad.select("path", "error").unionByName(blind.select("path", "error"))).groupBy("path").agg(F.min("error").alias("error"))
    lacking = stats.select("path").join(info.select("path"), "path", "left_anti").join(causes, "path", "left")
    failed = unread.select("path", "error").unionByName(lacking.select("path", F.coalesce("error", F.lit("no frames")).alias("error")))
    return info, spool(failed)


def organize(
    spark: SparkSession,
    sources: list[str],
    destination: str,
    duplicates: str | None = None,
    errors: str | None = None,
    debug: str | None = None,
    move: bool = False,
    p: Params = Params(),
    decoded: tuple[DataFrame, DataFrame] | None = None,
    dry_run: bool = True,
) -> Outcome:
    """Everything from sources to destination. The folders are mounted by the driver and every executor; nothing is written but reports if dry_run is on."""
    ship(spark)
    found, unread = walk(spark, sources)
    files = spool(typed(found))
    gone = {r[0] for r in unread.where(F.col("path").isin(*sources)).select("path").collect()}
    info, failed = gather(spark, files, [s for s in sources if s not in gone], p, decoded)
    assigned = spool(deduplicate(info, p))
    there, _ = walk(spark, sorted({x for x in (destination, duplicates, errors) if x}))
    plan = spool(transfer_plan(assigned, destination, p, duplicates, errors, failed, move, there.select(F.col("path").alias("dst"))))
    if debug:
        clear_folder(debug)
        write_reports(assigned, debug)
    done = spool(execute(plan, dry_run))
    every = info.withColumn("error", F.lit(None).cast("string")).unionByName(failed.join(files.select("path", "ext"), "path"), allowMissingColumns=True)
    return Outcome(gather_stats(every), assigned, failed, unread, done, run_summary(assigned, failed))
