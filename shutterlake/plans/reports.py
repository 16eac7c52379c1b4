"""Statistics, summaries and HTML reports."""

from __future__ import annotations

import html
import os

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shutterlake.functions import formats, text
from shutterlake.functions.paths import has_geo, relative_path
from shutterlake.session import spool

BATCH = 1000


def format_histogram(files: DataFrame) -> DataFrame:
    """ext, files; and a row of null ext with the total."""
    return files.rollup("ext").agg(F.count("*").alias("files"))


def format_order(files: DataFrame) -> DataFrame:
    """ext, file_type, files, place: videos first, then by number of files, then by name."""
    n = files.groupBy("ext", "file_type").agg(F.count("*").alias("files"))
    w = W.orderBy(formats.type_order(F.col("file_type")), F.col("files").desc(), "ext")  # a row per format
    return n.withColumn("place", F.row_number().over(w))


def gather_stats(files: DataFrame) -> DataFrame:
    """Per format: files with a place, a date, a camera, and in error."""
    return files.groupBy("ext").agg(
        F.count("*").alias("files"),
        F.count_if(has_geo() & F.col("error").isNull()).alias("with_geo"),
        F.count_if(F.col("image_date").isNotNull() & F.col("error").isNull()).alias("with_date"),
        F.count_if((F.coalesce(F.length("camera"), F.lit(0)) > 0) & F.col("error").isNull()).alias("with_camera"),
        F.count_if(F.col("error").isNotNull()).alias("errors"),
    )


def run_summary(assigned: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """One row: files, unique files, duplicate sets, representatives, duplicates, errors."""
    one = assigned.agg(
        F.count("*").alias("files"),
        F.count_if(F.col("role") == "unique").alias("unique_files"),
        F.count_if((F.col("rank") == 1) & (F.col("cluster_size") > 1)).alias("duplicate_sets"),
        F.count_if(F.col("role") == "representative").alias("representatives"),
        F.count_if(F.col("role") == "duplicate").alias("duplicates"),
    )
    bad = errors.agg(F.count("*").alias("errors")) if errors is not None else assigned.sparkSession.range(1).select(F.lit(0).cast("long").alias("errors"))
    return one.crossJoin(bad)  # one row each


def report_batches(sets: DataFrame, batch: int = BATCH) -> DataFrame:
    """batch, sets, representatives, duplicates of the reports; sets are numbered by best path."""
    # places across partitions: sorted once, and numbered from where each partition begins
    part = spool(sets.select("best_path", "representatives", "duplicates").orderBy("best_path").withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()))
    begins = part.groupBy("part").agg(F.count("*").alias("n"), F.min("at").alias("least"))
    begins = begins.withColumn("before", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))  # a row a partition
    placed = part.join(F.broadcast(begins), "part").withColumn("batch", F.floor((F.col("before") + F.col("at") - F.col("least")) / batch).cast("long"))
    return placed.groupBy("batch").agg(F.count("*").alias("sets"), F.sum(F.size("representatives")).cast("long").alias("representatives"), F.sum(F.size("duplicates")).cast("long").alias("duplicates"))


def report_items(assigned: DataFrame, folder: str) -> DataFrame:
    """cluster_id, place, and the HTML of every file of a duplicate set, best first."""
    esc = lambda c: F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    src = esc(relative_path(F.col("path"), folder))
    line = lambda name, value, when: F.when(when, F.concat(F.lit(f"<li>{name}: "), value, F.lit("</li>"))).otherwise("")
    area = (F.col("width") != 0) & (F.col("height") != 0)
    body = F.concat(
        F.when(formats.plays_as_video("path"), F.concat(F.lit('<video controls src="'), src, F.lit('"></video>'))).otherwise(F.concat(F.lit('<img loading="lazy" src="'), src, F.lit('">'))),
        F.lit("<ul>"),
        line("Role", F.col("role"), F.lit(True)),
        line("Score", text.to_fixed2(F.col("score")), F.lit(True)),
        line("Size", text.megabytes(F.col("size")), F.lit(True)),
        line("Resolution", F.concat_ws("x", F.col("width"), F.col("height")), F.coalesce(area, F.lit(False))),
        line("Duration", text.short_duration(F.col("duration")), F.col("duration") > 0),
        line("Date", text.day(F.col("image_date")), F.col("image_date").isNotNull()),
        line("Place", F.concat_ws(", ", text.to_fixed2(F.col("lat")), text.to_fixed2(F.col("lon"))), has_geo()),
        line("Camera", esc(F.col("camera")), F.coalesce(F.length("camera"), F.lit(0)) > 0),
        F.lit("</ul>"),
    )
    return assigned.where("cluster_size > 1").select("cluster_id", "best_path", "rank", "role", body.alias("html"))


def write_reports(assigned: DataFrame, folder: str, batch: int = BATCH) -> list[str]:
    """Report files of `batch` sets each and an index, written by the driver as sets arrive in order; names returned."""
    os.makedirs(folder, exist_ok=True)
    items = report_items(assigned, folder).orderBy("best_path", "cluster_id", "rank")
    names: list[str] = []
    totals: list[list[int]] = []
    out, now, n = None, None, 0
    for r in items.toLocalIterator():
        if r["cluster_id"] != now:
            now = r["cluster_id"]
            if n % batch == 0:
                if out:
                    out.write(f"<p>Sets: {totals[-1][0]}, representatives: {totals[-1][1]}, duplicates: {totals[-1][2]}</p></body></html>")
                    out.close()
                names.append(f"report_{n // batch + 1}.html")
                totals.append([0, 0, 0])
                out = open(os.path.join(folder, names[-1]), "w", encoding="utf-8")  # noqa: SIM115
                out.write("<!doctype html><html><head><meta charset='utf-8'><title>Duplicate sets</title></head><body>")
            n += 1
            totals[-1][0] += 1
            out.write(f"<h2>{html.escape(r['best_path'])}</h2>")
        totals[-1][1 if r["role"] == "representative" else 2] += 1
        out.write(r["html"])
    if out:
        out.write(f"<p>Sets: {totals[-1][0]}, representatives: {totals[-1][1]}, duplicates: {totals[-1][2]}</p></body></html>")
        out.close()
    with open(os.path.join(folder, "index.html"), "w", encoding="utf-8") as f:
        f.write("<!doctype html><html><body><ul>" + "".join(f'<li><a href="{x}">{x}</a></li>' for x in names) + "</ul></body></html>")
    return names
