"""Scores of files, and the roles of the files of a cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shutterlake.config import Params
from shutterlake.functions.paths import has_geo
from shutterlake.operators.components import connected_components
from shutterlake.operators.media import similarity_edges


def entry_score() -> Column:
    """Worth of a file over duration, image_date, lat, lon, camera, width, height, size."""
    positive = F.when(F.col("duration") > 0, 10000.0).otherwise(0.0)
    logs = F.ln(F.col("duration") + 1) * 100
    some = F.when(F.col("image_date").isNotNull(), 2000.0).otherwise(0.0) + F.when(has_geo(), 300.0).otherwise(0.0) + F.when(F.coalesce(F.length("camera"), F.lit(0)) > 0, 200.0).otherwise(0.0)
    area = F.when((F.col("width") != 0) & (F.col("height") != 0), F.sqrt(F.col("width").cast("double") * F.col("height"))).otherwise(0.0)
    size = F.when(F.col("size") == 0, F.lit(float("-inf"))).otherwise(F.ln("size") * 5)
    return positive + logs + some + F.coalesce(area, F.lit(0.0)) + size


def quality() -> Column:
    return F.col("width") * F.col("height")


def clusters(files: DataFrame, edges: DataFrame) -> DataFrame:
    """files with cluster_id (least path) and cluster_size; files without edges are clusters of their own.

    Density clustering with two points as the least and symmetric neighbours has
    no border points, so its clusters are the components of the edges.
    """
    comp = connected_components(edges, "a", "b")
    with_id = files.join(comp.withColumnRenamed("node", "path"), "path", "left").withColumn("cluster_id", F.coalesce("component", "path")).drop("component")
    sizes = with_id.groupBy("cluster_id").agg(F.count("*").alias("cluster_size"))
    return with_id.join(sizes, "cluster_id")


def merge_clusters(sets: DataFrame, element: str = "element", cluster: str = "cluster") -> DataFrame:
    """element, merged: clusters that share an element are one, named by its least element."""
    first = sets.groupBy(cluster).agg(F.min(element).alias("_first"))
    star = sets.join(first, cluster).select(F.col("_first").alias("u"), F.col(element).alias("v"))
    comp = connected_components(star)
    return sets.select(element).distinct().join(comp.withColumnRenamed("node", element), element, "left").select(element, F.coalesce("component", element).alias("merged"))


def ranked(clustered: DataFrame) -> DataFrame:
    """Adds score, rank in the cluster (ties by path) and the best file's path and traits."""
    w = W.partitionBy("cluster_id").orderBy(F.col("score").desc(), "path")
    best = F.first(F.struct("path", "duration", quality().alias("quality"), "image_date")).over(w)
    return clustered.withColumn("score", entry_score()).withColumn("rank", F.row_number().over(w)).withColumn("best", best)


def potential_captures(r: DataFrame) -> DataFrame:
    """Images of clusters whose best is a video, of no lower quality, dated if the video is."""
    fine = (F.col("duration") == 0) & (quality() >= F.col("best.quality")) & (F.col("best.image_date").isNull() | F.col("image_date").isNotNull())
    return r.where((F.col("cluster_size") > 1) & (F.col("best.duration") > 0) & fine)


def roles(clustered: DataFrame, p: Params = Params()) -> DataFrame:
    """Adds role: unique, representative or duplicate; and best_path.

    A cluster's best file represents it. If that is a video, so do its captures
    that resemble no other capture of the cluster; of those that do none does,
    or the best of each group if drop_like_captures is off.
    """
    r = ranked(clustered)
    caps = potential_captures(r)
    # captures are images; those of different clusters are never near each other
    like = connected_components(similarity_edges(caps.select("path", "duration", "frames"), p), "a", "b").withColumnRenamed("node", "path")
    groups = caps.join(like, "path", "left").select("path", "component", "score")
    if p.drop_like_captures:
        kept = groups.where("component is null").select("path")
    else:
        w = W.partitionBy(F.coalesce("component", "path")).orderBy(F.col("score").desc(), "path")
        kept = groups.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("path")
    kept = kept.withColumn("_capture", F.lit(True))
    role = F.when(F.col("cluster_size") == 1, "unique").when((F.col("rank") == 1) | F.col("_capture"), "representative").otherwise("duplicate")
    return r.join(kept, "path", "left").withColumn("role", role).withColumn("best_path", F.col("best.path")).drop("best", "_capture")


def duplicate_sets(assigned: DataFrame) -> DataFrame:
    """best_path, representatives and duplicates of each cluster of more than one file."""
    many = assigned.where("cluster_size > 1")
    pick = lambda role: F.sort_array(F.collect_set(F.when(F.col("role") == role, F.col("path"))))
    return many.groupBy("cluster_id").agg(F.min("best_path").alias("best_path"), pick("representative").alias("representatives"), pick("duplicate").alias("duplicates"))
