"""Results kept as Parquet under a key and the configuration that made them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shutterlake.session import spool


def config_struct(resolution: int, scene_threshold: float, min_frames: int, max_scene_frames: int, target_fps: float) -> Column:
    return F.struct(F.lit(resolution).cast("int").alias("resolution"), F.lit(float(scene_threshold)).alias("scene_threshold"), F.lit(min_frames).cast("int").alias("min_frames"), F.lit(max_scene_frames).cast("int").alias("max_scene_frames"), F.lit(float(target_fps)).alias("target_fps"))


def config_matches(stored: Column, wanted: Column, is_image: Column) -> Column:
    """Equal configurations, or both missing; of images only the resolution counts."""
    whole = stored.eqNullSafe(wanted)
    return F.when(is_image & stored.isNotNull() & wanted.isNotNull(), stored["resolution"].eqNullSafe(wanted["resolution"])).otherwise(whole)


def hits(keys: DataFrame, cache: DataFrame, by: str, config: Column | None = None, is_image: Column | None = None) -> DataFrame:
    """keys that the cache holds under a matching configuration."""
    k, c = keys.alias("k"), cache.alias("c")
    on = F.col(f"k.{by}") == F.col(f"c.{by}")
    if config is not None:
        on = on & config_matches(F.col("c.config"), config, F.lit(False) if is_image is None else is_image)
    return k.join(c, on, "left_semi")


def misses(keys: DataFrame, cache: DataFrame, by: str, config: Column | None = None, is_image: Column | None = None) -> DataFrame:
    k, c = keys.alias("k"), cache.alias("c")
    on = F.col(f"k.{by}") == F.col(f"c.{by}")
    if config is not None:
        on = on & config_matches(F.col("c.config"), config, F.lit(False) if is_image is None else is_image)
    return k.join(c, on, "left_anti")


class ParquetCache:
    """A folder of (key, config, value columns); computes what is missing, once per distinct key."""

    def __init__(self, spark: SparkSession, path: str, by: str = "content_hash"):
        self.spark, self.path, self.by = spark, path, by

    def read(self) -> DataFrame | None:
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return self.spark.read.parquet(self.path) if fs.exists(hadoop) else None

    def through(self, keys: DataFrame, compute: Callable[[DataFrame], DataFrame], config: Column, is_image: str | None = None) -> DataFrame:
        """Values of the keys under the configuration: stored ones, and new ones, which are appended. Where the column is_image of the keys holds, only the resolution counts."""
        images = F.coalesce(F.col(is_image), F.lit(False)) if is_image else F.lit(False)
        wanted = spool(keys.groupBy(self.by).agg(F.max(images).alias("_image")))
        stored = self.read()
        new = wanted if stored is None else misses(wanted, stored, self.by, config, F.col("k._image"))
        compute(new.select(self.by)).withColumn("config", config).write.mode("append").option("compression", "zstd").parquet(self.path)
        found = self.read().alias("c").join(wanted.alias("k"), self.by).where(config_matches(F.col("c.config"), config, F.col("k._image")))
        return found.drop("_image").dropDuplicates([self.by])

    def export(self, path: str) -> None:
        """A copy of all that is stored, for `load` of another cache."""
        stored = self.read()
        if stored is not None:
            stored.write.mode("overwrite").option("compression", "zstd").parquet(path)

    def load(self, path: str) -> None:
        """Adds what an export holds and this cache does not."""
        given, stored = self.spark.read.parquet(path), self.read()
        if stored is not None:
            k, c = given.alias("k"), stored.alias("c")
            given = spool(k.join(c, (F.col(f"k.{self.by}") == F.col(f"c.{self.by}")) & F.col("k.config").eqNullSafe(F.col("c.config")), "left_anti"))
        given.write.mode("append").option("compression", "zstd").parquet(self.path)
