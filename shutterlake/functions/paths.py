"""Target paths from a template."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shutterlake.functions import formats
from shutterlake.functions.text import TOKENS, date_token, to_fixed2


def has_geo() -> Column:
    """Both coordinates are there and neither is 0."""
    return F.coalesce((F.col("lat") != 0) & (F.col("lon") != 0), F.lit(False))


def placeholder(key: str, seed: str = "0") -> Column:
    """The text of a placeholder over columns path, image_date, created_at, lat, lon, camera, duration; unknown ones are empty."""
    name, image, made = formats.stem("path"), F.col("image_date"), F.col("created_at")
    kind, _, token = key.partition(".")
    if kind in ("I", "F", "D") and (token in TOKENS or token in ("WW", "a", "A")):
        return date_token({"I": image, "F": made, "D": F.coalesce(image, made)}[kind], token)
    some = {
        "NAME": name,
        "NAME.L": F.lower(name),
        "NAME.U": F.upper(name),
        "EXT": formats.extension("path"),
        "RND": F.substring(F.md5(F.concat(F.col("path"), F.lit(seed))), 1, 8),
        "GEO": F.when(has_geo(), F.concat(to_fixed2(F.col("lat")), F.lit("_"), to_fixed2(F.col("lon")))),
        "CAM": F.col("camera"),
        "TYPE": F.when(F.col("duration") > 0, "Video").otherwise("Image"),
        "HAS.GEO": F.when(has_geo(), "GeoTagged").otherwise("NoGeo"),
        "HAS.CAM": F.when(F.coalesce(F.length("camera"), F.lit(0)) > 0, "WithCamera").otherwise("NoCamera"),
        "HAS.DATE": F.when(image.isNotNull(), "Dated").otherwise("NoDate"),
    }
    return F.coalesce(some[key], F.lit("")) if key in some else F.lit("")


def fill(template: str, seed: str = "0") -> Column:
    parts = re.split(r"\{([^{}]+)\}", template)
    return F.concat(F.lit(""), *[placeholder(p, seed) if i % 2 else F.lit(p) for i, p in enumerate(parts) if p])


def relative_target(template: str, seed: str = "0") -> Column:
    """Path below the target folder: no empty segments; a last segment that ends with the extension is the name."""
    joined = F.array_join(F.filter(F.split(fill(template, seed), "/"), lambda x: x != ""), "/")
    whole = F.when(joined == "", "NoDate").otherwise(joined)
    last = F.substring_index(whole, "/", -1)
    named = last.contains(".") & (F.substring_index(last, ".", -1) == formats.extension("path"))
    return F.when(named, whole).otherwise(F.concat(whole, F.lit("/"), formats.basename("path")))


def settle_conflicts(df: DataFrame, dst: str = "dst", key: str = "path", seed: str = "0", taken: DataFrame | None = None, rounds: tuple[int, ...] = (8, 16)) -> DataFrame:
    """Every file but the first (by key) of a target gets a suffix made of its path; where `taken` (a column of the target's name) has the target, the first too.

    Eight digits; sixteen for those that still meet, as among many files of one name some will. With rounds of (8,) those stay as they are.
    """
    out = df
    for digits in rounds:
        first = out.groupBy(dst).agg(F.min(key).alias("_first"))  # combined before it moves, so that a common name is no hot key
        if taken is not None:
            first = first.join(taken.select(F.col(dst).alias(dst)).distinct().withColumn("_there", F.lit(True)), dst, "left")
        else:
            first = first.withColumn("_there", F.lit(None).cast("boolean"))
        tag = F.concat(F.lit("_"), F.substring(F.md5(F.concat(F.col(key), F.lit(":conflict:"), F.lit(seed))), 1, digits))
        base, ext = formats.stem(F.col(dst)), formats.raw_extension(F.col(dst))
        folder = formats.dirname(F.col(dst))
        renamed = F.concat(F.when(~F.col(dst).contains("/"), "").otherwise(F.concat(folder, F.lit("/"))), base, tag, F.when(ext == "", "").otherwise(F.concat(F.lit("."), ext)))
        meets = (F.col(key) != F.col("_first")) | F.coalesce("_there", F.lit(False))
        out = out.join(first, dst).withColumn(dst, F.when(meets, renamed).otherwise(F.col(dst))).drop("_first", "_there")
    return out.select(*df.columns)


def relative_path(path: Column, folder: str) -> Column:
    """The path as seen from a folder, with ../ where it lies outside, and slashes for backslashes."""
    parts = lambda c: F.filter(F.split(F.replace(c, F.lit("\\"), F.lit("/")), "/"), lambda x: x != "")
    p, f = parts(path), parts(F.lit(folder))
    up_to = F.least(F.size(p), F.size(f))
    same = F.aggregate(F.sequence(F.lit(1), F.greatest(up_to, F.lit(1))), F.lit(0), lambda n, i: F.when((n == i - 1) & (i <= up_to) & (F.get(p, i - 1) == F.get(f, i - 1)), i).otherwise(n))
    return F.array_join(F.concat(F.array_repeat(F.lit(".."), F.size(f) - same), F.slice(p, same + 1, F.greatest(F.size(p), F.lit(1)))), "/")
