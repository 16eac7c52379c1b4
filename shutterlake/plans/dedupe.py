"""The whole of deduplication: from file information to clusters and roles."""

from __future__ import annotations

from pyspark.sql import DataFrame

from shutterlake.config import Params
from shutterlake.operators.media import connecting_edges
from shutterlake.operators.ranking import clusters, roles
from shutterlake.session import spool


def deduplicate(files: DataFrame, p: Params = Params()) -> DataFrame:
    """files (path, duration, frames, width, height, lat, lon, camera, image_date, size, ...) with cluster, score and role."""
    files = spool(files)
    return roles(spool(clusters(files, connecting_edges(files.select("path", "duration", "frames"), p))), p)
