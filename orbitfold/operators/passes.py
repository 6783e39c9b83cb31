"""Visibility: the state of each sample over its observer, and passes above a mask."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import formulas as f
from ..functions import geometry as g
from . import spatial


def look(samples: DataFrame, lat: str = "lat", lon: str = "lon", height_km: str = "height_km", jd: str = "t_jd") -> DataFrame:
    """``samples`` (x, y, z in TEME, time, observer columns) with elevation and azimuth in degrees."""
    ex, ey = f.teme_to_ecef("x", "y", jd)
    return g.extend(samples, [{"ex": ex, "ey": ey, "ez": "z"}, *g.look_angles(lat, lon, height_km)])


def passes(looks: DataFrame, key: str, order: str, mask_deg: float) -> DataFrame:
    """One row for each run of samples at or above the mask: key, first, last, n, best (sample of the greatest elevation)."""
    runs = spatial.islands(looks, key, order, F.col("elevation") >= mask_deg)
    inside = looks.select(F.col(key).alias("_k"), F.col(order).alias("_o"), "elevation").where(F.col("elevation") >= mask_deg)
    both = runs.join(inside, (F.col(key) == F.col("_k")) & F.col("_o").between(F.col("first"), F.col("last")))
    best = F.max_by("_o", F.struct("elevation", (-F.col("_o")).alias("o"))).alias("best")
    return both.groupBy(key, "first", "last", "n").agg(best, F.max("elevation").alias("max_elevation"))
