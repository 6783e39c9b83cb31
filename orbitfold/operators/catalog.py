"""Catalog operators: derived elements, filters, statistics, union with keep-first dedup."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import formulas as f


def derive(catalog: DataFrame) -> DataFrame:
    """Period, mean altitude, perigee and apogee from mean_motion and eccentricity."""
    out = catalog.withColumn("period_minutes", F.expr(f.period_minutes("mean_motion"))).withColumn("a_km", F.expr(f.semi_major_km("mean_motion")))
    return out.withColumns({"altitude_km": F.col("a_km") - F.expr(f.RE), "perigee_km": F.expr(f"a_km * (1e0 - eccentricity) - {f.RE}"), "apogee_km": F.expr(f"a_km * (1e0 + eccentricity) - {f.RE}")})


def filter_altitude(objects: DataFrame, low: float, high: float) -> DataFrame:
    return objects.where(F.col("altitude_km").between(low, high) & (F.col("perigee_km") >= 0.9 * low))


def filter_region(objects: DataFrame, low: float, high: float) -> DataFrame:
    return objects.where(F.expr(f.in_latitude_band("inclination", f"{low!r}D", f"{high!r}D")))


def filter_time_window(objects: DataFrame, start_jd: float) -> DataFrame:
    return objects.where(F.expr(f.is_fresh("epoch_jd", f"{start_jd!r}D", "altitude_km")))


def apply_filters(objects: DataFrame, altitude: tuple | None = None, latitude: tuple | None = None, start_jd: float | None = None, types: list[str] | None = None, first: int | None = None, ordinal: str = "ordinal") -> DataFrame:
    """Altitude, region, time, types, then the first rows in catalog order; None is no constraint."""
    if altitude:
        objects = filter_altitude(objects, *altitude)
    if latitude:
        objects = filter_region(objects, *latitude)
    if start_jd is not None:
        objects = filter_time_window(objects, start_jd)
    if types is not None:  # no types let nothing through
        objects = objects.where(F.col("object_type").isin(types))
    return objects.orderBy(ordinal).limit(first) if first is not None else objects


def staleness(objects: DataFrame, at_jd: float, days: float = 30.0, strict: bool = False) -> DataFrame:
    """``objects`` with ``stale``: whether their epoch is more than ``days`` from a time, before or after; strict raises then."""
    out = objects.withColumn("stale", F.abs(F.lit(at_jd) - F.col("epoch_jd")) > days)
    if strict:
        from ..errors import PropagationError

        old = out.where("stale").select("epoch_jd").first()
        if old is not None:
            raise PropagationError("elements are stale", epoch_jd=old[0], at_jd=at_jd)
    return out


def statistics(objects: DataFrame) -> DataFrame:
    """One row; other types than the four are not counted by type; zeros for an empty catalog."""
    count = lambda cond: F.count_if(F.expr(cond)).cast("long")
    regime, band = f.regime("altitude_km", "eccentricity"), f.inclination_band("inclination")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return objects.agg(
        F.count(F.lit(1)).alias("total_count"),
        *(count(f"object_type = '{t}'").alias(t.lower()) for t in ("PAYLOAD", "ROCKET_BODY", "DEBRIS", "UNKNOWN")),
        *(count(f"({regime}) = '{r}'").alias(r.lower()) for r in ("LEO", "MEO", "GEO", "HEO")),
        *(count(f"({band}) = '{b}'").alias(b) for b in ("equatorial", "inclined", "polar", "retrograde")),
        zero(F.avg("altitude_km")).alias("altitude_mean_km"), zero(F.stddev_pop("altitude_km")).alias("altitude_std_km"),
        zero(F.min("altitude_km")).alias("altitude_min_km"), zero(F.max("altitude_km")).alias("altitude_max_km"),
    )


def union_keep_first(groups: list[DataFrame], key: str = "norad_id", ordinal: str = "ordinal") -> DataFrame:
    """The groups' union with one row for each key: that of the earliest group, then of the least ordinal."""
    every = None
    for k, g in enumerate(groups):
        g = g.withColumn("__group", F.lit(k))
        every = g if every is None else every.unionByName(g, allowMissingColumns=True)
    rank = F.row_number().over(Window.partitionBy(key).orderBy("__group", ordinal))
    return every.withColumn("__rank", rank).where("__rank = 1").drop("__rank", "__group")
