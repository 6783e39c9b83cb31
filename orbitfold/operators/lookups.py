"""Environment lookups: by calendar day with defaults, and interpolated between neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def daily(rows: DataFrame, table: DataFrame, day: str, defaults: dict[str, float]) -> DataFrame:
    """Left join by day; days that the table lacks get the defaults."""
    out = rows.join(table, day, "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def interpolate(rows: DataFrame, table: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """``value`` of the table, linear between the neighbours of ``key`` and carried on beyond both ends, at ``at``.

    Each row of the table becomes the interval to its successor; an equi-join on a whole-number bucket of ``key`` pairs
    rows with intervals, so it is no nested loop. ``key`` is an integer that has no large gaps.
    """
    w = Window.orderBy(key)  # the table has a row for each day: a small dimension
    t = table.select(F.col(key).alias("k0"), F.col(value).alias("v0"), F.lead(key).over(w).alias("k1"), F.lead(value).over(w).alias("v1"), F.lag(key).over(w).isNull().alias("first"))
    t = t.where("k1 IS NOT NULL").withColumn("final", F.lead("k0").over(Window.orderBy("k0")).isNull())
    ends = t.where("first OR final").agg(F.min("k0").alias("lo"), F.max("k1").alias("hi"))
    at_bucket = F.greatest(F.col("lo"), F.least(F.col("hi") - 1, F.floor(F.col(at))))
    r = rows.crossJoin(F.broadcast(ends)).withColumn("_b", at_bucket)  # one row of two numbers
    t = t.withColumn("_b", F.explode(F.sequence(F.col("k0"), F.col("k1") - 1)))
    out = r.join(t, "_b")
    return out.withColumn(value, F.col("v0") + (F.col("v1") - F.col("v0")) * (F.col(at) - F.col("k0")) / (F.col("k1") - F.col("k0"))).select(*rows.columns, value)
