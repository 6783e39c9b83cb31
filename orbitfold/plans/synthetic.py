"""Orbits, points and burns made from the relational test tables by integer arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Select lists over ``customer`` and ``supplier`` that any SQL engine can run.
CATALOG = """c_custkey AS ordinal, CAST(c_custkey AS VARCHAR(20)) AS norad_id, 1e0 + ((c_custkey * 97) % 1500) / 100e0 AS mean_motion,
 ((c_custkey * 37) % 1800) / 10e0 AS inclination, ((c_custkey * 13) % 300) / 1000e0 AS eccentricity, ((c_custkey * 53) % 3600) / 10e0 AS raan,
 ((c_custkey * 71) % 3600) / 10e0 AS argp, ((c_custkey * 29) % 3600) / 10e0 AS mean_anomaly, 2460310.5e0 + (c_custkey % 40) / 4e0 AS epoch_jd,
 CASE c_custkey % 5 WHEN 0 THEN 'PAYLOAD' WHEN 1 THEN 'ROCKET_BODY' WHEN 2 THEN 'DEBRIS' WHEN 3 THEN 'UNKNOWN' ELSE 'TBA' END AS object_type"""
POINTS = "p_partkey AS id, (p_partkey * 7919) % 4001 - 2000e0 AS x, (p_partkey * 6101) % 4003 - 2000e0 AS y, (p_partkey * 4523) % 4007 - 2000e0 AS z"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def catalog(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.catalog import derive

    return derive(table(spark, sf, "customer").select(F.expr("struct(" + CATALOG + ")").alias("s")).select("s.*"))


def points(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(F.expr("struct(" + POINTS + ")").alias("s")).select("s.*")


EPHEMERIS_STEPS = 24
TRACK = {"x": "(7000e0 + (s_suppkey % 50) * 20e0) * cos(s_suppkey * 0.37e0 + step * 0.26e0)", "y": "(7000e0 + (s_suppkey % 50) * 20e0) * sin(s_suppkey * 0.37e0 + step * 0.26e0) * cos(s_suppkey * 0.11e0)", "z": "(7000e0 + (s_suppkey % 50) * 20e0) * sin(s_suppkey * 0.37e0 + step * 0.26e0) * sin(s_suppkey * 0.11e0)"}


def ephemeris(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "supplier").select("s_suppkey").withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(EPHEMERIS_STEPS - 1))))
    return rows.select(F.col("s_suppkey").alias("id"), "step", *(F.expr(e).alias(c) for c, e in TRACK.items()))


def burns(spark: SparkSession, sf: str) -> DataFrame:
    """Burns of each customer's orders: start and stop in seconds."""
    o = table(spark, sf, "orders")
    start = (F.col("o_orderkey") * 7919) % 86400
    return o.select(F.col("o_custkey").alias("sat"), F.col("o_orderkey").alias("id"), start.alias("start"), (start + 60 + (F.col("o_orderkey") * 31) % 3000).alias("stop"))
