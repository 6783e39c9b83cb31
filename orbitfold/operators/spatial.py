"""Range joins of points and of trajectories, argmin over time, islands of proximity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def distance(a: str, b: str):
    return F.sqrt(sum((F.col(f"{a}.{c}") - F.col(f"{b}.{c}")) * (F.col(f"{a}.{c}") - F.col(f"{b}.{c}")) for c in "xyz"))


#: The cells after a cell in one order of all 26 around it, and itself: each pair of neighbouring cells is met once.
_AHEAD = [(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1) if (i, j, k) >= (0, 0, 0)]


def finite(*names: str) -> str:
    return " AND ".join(f"{c} IS NOT NULL AND NOT isnan({c}) AND abs({c}) < 1e300" for c in names)


def range_self_join(points: DataFrame, radius: float, id_col: str = "id", keys: tuple[str, ...] = ()) -> DataFrame:
    """Pairs (id_a < id_b, as strings, keys, dist) at most ``radius`` apart: an equi-join of grid cells with 14 of the 27 around.

    Cells are a little wider than the radius, so that rounding puts no pair two cells apart. Rows with unequal ``keys``
    (a time, say) are no pairs. A dense cell is a skewed key of an inner join, which adaptive execution splits.
    Non-finite points are dropped. Both sides are shuffled: what a generator gives is not in the estimates of size, by
    which a table of millions of rows would be collected at the driver and broadcast.
    """
    width = max(radius * (1 + 1e-9), 1e-6)
    p = points.where(finite("x", "y", "z")).select(id_col, *keys, *"xyz")
    cell = p.select("*", *(F.floor(F.col(c) / width).alias(f"c{c}") for c in "xyz"))
    near = F.explode(F.array(*(F.struct(*(F.lit(v).alias(n) for v, n in zip(ijk, "ijk", strict=True))) for ijk in _AHEAD)))
    around = cell.withColumn("_n", near).withColumn("_own", F.expr("_n.i = 0 AND _n.j = 0 AND _n.k = 0"))
    around = around.withColumns({f"c{c}": F.col(f"c{c}") + F.col(f"_n.{n}") for c, n in zip("xyz", "ijk", strict=True)}).drop("_n")
    a, b = cell.alias("a").hint("merge"), around.alias("b").hint("merge")
    x, y = F.col(f"a.{id_col}"), F.col(f"b.{id_col}")
    first = x.cast("string") < y.cast("string")
    on = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("cx", "cy", "cz", *keys)]
    d = distance("a", "b")
    met = a.join(b, on).where((d <= radius) & (first | (~F.col("b._own") & (x.cast("string") != y.cast("string")))))
    return met.select(F.when(first, x).otherwise(y).alias("id_a"), F.when(first, y).otherwise(x).alias("id_b"), *(F.col(f"a.{k}").alias(k) for k in keys), d.alias("dist"))


def pairs_between(points: DataFrame, low: float, high: float, id_col: str = "id") -> DataFrame:
    """The pairs of ``range_self_join`` within ``high`` that one within ``low`` does not have: one join, told by the distance."""
    return range_self_join(points, high, id_col).where(F.col("dist") > low)


def upsert(points: DataFrame, changes: DataFrame, id_col: str = "id") -> DataFrame:
    """``points`` with the rows of ``changes`` in place of those with the same id."""
    return points.join(changes.select(id_col), id_col, "left_anti").unionByName(changes.select(*points.columns))


def rebuild(points: DataFrame) -> DataFrame:
    """The points that an index holds: finite ones."""
    return points.where(finite("x", "y", "z"))


def within_radius(points: DataFrame, x: float, y: float, z: float, radius: float) -> DataFrame:
    d = F.sqrt((F.col("x") - x) * (F.col("x") - x) + (F.col("y") - y) * (F.col("y") - y) + (F.col("z") - z) * (F.col("z") - z))
    return points.withColumn("dist", d).where(F.col("dist") <= radius)


def envelope(ephemeris: DataFrame, id_col: str = "id") -> DataFrame:
    """Mean position of each trajectory, and the largest distance from it."""
    mean = ephemeris.groupBy(id_col).agg(*(F.avg(c).alias(f"m{c}") for c in "xyz"))
    d = F.sqrt(sum((F.col(c) - F.col(f"m{c}")) * (F.col(c) - F.col(f"m{c}")) for c in "xyz"))
    return ephemeris.join(mean, id_col).groupBy(id_col, "mx", "my", "mz").agg(F.max(d).alias("excursion"))


def closest_samples(ephemeris: DataFrame, threshold: float, id_col: str = "id") -> DataFrame:
    """(id_a, id_b, step, dist): the first closest sample of each pair of trajectories, if at most ``threshold`` apart.

    The closest sample of such a pair is among its samples within the threshold, so only these are joined, by step and
    grid cell; no pair that is never near is a row.
    """
    near = range_self_join(ephemeris, threshold, id_col, ("step",))
    best = near.groupBy("id_a", "id_b").agg(F.min(F.struct("dist", "step")).alias("m"))
    return best.select("id_a", "id_b", F.col("m.step").alias("step"), F.col("m.dist").alias("dist"))


def islands(rows: DataFrame, key: str, order: str, flag) -> DataFrame:
    """(key, first, last, n) of each run of consecutive rows for which ``flag`` holds."""
    w = Window.partitionBy(key).orderBy(order)
    on = rows.select(key, order, F.coalesce(flag, F.lit(False)).alias("_on"))
    new = (F.col("_on") & ~F.coalesce(F.lag("_on").over(w), F.lit(False))).cast("int")
    runs = on.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("_on")
    return runs.groupBy(key, "_run").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("n")).drop("_run")
